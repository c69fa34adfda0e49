"""ERP bundles over hand-written frames."""


def make_erp(spark, tables: dict):
    """An Erp bundle over hand-written frames: {name: (rows, ddl schema)}."""
    from plantops.sources.erp import Erp
    from plantops.sources.fixed import checklist_templates
    builders = {}
    for name, (rows, schema) in tables.items():
        builders[name] = (lambda r=rows, s=schema: spark.createDataFrame(r, s))
    builders.setdefault("checklist_template", lambda: checklist_templates(spark))
    return Erp(spark, builders)
