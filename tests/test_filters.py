from plantops.functions.filters import apply_filters


def test_filter_dict_shapes(spark):
    df = spark.createDataFrame([("a", 1, None), ("b", 0, "x"), ("c", 1, ""), ("d", 1, "y")],
                               "name string, docstatus int, work_order string")
    got = apply_filters(df, {"docstatus": 1, "work_order": ["!=", ""]})
    assert [r.name for r in got.collect()] == ["d"]
    got = apply_filters(df, {"name": ["in", ["a", "b"]]})
    assert sorted(r.name for r in got.collect()) == ["a", "b"]
    got = apply_filters(df, [["Stock Entry", "work_order", "!=", "x"]])
    # the ERP wraps != in ifnull(): NULL passes a "!= value" test
    assert sorted(r.name for r in got.collect()) == ["a", "c", "d"]
    assert apply_filters(df, None).count() == 4


def test_values_are_read_by_field_type(spark):
    import datetime as dt
    from decimal import Decimal

    import pytest
    rows = [("a", dt.date(2024, 1, 1), True, Decimal("1.50"), 3, dt.datetime(2024, 1, 1, 8)), ("b", dt.date(2024, 2, 1), False, Decimal("2"), 0, dt.datetime(2024, 1, 2)),
            ("n", None, None, None, None, None)]
    df = spark.createDataFrame(rows, "name string, day date, checked boolean, rate decimal(10,2), n int, at timestamp_ntz")

    def names(filters):
        return "".join(sorted(r.name for r in apply_filters(df, filters).collect()))

    assert names({"day": ["!=", "2024-01-01"]}) == "bn" and names({"day": ["!=", dt.date(2024, 2, 1)]}) == "an" and names({"day": ["!=", ""]}) == "ab"
    assert names({"checked": ["!=", 1]}) == "bn" and names({"checked": ["!=", False]}) == "a" and names({"checked": "1"}) == "a"
    assert names({"rate": ["!=", "1.5"]}) == "bn" and names({"rate": [">", "1.6"]}) == "b" and names({"rate": ["!=", 0]}) == "ab"
    assert names({"n": ["not in", ["3", 7]]}) == "bn" and names({"n": ["not in", [0]]}) == "a" and names({"n": ["in", [3, None]]}) == "abn"
    assert names({"name": ["not in", ["a"]]}) == "bn" and names({"name": ["in", []]}) == "" and names({"name": ["not in", []]}) == "abn"
    assert names({"at": ["<=", "2024-01-01 08:00:00"]}) == "a" and names({"at": ["!=", "2024-01-02"]}) == "an"
    assert names({"day": ["is", "not set"]}) == "n" and names({"n": None}) == "n" and names({"n": 2.5}) == ""
    for field, value in (("day", "soon"), ("n", "many"), ("rate", "x"), ("checked", "perhaps")):
        with pytest.raises(ValueError):
            names({field: value})
