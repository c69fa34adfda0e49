import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))


@pytest.fixture(scope="session")
def spark():
    from plantops.session import get_session
    s = get_session("local[4]", app="plantops-tests", shuffle_partitions=8,
                    extra={"spark.ui.showConsoleProgress": "false", "spark.ui.enabled": "false"})
    yield s
    s.stop()


@pytest.fixture(scope="module", autouse=True)
def no_stored_tables(spark):
    """Each test file begins without the stored tables of the files before it."""
    from plantops.sources.store import drop_stores
    drop_stores(spark)
