"""Every query of the library's own registry next to its check SQL on the smallest tables."""

from pathlib import Path

import pytest

duckdb = pytest.importorskip("duckdb")
SF_DIR = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF_DIR.exists(), reason="no test tables")

import __spark_entry__ as registered  # noqa: E402
from deltawarden.workloads import registry  # noqa: E402
from tools.verify import table  # noqa: E402


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for path in SF_DIR.glob("*.parquet"):
        connection.execute(f"create view {path.stem} as select * from read_parquet('{path}')")
    return connection


@pytest.fixture(autouse=True)
def compiled(spark):
    """Queries run as they are shipped, with generated code; other tests do without to start faster."""
    spark.conf.set("spark.sql.codegen.wholeStage", "true")
    yield
    spark.conf.set("spark.sql.codegen.wholeStage", "false")


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, database, name):
    result = registered.queries()[name](spark, str(SF_DIR))
    cursor = database.execute(registered.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(result.columns)
    assert table(result.collect(), result.columns) == table(cursor.fetchall(), names)


def test_entry(spark):
    verdict = registered.entry(spark).collect()
    assert [(r["conclusion"], r["severity"], r["gate_code"]) for r in verdict] == [("failure", "critical", 1)]
