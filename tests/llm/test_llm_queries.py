"""The registered queries of this subpackage on the smallest tables."""

from pathlib import Path

import pytest

duckdb = pytest.importorskip("duckdb")
SF_DIR = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF_DIR.exists(), reason="no test tables")

import __spark_entry__ as registered  # noqa: E402
from deltawarden.llm.queries import ORACLES, QUERIES  # noqa: E402
from tools.verify import table  # noqa: E402


def test_operators_and_the_pipeline_are_registered():
    names = registered.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)] == [1] * 13 and "pipeline" in names


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    database = duckdb.connect()
    for path in SF_DIR.glob("*.parquet"):
        database.execute(f"create view {path.stem} as select * from read_parquet('{path}')")
    result = registered.queries()[name](spark, str(SF_DIR))
    cursor = database.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(result.columns)
    assert table(result.collect(), result.columns) == table(cursor.fetchall(), names)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_every_row_has_its_result(spark, name):
    result = registered.queries()[name](spark, str(SF_DIR)).collect()
    source, key = ("pages", "page_id") if name.startswith("op2_") else ("documents", "doc_id")
    ids = {r[0] for r in spark.read.parquet(f"{SF_DIR}/{source}.parquet").select(key).collect()}
    assert {r[key] for r in result} == ids
