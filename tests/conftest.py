import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from deltawarden.session import build_session, local_scratch, release  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[4]", **{
        "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g",
        # Tables here are tiny: compiling generated code would take longer than running without it.
        "spark.sql.codegen.wholeStage": "false"})
    session.sparkContext.setLogLevel("ERROR")
    local_scratch(session)
    yield session
    release(session)
    session.stop()


@pytest.fixture
def rows():
    """Collect as a list of tuples, sorted, for comparison."""
    def collect(df, *columns):
        picked = df.select(*columns) if columns else df
        return sorted((tuple(r) for r in picked.collect()), key=str)
    return collect
