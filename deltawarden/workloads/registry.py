"""All registered queries and checks."""

from deltawarden.workloads import catalogs, decisions, detection, projects, replays, streams  # noqa: F401 - they register on import
from deltawarden.workloads.inputs import ORACLES, QUERIES
from deltawarden.workloads.replays import flagship

__all__ = ["ORACLES", "QUERIES", "flagship"]
