"""Deltawarden: tells whether a change to a data model alters the data its consumers read.

Everything is a function from DataFrames to DataFrames, keyed by ``analysis_id``,
so one Spark job can judge many changes to many models over full-size inputs.
"""

from deltawarden.plans.analysis import full_analysis
from deltawarden.plans.context import change_context
from deltawarden.plans.replay import RowModel, replay, replay_models, replay_rowwise
from deltawarden.operators.compare import Thresholds, compare_profiles, comparison_rollup
from deltawarden.operators.decide import Policy, decide_merge
from deltawarden.operators.detect import detect_changes
from deltawarden.operators.identity import resolve_identity
from deltawarden.operators.lineage import downstream_lineage
from deltawarden.operators.profile import profile_table

__all__ = [
    "Policy", "RowModel", "Thresholds", "change_context", "compare_profiles", "comparison_rollup",
    "decide_merge", "detect_changes", "downstream_lineage", "full_analysis", "profile_table",
    "replay", "replay_models", "replay_rowwise", "resolve_identity",
]
