"""Profiles of event windows, compared with a stored baseline as the windows close.

A stream is cut into windows of event time. Each window has the mergeable state of ``stored_profile``; Spark keeps it
until the watermark has passed the window's end, then the window is profiled, compared with the baseline and stored.
A micro-batch that runs again replaces what it stored before, so every window is there once. Rows that come later
than the watermark allows are dropped by Spark and counted here.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from deltawarden.operators.compare import Thresholds, compare_profiles
from deltawarden.operators.stored_profile import StoredMeasures, profile_of, states
from deltawarden.session import cut_lineage, with_key
from deltawarden.sources.store import KeyedStore


def window_states(events: DataFrame, time: str, width: str, delay: str, measures: StoredMeasures,
                  columns: Sequence[str] | None = None) -> DataFrame:
    """One state per window, for a stream or a table; ``columns`` are profiled, by default all but the time."""
    columns = [c for c in events.columns if c != time] if columns is None else list(columns)
    timed = events.withWatermark(time, delay) if events.isStreaming else events
    return states(timed.select(F.window(time, width).alias("window"), *columns), measures, ["window"])


def window_profiles(closed: DataFrame, types: Sequence[tuple[str, str]], measures: StoredMeasures) -> DataFrame:
    """``(window, category, metric, num_value, text_value)``; the window is named by its start."""
    named = closed.withColumn("window", F.date_format("window.start", "yyyy-MM-dd'T'HH:mm:ss"))
    return profile_of(named, types, measures, ["window"])


def against_baseline(profiles: DataFrame, baseline: DataFrame, model: str, thresholds: Thresholds) -> DataFrame:
    """Differences of every window from the baseline ``(category, metric, num_value, text_value)``."""
    windows = profiles.select("window").distinct()
    # One profile for every window: as many rows as the result may have.
    before = with_key(windows.join(F.broadcast(baseline)), {"side": "before", "model": model})
    after = with_key(profiles, {"side": "after", "model": model})
    return compare_profiles(before.unionByName(after), thresholds, ("window", "model"))


@dataclass(frozen=True)
class WindowWatch:
    """Where the windows go: ``profiles`` and ``differences`` are stores below ``path``, keyed by window."""

    path: str
    model: str
    measures: StoredMeasures
    baseline: DataFrame
    thresholds: Thresholds = Thresholds()
    buckets: int = 8

    def store(self, name: str) -> KeyedStore:
        return KeyedStore(self.baseline.sparkSession, f"{self.path}/{name}", "window", self.buckets)

    def start(self, events: DataFrame, time: str, width: str, delay: str, checkpoint: str,
              columns: Sequence[str] | None = None, **trigger) -> StreamingQuery:
        """Watch a stream. ``trigger`` as in ``DataStreamWriter.trigger``, by default all there is now."""
        columns = [c for c in events.columns if c != time] if columns is None else list(columns)
        types = events.select(*columns).dtypes

        def judge(closed: DataFrame, _: int) -> None:
            profiles = cut_lineage(window_profiles(closed, types, self.measures))
            if profiles.isEmpty():
                return
            replace = lambda stored, new: new.unionByName(
                stored.join(new.select("window").distinct(), "window", "left_anti"))
            self.store("profiles").update(profiles, replace)
            found = against_baseline(profiles, self.baseline, self.model, self.thresholds)
            self.store("differences").update(found, replace)

        closed = window_states(events, time, width, delay, self.measures, columns)
        return closed.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(
            **(trigger or {"availableNow": True})).foreachBatch(judge).start()


def late_rows(query: StreamingQuery) -> int:
    """Rows that came after the watermark, over the progress that the query still remembers."""
    return sum(int(operator["numRowsDroppedByWatermark"]) for progress in query.recentProgress
               for operator in progress["stateOperators"])
