"""Inputs that stay as they are while a replay reads them more than once.

A DataFrame over files lists them once, when it is made; every plan that starts from it reads that list. Pinning
writes the list (path, size, time) to a table as well, so that it can be told afterwards whether a file was replaced
or removed in between. Files added later are in no list and change nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import TypeVar

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from deltawarden.session import cut_lineage

T = TypeVar("T")


class InputChangedError(RuntimeError):
    """A pinned file is gone or another one now."""


@dataclass(frozen=True)
class PinnedInput:
    """``rows`` reads the pinned files and no others; ``files`` has (path, size, modified) of each that holds rows."""

    rows: DataFrame
    files: DataFrame
    location: str

    def changed(self) -> DataFrame:
        """``(path, problem)``: pinned files that are missing, or have another size or time than when pinned."""
        now = self.rows.sparkSession.read.format("binaryFile").option("recursiveFileLookup", "true").load(self.location)
        # The content column is not selected, so files are listed and not read.
        now = now.select(bare_path(F.col("path")).alias("path"), F.col("length").alias("size_now"),
                         F.col("modificationTime").alias("modified_now"))
        compared = self.files.join(now, "path", "left")
        return compared.select("path", F.when(F.col("size_now").isNull(), "removed").when(
            (F.col("size") != F.col("size_now")) | (F.col("modified") != F.col("modified_now")), "replaced").alias(
            "problem")).where("problem is not null")

    def require_unchanged(self) -> None:
        found = self.changed().orderBy("path").first()
        if found:
            raise InputChangedError(f"input {found['path']} was {found['problem']} during the replay")


def bare_path(path: Column) -> Column:
    """A path without scheme and host, as readers spell these differently."""
    return F.regexp_replace(path, r"^[A-Za-z0-9+.-]+:(//[^/]*)?/+", "/")


def decoded_path(path: Column) -> Column:
    """The metadata column has paths as URIs; in these a plus sign stands for itself."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def pin(rows: DataFrame, location: str) -> PinnedInput:
    """Pin the files of a DataFrame read from ``location``. No column is read for the list."""
    seen = rows.select(bare_path(decoded_path(F.col("_metadata.file_path"))).alias("path"), F.col("_metadata.file_size").alias("size"),
                       F.col("_metadata.file_modification_time").alias("modified"))
    return PinnedInput(rows, cut_lineage(seen.distinct()), location)


def pinned_parquet(spark: SparkSession, location: str) -> PinnedInput:
    return pin(spark.read.parquet(location), location)


def over_pinned(inputs: list[PinnedInput], action: Callable[[], T]) -> T:
    """What ``action`` returns, if no pinned file was replaced or removed meanwhile."""
    try:
        result = action()
    except Exception as error:
        for one in inputs:  # a file that went is the better reason
            try:
                one.require_unchanged()
            except InputChangedError as changed:
                raise changed from error
        raise
    for one in inputs:
        one.require_unchanged()
    return result
