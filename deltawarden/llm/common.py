"""Small helpers that several operators of this subpackage share."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

# The white space that separates words, as single bytes and as a pattern for a word.
WHITE_BYTES = b"\t\n\x0b\x0c\r "
WHITE = WHITE_BYTES.decode()
WORD = r"[^\x20\x09-\x0D]+"


def whole_text(df: DataFrame, column: str = "text") -> Column:
    """The text of a row; null counts as empty."""
    return F.coalesce(df[column].cast("string"), F.lit(""))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the rows do not have yet, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def same(left: Column, right: Column) -> Column:
    return left.eqNullSafe(right)


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(data: bytes, size: int = 1 << 22, end: bytes = b" ") -> Iterator[bytes]:
    """The data in pieces of about ``size`` bytes that end before an ``end`` byte, which goes; none is cut inside a
    word however long. Lists of words made from them stay small for texts of any length."""
    start = 0
    while start < len(data):
        stop = data.find(end, start + size)
        stop = len(data) if stop < 0 else stop
        yield data[start:stop]
        start = stop + 1


def give_back() -> None:
    """Return memory that is not in use to the system: Spark keeps a worker for a while after its last task, and the
    tasks that come next may need the memory elsewhere."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass
