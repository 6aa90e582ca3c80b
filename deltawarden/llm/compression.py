"""Quality rules from compression bands.

A text that compresses far better than prose repeats itself; one that hardly compresses is noise. Both are
measured with zstandard over the whole text and over fixed chunks of it. Short texts compress worse than long
ones, so each band of lengths has limits of its own.

Defined results: a null or empty text has no words and fails the base rules. Repeated rows get the same verdict,
each on its own. Other columns are left alone, whatever their names; the verdict is one struct column.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from deltawarden.llm.common import WHITE, WHITE_BYTES, fresh, whole_text

SYMBOLS = b"#*$%&|<>"
VERDICT = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "base_failed boolean, ratio double, n_chunks bigint, n_low_chunks bigint, n_high_chunks bigint, "
    "reason string, kept boolean"
)


@dataclass(frozen=True)
class Band:
    """Limits for texts of at least ``min_bytes`` bytes: compressed size over size must lie in [low, high]."""

    min_bytes: int
    low: float
    high: float


# From 256 to 32,768 bytes, limits come from the ratios of texts labelled quality 1 that pass the base rules: a sample of
# 3,243 texts (documents and labels of sf0.1). Low: 0.01 to 0.015 below the least ratio of the band, but 0.10 and 0.03 in
# the first two bands, where repetition hardly shows. High: 0.07 to 0.11 above the greatest ratio, because other
# languages and rarer words compress worse. The sample has no text from 32,768 bytes on and none below 256; there the
# limits are wide, and the chunks decide long texts.
BANDS = (
    Band(0, 0.0, float("inf")),
    Band(128, 0.35, 1.0),
    Band(256, 0.50, 0.82),
    Band(384, 0.51, 0.80),
    Band(512, 0.515, 0.76),
    Band(768, 0.495, 0.70),
    Band(1024, 0.475, 0.67),
    Band(1536, 0.455, 0.63),
    Band(2048, 0.45, 0.60),
    Band(3072, 0.44, 0.58),
    Band(4096, 0.425, 0.56),
    Band(6144, 0.415, 0.55),
    Band(8192, 0.41, 0.54),
    Band(12288, 0.40, 0.53),
    Band(16384, 0.39, 0.52),
    Band(32768, 0.22, 0.62),
    Band(65536, 0.20, 0.60),
)


@dataclass(frozen=True)
class CompressionRules:
    """chunk_bytes: size of the fixed chunks; a shorter rest is judged by its own band.

    max_bad_chunks: the share of chunk bytes outside their band that a text may have.
    """

    bands: Sequence[Band] = BANDS
    chunk_bytes: int = 4096
    max_bad_chunks: float = 0.34
    level: int = 3
    min_words: int = 50
    max_repeat_percent: int = 50

    def band(self, n_bytes: int) -> Band:
        return [b for b in self.bands if b.min_bytes <= n_bytes][-1]


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that the text holds twice or more, first occurrences included."""
    n, ids = len(words), {}
    if n < 4:
        return 0
    a = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    size = len(ids)
    if size == n:
        return 0
    pair = a[:-2] * size + a[1:-1]
    if size >= 2_000_000:  # three ids no longer fit in one number: number the pairs first
        pair = np.unique(pair, return_inverse=True)[1]
    key = pair * size + a[2:]
    order = np.argsort(key, kind="stable")
    equal = np.diff(key[order]) == 0
    if not equal.any():
        return 0
    twice = np.zeros(n - 2, bool)
    twice[order[1:][equal]] = True
    twice[order[:-1][equal]] = True
    covered = np.zeros(n, bool)
    for shift in range(3):
        covered[shift:n - 2 + shift] |= twice
    return int(covered.sum())


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in text.split("\n") if line.strip(WHITE)]
    return len(lines) - len(set(lines))


def judge_text(text: str, data: bytes, n_chars: int, rules: CompressionRules,
               compressor: zstandard.ZstdCompressor) -> tuple:
    words = data.split()  # bytes split at exactly the six white space bytes
    n_words = len(words)
    word_chars = n_chars - (len(data) - len(data.translate(None, WHITE_BYTES)))
    n_symbols = len(data) - len(data.translate(None, SYMBOLS))
    n_repeat = repeated_words(words)
    base_failed = n_words < rules.min_words or 100 * n_repeat > rules.max_repeat_percent * n_words

    size = len(data)
    ratio, reason = None, None
    chunks = low = high = bad = 0
    if size:
        ratio = len(compressor.compress(data)) / size
        band = rules.band(size)
        for start in range(0, size, rules.chunk_bytes):
            piece = data[start:start + rules.chunk_bytes]
            limits = rules.band(len(piece))
            part = ratio if len(piece) == size else len(compressor.compress(piece)) / len(piece)
            chunks += 1
            low += part < limits.low
            high += part > limits.high
            bad += len(piece) * (part < limits.low or part > limits.high)
        if ratio < band.low:
            reason = "repetitive"
        elif ratio > band.high:
            reason = "incompressible"
        elif bad > rules.max_bad_chunks * size:
            reason = "repetitive_chunks" if low >= high else "incompressible_chunks"
    if base_failed:
        reason = "too_short" if n_words < rules.min_words else "repeated_windows"
    return (n_words, word_chars, n_symbols, duplicate_lines(text), n_repeat, base_failed, ratio, chunks, low, high,
            reason, reason is None)


def verdict(text: Column, rules: CompressionRules = CompressionRules()) -> Column:
    """One struct per text; see ``VERDICT``."""
    names = [field.split()[0] for field in VERDICT.split(", ")]
    kinds = {"bigint": pa.int64(), "boolean": pa.bool_(), "double": pa.float64(), "string": pa.string()}
    types = [kinds[field.split()[1]] for field in VERDICT.split(", ")]

    @F.arrow_udf(VERDICT_STRUCT)
    def judged(texts: pa.Array) -> pa.Array:
        compressor = zstandard.ZstdCompressor(level=rules.level)
        lengths = pc.utf8_length(texts).to_pylist()
        # One text at a time: a batch is never held as Python strings as a whole.
        rows = [judge_text(t, t.encode(), n, rules, compressor)
                for t, n in ((item.as_py(), n) for item, n in zip(texts, lengths, strict=True))]
        columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
        return pa.StructArray.from_arrays(
            [pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names)

    return judged(text)


VERDICT_STRUCT = "struct<" + ", ".join(
    f"{name}: {kind}" for name, kind in (field.split() for field in VERDICT.split(", "))) + ">"


def judge(docs: DataFrame, rules: CompressionRules = CompressionRules(), text: str = "text") -> tuple[DataFrame, str]:
    """The rows with a verdict struct, and the name of that column. Row by row: no shuffle."""
    name = fresh(docs, "verdict")
    return docs.withColumn(name, verdict(whole_text(docs, text), rules)), name


def keep_good(docs: DataFrame, rules: CompressionRules = CompressionRules(), text: str = "text") -> DataFrame:
    """Only the rows that pass, with the columns they came with."""
    judged, name = judge(docs, rules, text)
    return judged.where(F.col(name)["kept"]).select(*docs.columns)
