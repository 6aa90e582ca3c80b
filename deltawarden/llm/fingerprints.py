"""Exact duplicates by composable polynomial fingerprints.

White space is deleted, the rest is cut into chunks, and each chunk is hashed as a polynomial over its bytes under
several moduli. The hash of a text follows from those of its chunks: append a chunk by shifting what stands before it
by the chunk's length, ``h = h * base^length + h_chunk``. So the chunks of a huge text are hashed in different tasks.
Texts with equal fingerprints and lengths are then compared chunk by chunk: chunks are grouped by content, exactly,
with partial aggregation, so that thousands of copies leave one row per chunk in each task. Should a fingerprint cover
different texts, its documents are told apart by which content each of their chunks has.

Defined results: a null or empty text, or one of white space alone, is an empty text, and all of them are equal. Of
equal texts the row with the most code points in the original text stays, then the smallest doc_id, a null doc_id
last; of rows that repeat that doc_id too, one stays. An empty table gives an empty result. Only doc_id and text are
read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from deltawarden.llm.common import WHITE, same, whole_text
from deltawarden.session import cut_lineage


@dataclass(frozen=True)
class Polynomials:
    """chunk_chars: characters per chunk. Each (modulus, base) adds some 31 bits; moduli are primes below 2^31."""

    chunk_chars: int = 65536
    fields: tuple[tuple[int, int], ...] = (
        (2147483647, 1000003), (2147483629, 92821), (2147483587, 726733), (2147483579, 1471343))


BLOCK = 65536  # bytes summed at a time: 2^16 products below 2^39 fit in 64 bits


@lru_cache(maxsize=16)
def _powers(modulus: int, base: int) -> np.ndarray:
    """base^(BLOCK - 1) .. base^0, by doubling."""
    powers, step = np.ones(1, np.uint64), base % modulus
    while len(powers) < BLOCK:
        powers = np.concatenate([powers * np.uint64(step) % np.uint64(modulus), powers])
        step = step * step % modulus
    return powers


def polynomials(data: bytes, fields: tuple[tuple[int, int], ...]) -> list[int]:
    """The hash of the bytes for each (modulus, base)."""
    values, totals = np.frombuffer(data, np.uint8), [0] * len(fields)
    start = 0
    while start < len(values):
        block = values[start:start + (len(values) - start - 1) % BLOCK + 1].astype(np.uint64)
        for k, (modulus, base) in enumerate(fields):
            shifted = totals[k] * pow(base, len(block), modulus) if totals[k] else 0
            totals[k] = (shifted + int(np.dot(block, _powers(modulus, base)[-len(block):]))) % modulus
        start += len(block)
    return totals


def hashed_chunks(chunks: DataFrame, rules: Polynomials) -> DataFrame:
    """Add n_bytes and, per field, hash and shift of the chunk column."""
    kept = [c for c in chunks.columns if c != "chunk"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("chunk")
            data = [piece.as_buffer().to_pybytes() if piece.is_valid else b""
                    for piece in batch.column(at).cast(pa.binary())]
            pairs = [[(h, pow(b, len(d), p)) for h, (p, b) in zip(polynomials(d, rules.fields), rules.fields, strict=True)]
                     for d in data]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in kept] + [pa.array([len(d) for d in data], pa.int64()), pa.array(
                    [[{"h": h, "s": s} for h, s in row] for row in pairs],
                    pa.list_(pa.struct([("h", pa.int64()), ("s", pa.int64())])))],
                names=[*kept, "n_bytes", "parts"])

    fields = ", ".join(f"{c} {chunks.schema[c].dataType.simpleString()}" for c in kept)
    return chunks.mapInArrow(work, f"{fields}, n_bytes bigint, parts array<struct<h: bigint, s: bigint>>")


def _chunked(norm: Column, size: int) -> Column:
    """The chunks of a text in order; an empty text has one empty chunk."""
    count = F.greatest(F.ceil(F.length(norm) / F.lit(size)), F.lit(1)).cast("int")
    return F.transform(F.sequence(F.lit(0), count - 1),
                       lambda i: F.substring(norm, i * F.lit(size) + 1, F.lit(size)))


def fingerprints(docs: DataFrame, rules: Polynomials = Polynomials(), doc_id: str = "doc_id",
                 text: str = "text") -> DataFrame:
    """One row per input row: row_id, doc_id, n_chars, content_key, n_bytes, fingerprint (array), text_sha256.

    Texts of one chunk are hashed where they are; the chunks of longer ones are spread over the cluster first.
    row_id tells repeated rows apart within this result, so write it before it is read twice.
    """
    norm = F.translate(whole_text(docs, text), WHITE, "")
    rows = docs.select(
        F.monotonically_increasing_id().alias("row_id"), docs[doc_id].alias("doc_id"),
        F.length(whole_text(docs, text)).cast("bigint").alias("n_chars"), norm.alias("norm"))
    thin = ["row_id", "doc_id", "n_chars", "content_key", "text_sha256"]
    rows = rows.withColumns({"content_key": F.xxhash64("norm"), "text_sha256": F.sha2("norm", 256)})
    long_text = F.length("norm") > rules.chunk_chars

    short = hashed_chunks(rows.where(~long_text).select(*thin, F.col("norm").alias("chunk")), rules).select(
        *thin, "n_bytes", F.transform("parts", lambda part: part["h"]).alias("fingerprint"))

    pieces = rows.where(long_text).select(
        *thin, F.posexplode(_chunked(F.col("norm"), rules.chunk_chars)).alias("chunk_no", "chunk"))
    # The spread rows carry their own number, so nothing depends on how the scan was cut.
    spread = hashed_chunks(pieces.repartition("row_id", "chunk_no"), rules)
    ordered = F.sort_array(F.collect_list(F.struct("chunk_no", "n_bytes", "parts")))  # a few numbers per chunk
    long_rows = spread.groupBy(*thin).agg(F.sum("n_bytes").alias("n_bytes"), ordered.alias("chunks"))
    def appended(k: int, modulus: int) -> Column:
        """The chunks' hashes of field k, each shifting what stands before it."""
        return F.aggregate("chunks", F.lit(0).cast("bigint"), lambda h, c: (
            h * c["parts"][k]["s"] + c["parts"][k]["h"]) % F.lit(modulus).cast("bigint"))

    combined = F.array(*[appended(k, p) for k, (p, _) in enumerate(rules.fields)])
    return short.unionByName(long_rows.select(*thin, "n_bytes", combined.alias("fingerprint")))


def equality_classes(docs: DataFrame, prints: DataFrame, rules: Polynomials = Polynomials(), doc_id: str = "doc_id",
                     text: str = "text") -> DataFrame:
    """prints with content_class: rows are equal if n_bytes, fingerprint and content_class are.

    prints must be a written table. Only texts that share a fingerprint are read again.
    """
    key = ["n_bytes", "fingerprint"]
    # Written, so that the join deals prints out anew and can split a fingerprint that very many rows share.
    shared = cut_lineage(prints.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*key))
    members = prints.join(shared, key).select(
        F.col("doc_id").alias("member_id"), "content_key", *key).distinct()
    norm = F.translate(whole_text(docs, text), WHITE, "")
    texts = docs.select(docs[doc_id].alias("doc_id"), norm.alias("norm")).withColumn("key", F.xxhash64("norm"))
    pieces = members.hint("shuffle_hash").join(
        texts, same(texts["doc_id"], members["member_id"]) & (texts["key"] == members["content_key"])
    ).select(*key, "doc_id", "content_key",
             F.posexplode(_chunked(F.col("norm"), rules.chunk_chars)).alias("chunk_no", "chunk"))
    contents = pieces.groupBy(*key, "chunk_no", "chunk").agg(
        F.min(F.struct("content_key", "doc_id")).alias("first"))
    mixed = cut_lineage(contents.groupBy(*key, "chunk_no").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
                        .select(*key).distinct())
    if mixed.isEmpty():
        return prints.withColumn("content_class", F.lit(None).cast("string"))
    # A fingerprint that covers different texts: name each chunk by the first document that has its content.
    named = pieces.join(mixed, key).join(contents.select(
        *key, "chunk_no", "chunk", F.concat_ws(":", F.col("first")["content_key"], F.col("first")["doc_id"]).alias(
            "name")), [*key, "chunk_no", "chunk"])
    spelled = named.distinct().groupBy(*key, "doc_id", "content_key").agg(F.concat_ws(",", F.transform(
        F.sort_array(F.collect_list(F.struct("chunk_no", "name"))), lambda c: c["name"])).alias("content_class"))
    spelled = spelled.withColumnsRenamed({"doc_id": "member_id", "content_key": "member_key"})
    return prints.join(spelled, [*key]).where(
        same(F.col("doc_id"), F.col("member_id")) & (F.col("content_key") == F.col("member_key"))).drop(
        "member_id", "member_key").unionByName(
        prints.join(mixed, key, "left_anti").withColumn("content_class", F.lit(None).cast("string")))


def deduplicate(docs: DataFrame, rules: Polynomials = Polynomials(), doc_id: str = "doc_id",
                text: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, n_chars, content_key."""
    prints = cut_lineage(fingerprints(docs, rules, doc_id, text))
    classed = equality_classes(docs, prints, rules, doc_id, text)
    key = ["n_bytes", "fingerprint", "content_class"]
    rank = F.struct((-F.col("n_chars")).alias("fewer"), F.col("doc_id").isNull().alias("nameless"), "doc_id", "row_id")
    keepers = cut_lineage(classed.groupBy(*key).agg(
        F.min(rank).alias("keeper"), F.count(F.lit(1)).alias("group_size")))
    right = keepers.select(*[F.col(c).alias(f"k_{c}") for c in key], "keeper", "group_size")
    joined = classed.join(right, (F.col("n_bytes") == F.col("k_n_bytes"))
                          & (F.col("fingerprint") == F.col("k_fingerprint"))
                          & same(F.col("content_class"), F.col("k_content_class")))
    return joined.select(
        "doc_id", F.col("keeper")["doc_id"].alias("keep_id"), F.col("group_size").cast("bigint").alias("group_size"),
        (F.col("row_id") == F.col("keeper")["row_id"]).alias("kept"), "text_sha256", "n_chars", "content_key")


def keep_first(docs: DataFrame, rules: Polynomials = Polynomials(), doc_id: str = "doc_id",
               text: str = "text") -> DataFrame:
    """The rows that stay, with the columns they came with."""
    verdicts = cut_lineage(deduplicate(docs, rules, doc_id, text))
    kept = verdicts.where("kept").select(
        F.col("doc_id").alias("kept_id"), F.col("content_key").alias("kept_key"), F.col("n_chars").alias("kept_chars"))
    norm_key = F.xxhash64(F.translate(whole_text(docs, text), WHITE, ""))
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("whole"), docs[doc_id].alias("doc_id"),
                        norm_key.alias("norm_key"), F.length(whole_text(docs, text)).alias("n_chars"))
    stay = kept.hint("shuffle_hash").join(
        whole, same(whole["doc_id"], kept["kept_id"]) & (whole["norm_key"] == kept["kept_key"])
        & (whole["n_chars"] == kept["kept_chars"]))
    repeats = verdicts.groupBy("doc_id", "content_key", "n_chars").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if not repeats.isEmpty():  # rows repeated in full: one of each goes on
        stay = stay.dropDuplicates(["doc_id", "norm_key", "n_chars"])
    return stay.select("whole.*")
