"""Near copies by true similarity: the Jaccard index of the sets of five-word shingles, 0.8 or more.

A SimHash of 64 bits differs in some 10 bits between texts of that similarity, and at such a radius a vantage-point
tree would send every fingerprint everywhere. So the tree links fingerprints of the shingle sets at its own radius
(4 bits), and what it cannot reach comes from MinHash bands: a text has 32 keys of five least hashes each, and two
texts of similarity 0.8 share a key but for 3 cases in a million, fewer above. Among the texts of a key, byte-wide
signatures sort out what is far from similar (an estimate below 0.65, some 5 standard deviations off). What hangs
together so far, by either, is a group, and in groups the sets themselves are compared, every pair of
them. Large groups are cut into blocks, and each pair of blocks is a task of its own. Links join into components, and
of each component exactly one row stays.

Defined results: words are cut at the six white space bytes, only A-Z are lower-cased; a text of fewer than five words
is one shingle, and all texts without words are copies of each other. The row with the smallest doc_id stays, of equal
or null ones any single row. Null doc_ids and repeated rows are rows like others.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from deltawarden.llm.common import give_back, whole_text
from deltawarden.llm.components import components
from deltawarden.llm.simhash import Forest, SimHashRules, linked
from deltawarden.session import cut_lineage


@dataclass(frozen=True)
class CopyRules:
    """shingle: words per shingle; similarity: the least Jaccard index of linked texts.

    bands, band: keys per text and least hashes per key. estimate: the least estimated similarity of texts that are
    compared. The others size tasks: rows and shingles of a shard, shingles of a block of a large group.
    """

    shingle: int = 5
    similarity: float = 0.8
    seed: int = 42
    bands: int = 32
    band: int = 5
    estimate: float = 0.65
    shard_rows: int = 20_000
    shard_shingles: int = 500_000
    block_shingles: int = 65_536
    most_block_shingles: int = 4_000_000


def shingles(data: bytes, rules: CopyRules = CopyRules()) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes; data is UTF-8."""
    from xxhash import xxh64_intdigest

    words = data.lower().split()  # both touch ASCII only
    n = max(1, len(words) - rules.shingle + 1)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words], dtype=np.int64) - 1 if words else np.zeros(1, np.int64)
    starts = [0, *(ends[:n - 1] + 1).tolist()]
    stops = ends[rules.shingle - 1:].tolist() or [len(joined)]
    return np.unique(np.fromiter((xxh64_intdigest(joined[s:e], rules.seed) for s, e in zip(starts, stops, strict=True)),
                                 np.uint64, n))


def least_hashes(hashes: np.ndarray, rules: CopyRules = CopyRules()) -> np.ndarray:
    """The least value of each permutation over the shingles."""
    drawn = np.random.default_rng(rules.seed).integers(0, 1 << 64, (2, rules.bands * rules.band, 1), np.uint64)
    factor, shift = drawn[0] | np.uint64(1), drawn[1]
    least = np.full(len(factor), np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(hashes), 512):
        part = hashes[None, start:start + 512] * factor
        part += shift
        np.minimum(least, part.min(axis=1), out=least)
    return least


def signature(hashes: np.ndarray, rules: CopyRules = CopyRules()) -> tuple[list[int], bytes]:
    """The keys of the bands, and one byte per permutation."""
    from xxhash import xxh64_intdigest

    least = least_hashes(hashes, rules)
    keys = [xxh64_intdigest(part.tobytes(), i) for i, part in enumerate(least.reshape(rules.bands, rules.band))]
    marks = (least * np.uint64(0xFF51AFD7ED558CCD)) >> np.uint64(56)
    return keys, marks.astype(np.uint8).tobytes()


def set_fingerprint(hashes: np.ndarray) -> int:
    """SimHash of a set of shingles: a bit is 1 if it is set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 65536):
        part = hashes[start:start + 65536].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def bucket_links(keys: np.ndarray, marks: np.ndarray, matches: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows that join just the rows of one key joined by pairs with so many equal marks."""
    order = np.argsort(keys, kind="stable")
    start = np.flatnonzero(np.append(True, keys[order][1:] != keys[order][:-1]))
    size = np.diff(np.append(start, len(order)))
    hub = order[np.repeat(start, size)]
    forest = np.where((marks[order] == marks[hub]).sum(axis=1) >= matches, hub, order)  # linked to the first, or alone
    left, right = [order[forest != order]], [hub[forest != order]]
    for begin, n in zip(start[size > 2].tolist(), size[size > 2].tolist(), strict=True):
        rows = order[begin:begin + n]
        inside = Forest(n)
        close = np.flatnonzero(forest[begin:begin + n] == rows[0])
        inside.link(close, np.zeros(len(close), np.int64))
        step = max(1, (1 << 18) // n)
        for at in range(0, n, step):
            if (inside.root == inside.root[0]).all():
                break
            some = np.arange(at, min(n, at + step))
            if len(set(inside.root[some].tolist())) == 1:
                others = np.flatnonzero(inside.root != inside.root[some[0]])
            else:
                others = np.arange(n)
            a, b = np.nonzero((marks[rows[some]][:, None] == marks[rows[others]][None, :]).sum(axis=2) >= matches)
            inside.link(some[a], others[b])
        moved = np.flatnonzero(inside.root != np.arange(n))
        left.append(rows[moved])
        right.append(rows[inside.root[moved]])
    return np.concatenate(left), np.concatenate(right)


def similar_links(sets: list[np.ndarray], side: np.ndarray, similarity: float) -> np.ndarray:
    """Root of each set after linking every pair that is similar enough; sets of one side other than 0 are not compared.

    Shared shingles are counted by the lists of the sets that hold a shingle.
    """
    n, lengths = len(sets), np.array([len(s) for s in sets], np.int64)
    hashes, owner = np.concatenate(sets), np.repeat(np.arange(n), lengths)
    order = np.argsort(hashes, kind="stable")
    new = np.append(True, hashes[order][1:] != hashes[order][:-1])
    start = np.flatnonzero(new)
    held = np.diff(np.append(start, len(order)))
    code = np.empty(len(order), np.int64)
    code[order] = np.cumsum(new) - 1
    holders, first = owner[order], np.cumsum(lengths) - lengths
    forest = Forest(n)
    for at in range(n):
        own = code[first[at]:first[at] + lengths[at]]
        own = own[held[own] > 1]
        shared = np.zeros(n, np.int64)
        for begin in range(0, len(own), 4096):
            some = own[begin:begin + 4096]
            count = held[some]
            place = np.repeat(start[some] - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
            shared += np.bincount(holders[place], minlength=n)
        found = np.flatnonzero(shared[:at])
        found = found[(side[found] != side[at]) | (side[found] == 0)]
        both = shared[found]
        found = found[both / (lengths[found] + lengths[at] - both) >= similarity]
        forest.link(found, np.full(len(found), at))
    return forest.root


def signatures(rows: DataFrame, rules: CopyRules) -> DataFrame:
    """row_id, doc_id, set_key (128 bits), size, keys, marks, bits (the set's SimHash) of rows with row_id, doc_id and text."""
    from xxhash import xxh3_128_digest

    key = rows.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(2).cast(pa.binary()):
                found = shingles(text.as_buffer().to_pybytes(), rules)
                out.append((xxh3_128_digest(found.tobytes()), len(found), *signature(found, rules), set_fingerprint(found)))
            if out:
                names, sizes, keys, marks, bits = zip(*out, strict=True)
                flat = np.array(keys, np.uint64).view(np.int64).ravel()
                ends = np.arange(0, len(flat) + 1, rules.bands, dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(names, pa.binary()), pa.array(sizes, pa.int64()),
                     pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array(marks, pa.binary()),
                     pa.array(np.array(bits, np.uint64).view(np.int64))],
                    ["row_id", "doc_id", "set_key", "size", "keys", "marks", "bits"])
        give_back()

    return rows.select("row_id", "doc_id", "text").mapInArrow(
        work, f"row_id bigint, doc_id {key}, set_key binary, size bigint, keys array<bigint>, marks binary, bits bigint")


def tree_links(heads: DataFrame) -> DataFrame:
    """a, b: links of vertices whose fingerprints the vantage-point tree links, or are equal; heads: vertex, bits."""
    named = cut_lineage(heads.groupBy("bits").agg(F.min("vertex").alias("named")))
    far = linked(named.select("bits"), SimHashRules())
    ends = far.join(named.select(F.col("bits").alias("a"), F.col("named").alias("of_a")), "a").join(
        named.select(F.col("bits").alias("b"), F.col("named").alias("of_b")), "b").select(
        F.col("of_a").alias("a"), F.col("of_b").alias("b"))
    equal = heads.select("vertex", "bits").join(named, "bits").where("vertex <> named").select(
        F.col("vertex").alias("a"), F.col("named").alias("b"))
    return ends.unionByName(equal)


def candidates(heads: DataFrame, rules: CopyRules) -> DataFrame:
    """a, b: links of vertices that share a key and are similar by estimate; heads: a table of vertex, keys, marks."""
    keys = heads.select("vertex", F.explode("keys").alias("key"))
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    met = cut_lineage(keys.join(shared, "key"))
    shards = max(1, math.ceil(met.count() / rules.shard_rows))
    whole = met.join(heads.select("vertex", "marks"), "vertex").withColumn("shard", F.pmod(
        F.xxhash64("key"), F.lit(shards)))
    permutations = rules.bands * rules.band
    matches = math.ceil(permutations * (rules.estimate + (1 - rules.estimate) / 256))

    def search(rows: pa.Table) -> pa.Table:
        vertex = rows.column("vertex").to_numpy()
        marks = np.frombuffer(b"".join(rows.column("marks").to_pylist()), np.uint8).reshape(-1, permutations)
        a, b = bucket_links(rows.column("key").to_numpy(), marks, matches)
        pairs = np.unique(np.stack([vertex[a], vertex[b]], axis=1), axis=0)
        del marks, a, b
        give_back()
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return whole.groupBy("shard").applyInArrow(search, "a bigint, b bigint")


def verified(rows: DataFrame, heads: DataFrame, groups: DataFrame, rules: CopyRules) -> DataFrame:
    """a, b: links that join just what the pairs of similar texts in a group join; groups: vertex, component."""
    sized = cut_lineage(groups.join(heads.select("vertex", "size"), "vertex"))
    sizes = sized.groupBy("component").agg(F.sum("size").alias("total"))
    blocks = F.greatest(F.least(F.lit(16), F.ceil(F.col("total") / rules.block_shingles)),
                        F.ceil(F.col("total") / rules.most_block_shingles)).cast("int")
    total = sized.agg(F.sum("size")).first()[0] or 0
    shards = max(1, math.ceil(total / rules.shard_shingles))
    placed = sized.join(sizes, "component").select("vertex", "component", blocks.alias("blocks")).withColumn(
        "block", F.pmod(F.xxhash64("vertex"), F.col("blocks")).cast("int"))
    texts = placed.join(rows.select(F.col("row_id").alias("vertex"), "text"), "vertex")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t.as_buffer().to_pybytes(), rules).tobytes() for t in batch.column(4).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(found, pa.binary())],
                                             ["vertex", "component", "blocks", "block", "found"])
        give_back()

    sets = texts.select("vertex", "component", "blocks", "block", "text").mapInArrow(
        work, "vertex bigint, component bigint, blocks int, block int, found binary")
    # Each block meets every block of its group; in a task of two blocks only pairs across them are compared.
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    pairs = sets.select("vertex", "component", "blocks", "block", other, "found")
    task = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("component"), F.lit(shards))).otherwise(
        F.xxhash64("component", F.least("block", "other"), F.greatest("block", "other")))
    side = F.when(F.col("block") == F.col("other"), 0).when(F.col("block") < F.col("other"), 1).otherwise(2)

    def search(rows_: pa.Table) -> pa.Table:
        vertex = rows_.column("vertex").to_numpy()
        held = [np.frombuffer(x, np.uint64) for x in rows_.column("found").to_pylist()]
        root = similar_links(held, rows_.column("side").to_numpy(), rules.similarity)
        moved = np.flatnonzero(root != np.arange(len(root)))
        del held
        give_back()
        return pa.table({"a": vertex[moved], "b": vertex[root[moved]]})

    return pairs.select("vertex", task.alias("task"), side.alias("side"), "found").groupBy("task").applyInArrow(
        search, "a bigint, b bigint")


def keep_one(docs: DataFrame, rules: CopyRules = CopyRules(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Exactly one row of each component of similar texts, with the columns it came with."""
    numbered = cut_lineage(docs.select(
        F.monotonically_increasing_id().alias("row_id"), F.struct(*[docs[c] for c in docs.columns]).alias("whole"),
        docs[doc_id].alias("doc_id"), whole_text(docs, text).alias("text")))
    prints = cut_lineage(signatures(numbered, rules))
    rank = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "row_id")
    heads = cut_lineage(prints.groupBy("set_key").agg(
        F.min("row_id").alias("vertex"), F.min(rank).alias("best"), *[F.first(c).alias(c) for c in (
            "size", "keys", "marks", "bits")]))
    groups = components(candidates(heads, rules).unionByName(tree_links(heads)))
    member = components(verified(numbered, heads, groups, rules))
    named = heads.select(F.col("vertex").alias("head"), "best").join(
        member, F.col("head") == F.col("vertex"), "left").select(F.coalesce("component", "head").alias("component"), "best")
    kept = named.groupBy("component").agg(F.min("best").alias("best")).select(F.col("best.row_id").alias("kept_row"))
    return kept.hint("shuffle_hash").join(numbered, F.col("kept_row") == F.col("row_id")).select("whole.*")
