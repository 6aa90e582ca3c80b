"""Near duplicates by SimHash fingerprints, joined through a vantage-point tree.

A fingerprint has 64 bits, set by the majority of the hashes of a text's shingles. Texts that share a fingerprint are
one vertex from then on. A tree of vantage points, fitted on a bounded sample, cuts the fingerprints into shards: each
inner node has a vantage point and a radius, and a fingerprint goes left if its Hamming distance to the point is at
most the radius. Each fingerprint is stored in one shard and asked in every shard that the ball of the link distance
around it can reach; the triangle inequality tells which. Inside a shard the same is done again with shells: points
whose distances to a vantage point differ by more than the link distance cannot be linked, and points close enough
to it are linked through it without a comparison. A shard returns a spanning forest of its links, not the pairs.
Components over all forests are the result. Every fingerprint is indexed and asked; the sample only places the cuts.

Defined results: a null or empty text, or one without words, has fingerprint zero and links like any other; of a
component the smallest doc_id names it, and null doc_ids are named by it but never name it unless all are null;
repeated rows appear as often as they come. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from deltawarden.llm.common import same, whole_text
from deltawarden.llm.components import components
from deltawarden.session import cut_lineage


@dataclass(frozen=True)
class SimHashRules:
    """shingle: words per shingle; link: the most differing bits of linked fingerprints.

    shard_rows: fingerprints a shard is meant to store. sample_rows: the most fingerprints the tree is fitted on.
    """

    shingle: int = 4
    seed: int = 42
    link: int = 4
    shard_rows: int = 16384
    sample_rows: int = 65536


def fingerprint(data: bytes, shingle: int = 4, seed: int = 42) -> int:
    """64 bits as an unsigned number; data is UTF-8, only A-Z are lower-cased."""
    from xxhash import xxh64_intdigest

    words = data.lower().split()  # both touch ASCII only
    if not words:
        return 0
    joined = b" ".join(words)
    starts = [0]
    for word in words[:-1]:
        starts.append(starts[-1] + len(word) + 1)
    n = max(1, len(words) - shingle + 1)
    # A shingle ends one byte before the word after it starts.
    ends = [s - 1 for s in starts[shingle:]] + [len(joined)]
    bits, start = np.zeros(64, np.int64), 0
    while start < n:
        stop = min(n, start + 65536)
        hashes = np.array([xxh64_intdigest(joined[s:e], seed)
                           for s, e in zip(starts[start:stop], ends[start:stop], strict=True)], "<u8")
        flags = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        bits += flags.sum(axis=0, dtype=np.int64)
        start = stop
    return int(np.packbits(2 * bits > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, rules: SimHashRules = SimHashRules(), doc_id: str = "doc_id",
                 text: str = "text") -> DataFrame:
    """doc_id, bits (the fingerprint as a signed 64-bit number)."""
    @F.arrow_udf("bigint")
    def bits(texts: pa.Array) -> pa.Array:
        values = np.fromiter((fingerprint(t.as_buffer().to_pybytes(), rules.shingle, rules.seed)
                              for t in texts.cast(pa.binary())), np.uint64, len(texts))
        return pa.array(values.view(np.int64))

    return docs.select(docs[doc_id].alias("doc_id"), bits(whole_text(docs, text)).alias("bits"))


@dataclass(frozen=True)
class VantageTree:
    """A complete binary tree in heap order: node i has children 2 i + 1 and 2 i + 2; leaves are the shards."""

    points: np.ndarray  # uint64, one per inner node
    radii: np.ndarray
    depth: int

    @staticmethod
    def fit(sample: np.ndarray, depth: int, seed: int = 7) -> VantageTree:
        """Cut the sample at its median distance, level by level. Points are drawn at random, far from each other."""
        random = np.random.default_rng(seed)
        inner = (1 << depth) - 1
        points, radii = np.zeros(inner, np.uint64), np.full(inner, 32, np.int64)
        parts = {0: sample}
        for node in range(inner):
            part = parts.pop(node, sample[:0])
            if len(part):
                tries = random.choice(part, min(len(part), 8), replace=False)
                spread = [np.bitwise_count(part ^ t).astype(np.int64).std() for t in tries]
                points[node] = tries[int(np.argmax(spread))]
                distance = np.bitwise_count(part ^ points[node]).astype(np.int64)
                radii[node] = int(np.median(distance))
                parts[2 * node + 1] = part[distance <= radii[node]]
                parts[2 * node + 2] = part[distance > radii[node]]
        return VantageTree(points, radii, depth)

    def home(self, values: np.ndarray) -> np.ndarray:
        """The shard that stores each value."""
        node = np.zeros(len(values), np.int64)
        for _ in range(self.depth):
            far = np.bitwise_count(values ^ self.points[node]).astype(np.int64) > self.radii[node]
            node = 2 * node + 1 + far
        return node - ((1 << self.depth) - 1)

    def reach(self, values: np.ndarray, link: int) -> tuple[np.ndarray, np.ndarray]:
        """(index, shard) for each shard that may store a value within the link distance."""
        index, node = np.arange(len(values)), np.zeros(len(values), np.int64)
        for _ in range(self.depth):
            distance = np.bitwise_count(values[index] ^ self.points[node]).astype(np.int64)
            near, far = distance - link <= self.radii[node], distance + link > self.radii[node]
            index = np.concatenate([index[near], index[far]])
            node = np.concatenate([2 * node[near] + 1, 2 * node[far] + 2])
        return index, node - ((1 << self.depth) - 1)


class Forest:
    """Union-find over the rows of a shard; roots are kept flat, so that whole blocks can be compared at once."""

    def __init__(self, size: int):
        self.root = np.arange(size)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        """Join the sets of a[i] and b[i]."""
        while True:
            ra, rb = self.root[a], self.root[b]
            open_pairs = ra != rb
            if not open_pairs.any():
                return
            high, low = np.maximum(ra, rb)[open_pairs], np.minimum(ra, rb)[open_pairs]
            np.minimum.at(self.root, high, low)
            while True:  # flatten
                flat = self.root[self.root]
                if np.array_equal(flat, self.root):
                    break
                self.root = flat


def link_shard(values: np.ndarray, stored: np.ndarray, link: int, small: int = 512) -> np.ndarray:
    """Root row of each row, after linking every pair within the distance of which one row is stored.

    values are distinct. Rows that are asked only meet the stored ones; two asked rows meet where one is stored.
    """
    forest = Forest(len(values))

    def compare(left: np.ndarray, right: np.ndarray) -> None:
        for start in range(0, len(left), 128):
            some = left[start:start + 128]
            roots = forest.root[right]
            if (forest.root[some] == roots[0]).all() and (roots == roots[0]).all():
                continue  # all in one set already
            a, b = np.nonzero(np.bitwise_count(values[some][:, None] ^ values[right][None, :]) <= link)
            forest.link(some[a], right[b])

    todo = [(np.arange(len(values)), np.flatnonzero(stored), 0)]
    while todo:
        left, right, level = todo.pop()
        if not len(left) or not len(right):
            continue
        if len(left) <= small or len(right) <= small or level == 4:
            compare(left, right)
            continue
        # The middle of the stored rows by value: the same choice in every run.
        point = right[len(right) // 2]
        to_left = np.bitwise_count(values[left] ^ values[point]).astype(np.int64)
        to_right = np.bitwise_count(values[right] ^ values[point]).astype(np.int64)
        close = np.concatenate([left[to_left <= link], right[to_right <= link]])
        forest.link(close, np.full(len(close), point))
        order = np.argsort(to_right, kind="stable")
        ranked, right = to_right[order], right[order]
        for shell in np.unique(to_left):
            begin, end = np.searchsorted(ranked, [shell - link, shell + link + 1])
            todo.append((left[to_left == shell], right[begin:end], level + 1))
    return forest.root


def linked(vertices: DataFrame, rules: SimHashRules = SimHashRules()) -> DataFrame:
    """Edges a, b (bits) that connect just the fingerprints that links connect; vertices: a table of distinct bits."""
    count = vertices.count()
    depth = max(0, int(np.ceil(np.log2(max(1, count / rules.shard_rows)))))
    # A sample of the hash order, with the same expected size from any input; it places cuts and decides no link.
    share = min(1.0, rules.sample_rows / max(1, count))
    drawn = vertices.where(F.pmod(F.xxhash64("bits"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).limit(
        2 * rules.sample_rows)
    sample = np.sort(np.array([r["bits"] for r in drawn.collect()], np.int64)).view(np.uint64)
    tree = VantageTree.fit(sample, depth)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            home = tree.home(values)
            for start in range(0, len(values), 1024):  # a value may reach many shards
                part = values[start:start + 1024]
                index, shard = tree.reach(part, rules.link)
                # Of two linked values one is asked in the shard of the other; the earlier shard need not be asked.
                ahead = shard >= home[start:start + 1024][index]
                index, shard = index[ahead], shard[ahead]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard), pa.array(part[index].view(np.int64)),
                     pa.array(shard == home[start:start + 1024][index])], ["shard", "bits", "stored"])

    def search(key: tuple, rows: pa.Table) -> pa.Table:
        values = rows.column("bits").to_numpy().view(np.uint64)
        order = np.argsort(values)
        values, stored = values[order], rows.column("stored").to_numpy()[order]
        root = link_shard(values, stored, rules.link)
        moved = np.flatnonzero(root != np.arange(len(root)))
        return pa.table({"a": values[moved].view(np.int64), "b": values[root[moved]].view(np.int64)})

    routed = vertices.select("bits").mapInArrow(route, "shard bigint, bits bigint, stored boolean")
    return routed.groupBy("shard").applyInArrow(search, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, rules: SimHashRules = SimHashRules(), doc_id: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """doc_id, bits, component_id for every row."""
    prints = cut_lineage(fingerprints(docs, rules, doc_id, text))
    vertices = cut_lineage(prints.groupBy("bits").agg(F.min("doc_id").alias("first_id")))
    edges = linked(vertices, rules)
    member = components(edges)
    named = vertices.join(member, vertices["bits"] == member["vertex"], "left").select(
        "bits", "first_id", F.coalesce("component", "bits").alias("component"))
    named = cut_lineage(named)
    names = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    of_print = named.join(names, "component").select(F.col("bits").alias("of_bits"), "component_id")
    return prints.join(of_print, same(prints["bits"], of_print["of_bits"])).select("doc_id", "bits", "component_id")


def keep_one(docs: DataFrame, rules: SimHashRules = SimHashRules(), doc_id: str = "doc_id",
             text: str = "text") -> DataFrame:
    """The document of each component that names it, with the columns it came with; rows without doc_id stay."""
    kept = near_duplicates(docs, rules, doc_id, text).where(F.col("doc_id") == F.col("component_id")).select(
        F.col("doc_id").alias("kept_id")).distinct()
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("whole"), docs[doc_id].alias("doc_id"))
    stay = kept.hint("shuffle_hash").join(whole.where("doc_id IS NOT NULL"), F.col("kept_id") == F.col("doc_id"))
    nameless = whole.where("doc_id IS NULL")
    return stay.select("whole.*").unionByName(nameless.select("whole.*"))
