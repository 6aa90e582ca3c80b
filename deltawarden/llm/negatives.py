"""Hard negatives of anchors, found exactly through a multiway hyperplane tree with stored distance ranges.

Components become whole numbers, a row's score is its inner product with the anchor. One more component,
sqrt(largest norm^2 - norm^2), puts all rows on one sphere; an anchor gets zero there. Then a score s is the distance
sqrt(|anchor|^2 + largest norm^2 - 2 s), and a window of scores is an annulus around the anchor.

A node of the tree has several split points; a row goes to the nearest one, so neighbours are parted by hyperplanes.
For each split point and each subtree of the node the least and the largest distance between the two are kept, over
all rows. An anchor at distance d from a split point skips every subtree that no window can meet: whose rows are
farther than the outer radius or nearer than the inner one by the triangle inequality. Leaves are compared row by row.
The tree is fitted on a bounded sample, which places the split points only; every row is in it and every range covers
every row. A cell larger than ``block_rows`` is stored in several blocks.

A search first asks an anchor's own cell; what it finds there narrows the windows for all other cells. Anchors meet a
block in parts of ``query_rows``, so no task holds more than one block and one part.

Defined results: rows with a null label, a null vector or a null or non-finite component take no part; vectors of
different lengths are filled up with zeros; components beyond 2^25 / 256 count as that, which keeps sums of 4,096
products exact; equal scores come in the order of the id, null ids last; repeated rows are rows of their own, and an
anchor is no positive of itself alone; an anchor without positives has no result. Other columns are left alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from deltawarden.session import cut_lineage

LIMIT = 1 << 25
FAR = 1 << 62


@dataclass(frozen=True)
class NegativeRules:
    """positives of an anchor, negatives of each pair; a negative's score lies between low and high hundredths of the
    positive's. anchors: every so many ids. fanout: the most split points of a node. sample_rows: rows the tree is
    fitted on."""

    positives: int = 5
    negatives: int = 3
    low: int = 50
    high: int = 95
    anchors: int = 50
    scale: int = 256
    fanout: int = 32
    sample_rows: int = 16384
    block_rows: int = 2048
    query_rows: int = 4096
    seed: int = 11


def quantised(rows: DataFrame, scale: int = 256, vec_id: str = "vec_id", vector: str = "embedding",
              label: str = "label") -> DataFrame:
    """row_id, vec_id, label, v (whole numbers), written once; rows that take no part are left out."""
    def whole(x: Column) -> Column:
        value = x.cast("double")
        return F.when(value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")),
                      F.floor(F.least(F.greatest(value, F.lit(-LIMIT / scale)), F.lit(LIMIT / scale)) * scale)
                      .cast("int"))

    taken = rows.select(rows[vec_id].cast("bigint").alias("vec_id"), rows[label].cast("bigint").alias("label"),
                        F.transform(rows[vector], whole).alias("v"))
    sound = F.col("label").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull())
    return cut_lineage(taken.where(sound).withColumn("row_id", F.monotonically_increasing_id()))


def _matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """Rows of whole numbers, filled up with zeros to the width."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(sizes), max(width, int(sizes.max(initial=0)))))
    at = np.repeat(np.arange(len(sizes)), sizes)
    out[at, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _far_apart(sample: np.ndarray, many: int, random: np.random.Generator) -> np.ndarray:
    """Split points: of three times as many candidates, each time the one farthest from those chosen."""
    candidates = np.unique(sample[random.permutation(len(sample))[:3 * many]], axis=0)
    chosen = [0]
    nearest = ((candidates - candidates[0]) ** 2).sum(axis=1)
    while len(chosen) < many and nearest.max() > 0:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, ((candidates - candidates[chosen[-1]]) ** 2).sum(axis=1))
    return candidates[chosen]


def _distances(rows: np.ndarray, points: np.ndarray) -> np.ndarray:
    squares = (rows ** 2).sum(axis=1)[:, None] + (points ** 2).sum(axis=1)[None] - 2 * rows @ points.T
    return np.sqrt(np.maximum(squares, 0))


@dataclass
class RangeTree:
    """nodes[0] is the root, nodes[1 + j] stands below its split point j; cells are numbered through from the left.

    low[n][i, j], high[n][i, j]: distances between split point i and the rows of subtree j of node n.
    """

    width: int
    norm: float  # largest squared norm of a row
    nodes: list[np.ndarray]
    low: list[np.ndarray]
    high: list[np.ndarray]

    @staticmethod
    def fit(sample: np.ndarray, width: int, norm: float, fanout: int, seed: int) -> RangeTree:
        tree = RangeTree(width, norm, [], [], [])
        random = np.random.default_rng(seed)
        lifted = tree.lift(sample) if len(sample) else np.zeros((1, width + 1))
        tree.nodes.append(_far_apart(lifted, fanout, random))
        nearest = _distances(lifted, tree.nodes[0]).argmin(axis=1)
        for j in range(len(tree.nodes[0])):
            tree.nodes.append(_far_apart(lifted[nearest == j], fanout, random))
        for node in tree.nodes:
            tree.low.append(np.full((len(node), len(node)), np.inf))
            tree.high.append(np.full((len(node), len(node)), -np.inf))
        return tree

    @property
    def first_cell(self) -> np.ndarray:
        return np.cumsum([0, *map(len, self.nodes[1:])])

    def lift(self, rows: np.ndarray) -> np.ndarray:
        rest = np.maximum(self.norm - (rows ** 2).sum(axis=1), 0)
        return np.hstack([rows, np.sqrt(rest)[:, None]])

    def home(self, rows: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, np.ndarray, np.ndarray]]]:
        """Each row's cell; and (node, subtree, least, largest distance to each split point of the node)."""
        lifted, first, ranges = self.lift(rows), self.first_cell, []
        distances = _distances(lifted, self.nodes[0])
        top = distances.argmin(axis=1)
        cells = np.zeros(len(rows), np.int64)
        for j in np.unique(top):
            at = np.flatnonzero(top == j)
            ranges.append((0, int(j), distances[at].min(axis=0), distances[at].max(axis=0)))
            below = _distances(lifted[at], self.nodes[1 + j])
            sub = below.argmin(axis=1)
            cells[at] = first[j] + sub
            for k in np.unique(sub):
                own = below[sub == k]
                ranges.append((1 + int(j), int(k), own.min(axis=0), own.max(axis=0)))
        return cells, ranges

    def reach(self, query: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Cells that may hold a row whose score with the query lies in one of the windows."""
        far, near = self._radius(query, low), self._radius(query, high)
        lifted, slack = np.append(query, 0.0)[None], 1e-6 * math.sqrt(max(self.norm, 1.0))

        def open_subtrees(node: int) -> np.ndarray:
            at = _distances(lifted, self.nodes[node])[0][:, None]
            least = np.maximum(at - self.high[node], self.low[node] - at).max(axis=0)
            most = (at + self.high[node]).min(axis=0)
            meets = (least[:, None] <= far[None] + slack) & (most[:, None] >= near[None] - slack)
            return np.flatnonzero(meets.any(axis=1))

        first = self.first_cell
        return np.concatenate([np.zeros(0, np.int64), *(first[j] + open_subtrees(1 + j) for j in open_subtrees(0))])

    def _radius(self, query: np.ndarray, scores: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum((query ** 2).sum() + self.norm - 2 * scores.astype(np.float64), 0))


@dataclass
class Index:
    """blocks: row_id, vec_id, label, v, cell, block; parts[cell]: blocks the cell is stored in."""

    tree: RangeTree
    blocks: DataFrame
    parts: np.ndarray
    anchors: DataFrame  # rows of the index with their cell


def build(rows: DataFrame, rules: NegativeRules = NegativeRules()) -> Index:
    """The index over all quantised rows."""
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("width"), F.max(F.aggregate(
        "v", F.lit(0.0), lambda total, x: total + x.cast("double") * x)).alias("norm")).first()
    width, order = facts["width"] or 0, F.xxhash64("vec_id", F.lit(rules.seed))
    sample = rows.orderBy(order, "row_id").limit(rules.sample_rows).select("v").toArrow()["v"]
    fanout = min(rules.fanout, max(2, math.ceil(math.sqrt(facts["n"] / rules.block_rows))))
    tree = RangeTree.fit(_matrix(sample, width), width, facts["norm"] or 0.0, fanout, rules.seed)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells, _ = tree.home(_matrix(batch.column("v"), width))
            yield batch.append_column("cell", pa.array(cells))

    schema = ", ".join(f"{name} {kind}" for name, kind in rows.dtypes)
    placed = cut_lineage(rows.mapInArrow(place, f"{schema}, cell bigint"))

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["node", "subtree", "point", "low", "high"]
        for batch in batches:
            if batch.num_rows:
                _, found = tree.home(_matrix(batch.column("v"), width))
                flat = [(n, j, i, lo, hi) for n, j, least, most in found
                        for i, (lo, hi) in enumerate(zip(least, most, strict=True))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*flat, strict=True)], names)

    # At most (1 + fanout) * fanout^2 ranges.
    found = placed.select("v").mapInArrow(ranges, "node bigint, subtree bigint, point bigint, low double, high double")
    for r in found.groupBy("node", "subtree", "point").agg(
            F.min("low").alias("low"), F.max("high").alias("high")).toLocalIterator():
        tree.low[r["node"]][r["point"], r["subtree"]] = r["low"]
        tree.high[r["node"]][r["point"], r["subtree"]] = r["high"]

    counts = placed.groupBy("cell").count()  # at most fanout^2 cells
    sizes = {r["cell"]: r["count"] for r in counts.collect()}
    parts = np.array([math.ceil(sizes.get(c, 0) / rules.block_rows) for c in range(int(tree.first_cell[-1]))], np.int64)
    spare = counts.select(F.col("cell").alias("of_cell"),
                          F.ceil(F.col("count") / rules.block_rows).cast("bigint").alias("parts"))
    blocks = placed.join(F.broadcast(spare), F.col("cell") == F.col("of_cell")).withColumn(
        "part", F.pmod(F.xxhash64("row_id"), F.col("parts"))).drop("of_cell", "parts")
    return Index(tree, cut_lineage(blocks), parts, placed)


def _best(scores: np.ndarray, allowed: np.ndarray, most: int) -> np.ndarray:
    """Places of the highest scores among the allowed; equal scores in their order."""
    at = np.flatnonzero(allowed)
    if len(at) > most:
        last = np.partition(scores[at], len(at) - most)[len(at) - most]
        at = at[scores[at] >= last]
    return at[np.argsort(-scores[at], kind="stable")][:most]


def _compare(width: int, same_label: bool, most: int):
    """The exact leaf: the best rows of a block in each window of each anchor."""
    def compare(queries: pa.Table, rows: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if queries.num_rows and rows.num_rows:
            ids = rows["vec_id"].fill_null(np.iinfo(np.int64).max).to_numpy()
            order = np.lexsort((rows["row_id"].to_numpy(), ids))
            rows = rows.take(pa.array(order))
            ids, labels, row_ids = rows["vec_id"].to_pylist(), rows["label"].to_numpy(), rows["row_id"].to_numpy()
            right, left = _matrix(rows["v"], width), _matrix(queries["v"], width)
            if np.abs(left).max(initial=0) * np.abs(right).max(initial=0) * max(width, 1) >= 2 ** 53:
                right, left = right.astype(np.int64), left.astype(np.int64)
            own, own_label = queries["row_id"].to_numpy(), queries["label"].to_numpy()
            windows = queries["windows"].to_pylist()
            for start in range(0, len(left), 256):
                for i, scores in enumerate(left[start:start + 256] @ right.T, start):
                    fit = ((labels == own_label[i]) == same_label) & (row_ids != own[i])
                    for window in windows[i]:
                        inside = fit & (scores >= window["low"]) & (scores <= window["high"])
                        found += [(own[i], window["slot"], row_ids[k], ids[k], int(scores[k]))
                                  for k in _best(scores, inside, most)]
        columns = list(zip(*found, strict=True)) or [()] * 5
        return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), *(
            pa.array(c, pa.int64()) for c in columns[2:])], ["anchor", "slot", "row_id", "vec_id", "score"])

    return compare


def _first(hits: DataFrame, most: int) -> DataFrame:
    """The best hits of each window, with their rank from 1."""
    order = Window.partitionBy("anchor", "slot").orderBy(
        F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "row_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def _ask(index: Index, queries: DataFrame, rules: NegativeRules, same_label: bool, most: int, own: bool) -> DataFrame:
    """Hits in the anchors' own cells, or in all others that their windows can reach."""
    tree, parts = index.tree, index.parts
    split = max(1, math.ceil(queries.count() / rules.query_rows))
    kept = ["row_id", "label", "v", "windows"]
    kinds = dict(queries.dtypes)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors, homes = _matrix(batch.column("v"), tree.width), batch.column("cell").to_numpy()
            source, cells = [], []
            for i, windows in enumerate(batch.column("windows").to_pylist()):
                if own:
                    reached = homes[i:i + 1]
                else:
                    low, high = (np.array([w[side] for w in windows], np.int64) for side in ("low", "high"))
                    reached = tree.reach(vectors[i], low, high)
                    reached = reached[reached != homes[i]]
                cells.append(np.repeat(reached, parts[reached]))
                cells[-1] = np.stack([cells[-1], np.concatenate(
                    [np.zeros(0, np.int64), *(np.arange(parts[c]) for c in reached)])])
                source.append(np.full(cells[-1].shape[1], i))
                if sum(map(len, source)) >= 8192:
                    yield sent(batch, source, cells)
                    source, cells = [], []
            if source:
                yield sent(batch, source, cells)

    def sent(batch: pa.RecordBatch, source: list[np.ndarray], cells: list[np.ndarray]) -> pa.RecordBatch:
        cell, part = np.concatenate(cells, axis=1)
        out = batch.select(kept).take(pa.array(np.concatenate(source).astype(np.int64)))
        return out.append_column("cell", pa.array(cell)).append_column("part", pa.array(part))

    schema = ", ".join(f"{name} {kinds[name]}" for name in kept) + ", cell bigint, part bigint"
    asked = queries.mapInArrow(meet, schema).withColumn(
        "piece", F.pmod(F.xxhash64("row_id"), F.lit(split).cast("bigint")))
    stored = index.blocks.withColumn("piece", F.explode(
        F.sequence(F.lit(0).cast("bigint"), F.lit(split - 1).cast("bigint"))))
    key = ["cell", "part", "piece"]
    hits = asked.groupBy(*key).cogroup(stored.groupBy(*key)).applyInArrow(
        _compare(tree.width, same_label, most),
        "anchor bigint, slot int, row_id bigint, vec_id bigint, score bigint")
    return cut_lineage(_first(hits, most).drop("rank"))


def search(index: Index, queries: DataFrame, same_label: bool, most: int,
           rules: NegativeRules = NegativeRules()) -> DataFrame:
    """anchor, slot, row_id, vec_id, score, rank: the first ``most`` rows in every window of every anchor.

    queries: row_id, label, v, cell, windows (array of slot, low, high; scores from low to high count).
    """
    near = _ask(index, queries, rules, same_label, most, True)
    # Where the own cell has enough, nothing below its last one is wanted.
    floors = near.groupBy("anchor", "slot").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("floor")).where(
        F.col("n") >= most).groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("slot", "floor"))).alias("floors"))
    narrowed = queries.join(floors, F.col("row_id") == F.col("anchor"), "left").withColumn(
        "windows", F.transform("windows", lambda w: F.struct(
            w["slot"].alias("slot"), F.greatest(w["low"], F.col("floors")[w["slot"]]).alias("low"),
            w["high"].alias("high")))).select(*queries.columns)
    rest = _ask(index, cut_lineage(narrowed), rules, same_label, most, False)
    return cut_lineage(_first(near.unionByName(rest), most))


def hard_negatives(rows: DataFrame, rules: NegativeRules = NegativeRules()) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; rows come from ``quantised``."""
    index = build(rows, rules)
    anchors = cut_lineage(index.anchors.where(F.pmod("vec_id", F.lit(rules.anchors)) == 0))
    everything = F.array(F.struct(F.lit(1).alias("slot"), F.lit(-FAR).alias("low"), F.lit(FAR).alias("high")))
    pairs = search(index, anchors.withColumn("windows", everything), True, rules.positives, rules)

    def hundredths(share: int, up: bool) -> Column:
        """share / 100 of the score, rounded up or down in whole numbers."""
        sign = "-" if up else ""
        product = f"{sign}score * {share}L"
        return F.expr(f"{sign}(({product} - pmod({product}, 100L)) div 100L)")

    windows = pairs.groupBy(F.col("anchor").alias("of_anchor")).agg(F.collect_list(F.struct(
        F.col("rank").cast("int").alias("slot"), hundredths(rules.low, True).alias("low"),
        hundredths(rules.high, False).alias("high"))).alias("windows"))  # as many as positives
    asked = cut_lineage(anchors.join(windows, F.col("row_id") == F.col("of_anchor")).drop("of_anchor"))
    found = search(index, asked, False, rules.negatives, rules)
    positive = pairs.select(
        F.col("anchor").alias("of_anchor"), F.col("rank").cast("int").alias("of_slot"),
        F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    named = anchors.select(F.col("row_id").alias("anchor_row"), F.col("vec_id").alias("anchor_id"))
    return (found.join(positive, (F.col("anchor") == F.col("of_anchor")) & (F.col("slot") == F.col("of_slot")))
            .join(named, F.col("anchor") == F.col("anchor_row"))
            .select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score",
                    F.col("score").alias("negative_score")))
