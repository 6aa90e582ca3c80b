"""Hard negatives against brute force, and what the tree's ranges promise."""

import math
import random

import numpy as np
import pytest

from deltawarden.llm import negatives

RULES = negatives.NegativeRules(anchors=5, fanout=4, sample_rows=64, block_rows=16, query_rows=8)
SCHEMA = "vec_id bigint, embedding array<float>, label int, score double, cell string"


def brute(rows, rules):
    sound = []
    for place, (vec_id, vector, label, *_) in enumerate(rows):
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        bound = negatives.LIMIT // rules.scale
        sound.append((place, vec_id, [math.floor(rules.scale * min(max(x, -bound), bound)) for x in vector], label))
    found = []
    for place, vec_id, v, label in sound:
        if vec_id is None or vec_id % rules.anchors:
            continue
        scored = [(-sum(a * b for a, b in zip(v, w, strict=False)), math.inf if other is None else other, k, l)
                  for k, other, w, l in sound if k != place]
        scored.sort(key=lambda s: s[:3])
        for score, other, _, l in [s for s in scored if s[3] == label][:rules.positives]:
            inside = [s for s in scored if s[3] != label and
                      rules.low * -score <= 100 * -s[0] <= rules.high * -score][:rules.negatives]
            name = lambda x: None if x == math.inf else x
            found += [(vec_id, name(other), rank, name(s[1]), -score, -s[0]) for rank, s in enumerate(inside, 1)]
    return found


def compare(spark, rows, rules=RULES):
    frame = spark.createDataFrame(rows, SCHEMA)
    got = [tuple(r) for r in negatives.hard_negatives(negatives.quantised(frame, rules.scale), rules).collect()]
    assert sorted(got, key=str) == sorted(brute(rows, rules), key=str)
    return got


def vectors(r, n, width, groups=0):
    centres = [[r.gauss(0, 1) for _ in range(width)] for _ in range(groups)]
    for i in range(n):
        at = r.choice(centres) if groups and r.random() < 0.8 else [0] * width
        yield [float(np.float32(c + r.gauss(0, 0.3 if groups else 1))) for c in at]


@pytest.mark.parametrize("groups", [0, 3])
def test_same_as_brute_force(spark, groups):
    r = random.Random(groups)
    rows = [(i, v, r.choice([1, 1, 2, 3]), 0.0, "x") for i, v in enumerate(vectors(r, 150, 6, groups))]
    assert len(compare(spark, rows)) > 100


def test_odd_rows(spark):
    r = random.Random(3)
    rows = [(i, v, r.randint(0, 2), 0.0, "x") for i, v in enumerate(vectors(r, 60, 4))]
    rows += [(0, rows[0][1], 0, None, None), (0, rows[0][1], 1, 1.0, None)]  # repeated ids and rows
    rows += [(70, rows[5][1], None, 0.0, ""), (75, None, 1, 0.0, ""), (80, [1.0, None], 1, 0.0, ""),
             (85, [1.0, float("nan")], 1, 0.0, ""), (90, [float("inf")], 2, 0.0, ""), (95, [], 1, 0.0, ""),
             (100, [0.5], 1, 0.0, ""), (None, rows[7][1], 1, 0.0, ""), (105, [1e30, 1.0, 2.0, 0.0, -3.0], 2, 0.0, "")]
    rows += [(200 + i, [0.5, 0.25, 0.0, 0.0], i % 2, 0.0, "") for i in range(40)]  # ties, one vector in many rows
    compare(spark, rows)


def test_empty_table(spark):
    assert compare(spark, []) == []
    assert compare(spark, [(0, [1.0], 1, 0.0, "")]) == []


def test_ranges_cover_every_row_and_skip_cells(spark):
    r = random.Random(9)
    rows = [(i, v, i % 3, 0.0, "") for i, v in enumerate(vectors(r, 400, 5, 6))]
    index = negatives.build(negatives.quantised(spark.createDataFrame(rows, SCHEMA)), RULES)
    placed = index.blocks.select("v", "cell", "part").collect()
    assert len(placed) == 400
    sizes = {}
    for row in placed:
        sizes[row["cell"], row["part"]] = sizes.get((row["cell"], row["part"]), 0) + 1
    assert max(sizes.values()) <= 3 * RULES.block_rows
    data, cells = np.array([row["v"] for row in placed], float), np.array([row["cell"] for row in placed])
    skipped = 0
    for query in data[:40]:
        scores = data @ query
        for low in np.percentile(scores, [50, 90, 99]):
            high = low + 0.05 * abs(low)
            reached = index.tree.reach(query, np.array([low]), np.array([high]))
            inside = (scores >= low) & (scores <= high)
            assert set(cells[inside]) <= set(reached)
            skipped += len(set(cells)) - len(reached)
    assert skipped > 0


def test_sums_beyond_53_bits_are_exact(spark):
    big = float(negatives.LIMIT // 256)
    rows = [(0, [big, big, 1.0], 1, 0.0, ""), (1, [big, big, 0.5], 1, 0.0, ""), (2, [big / 2, big, 0.25], 2, 0.0, ""),
            (3, [big * 0.75, big, 0.125], 2, 0.0, "")]
    assert len(compare(spark, rows)) == 2


