"""Near copies of the pipeline: planted copies of known similarity, against brute force over all pairs."""

import random
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from deltawarden.llm import resemblance

SCHEMA = "doc_id bigint, text string, row_id string"


def brute_set(text):
    words = (text or "").lower().split()
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4)))


def alike(a, b):
    return len(a & b) / len(a | b)


def groups_of(texts):
    """Smallest index that each text reaches over pairs of similarity 0.8 or more."""
    sets, root = [brute_set(t) for t in texts], list(range(len(texts)))
    for i in range(len(sets)):
        for j in range(i):
            if root[i] != root[j] and alike(sets[i], sets[j]) >= 0.8:
                low, high = sorted((root[i], root[j]))
                root = [low if x == high else x for x in root]
    return root


def edited(r, words, vocabulary, low, high):
    """A copy with similarity between low and high."""
    while True:
        out = list(words)
        for at in r.sample(range(len(out)), r.randint(1, max(1, len(out) // 20))):
            out[at] = r.choice(vocabulary)
        if low <= alike(brute_set(" ".join(words)), brute_set(" ".join(out))) < high:
            return " ".join(out)


def planted(seed, most):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefghiklmnoprstu") for _ in range(r.randint(2, 8))) for _ in range(3000)]
    clean = [[r.choice(vocabulary) for _ in range(r.randint(100, most))] for _ in range(60)]
    bands = [(0.8, 0.85), (0.85, 0.9), (0.9, 0.95), (0.95, 1.0)]
    copies = [edited(r, w, vocabulary, *bands[i % 4]) for i, w in enumerate(clean[:40])]
    far = [edited(r, w, vocabulary, 0.6, 0.79) for w in clean[40:50]]
    return [" ".join(w) for w in clean], copies, far


def test_stage_finds_copies_at_all_similarities_and_leaves_clean_texts(spark):
    clean, copies, far = planted(3, 600)
    rows = [(i, t, "x") for i, t in enumerate(clean)] + [(100 + i, t, "y") for i, t in enumerate(copies)]
    rows += [(200 + i, t, "z") for i, t in enumerate(far)]
    near = dict(corpus_pipeline.STAGES)["near"]
    kept = near(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert kept.columns == ["doc_id", "text", "row_id"]
    assert sorted(r.doc_id for r in kept.collect()) == [*range(60), *range(200, 210)]


def test_one_row_of_each_group_stays_with_null_and_repeated_ids(spark):
    clean, copies, _ = planted(5, 200)
    rows = [(None, clean[i], "a") for i in range(20)] + [(None, copies[i], "b") for i in range(20)]
    rows += [(7, clean[30], "c")] * 3 + [(7, clean[31], "d"), (8, clean[31].upper(), "e"), (7, copies[31], "f")]
    rows += [(9, None, "g"), (9, "", "h"), (None, " \n", "i"), (10, "two words", "j"), (11, "Two  words", "k")]
    kept = resemblance.keep_one(spark.createDataFrame(rows, SCHEMA)).collect()
    want = Counter(groups_of([x[1] for x in rows]))
    of = dict(zip([(x[0], x[1]) for x in rows], groups_of([x[1] for x in rows])))
    assert len(kept) == len(want) == 20 + 1 + 1 + 1 + 1 and len({of[r.doc_id, r.text] for r in kept}) == len(want)
    assert {r.doc_id for r in kept} == {None, 7, 9, 10}


@pytest.mark.parametrize("rules", [resemblance.CopyRules(), resemblance.CopyRules(
    shard_rows=50, shard_shingles=1000, block_shingles=2000)])
def test_large_group_of_uneven_copies(spark, rules):
    """Copies of one text that are mostly not similar to each other: all pairs decide, in blocks too."""
    r = random.Random(9)
    base = [f"w{r.randint(0, 500)}" for _ in range(150)]
    texts = [" ".join(base)]
    for _ in range(120):
        out = list(base)
        for _ in range(r.randint(1, 9)):
            out[r.randrange(len(out))] = f"n{r.randint(0, 10**6)}"
        texts.append(" ".join(out))
    r.shuffle(texts)
    rows = [(i, t, "") for i, t in enumerate(texts)]
    kept = resemblance.keep_one(spark.createDataFrame(rows, SCHEMA).repartition(3), rules)
    want = set(groups_of(texts))
    assert 5 < len(want) < 100 and {x.doc_id for x in kept.collect()} == want


def test_signatures_are_shared_as_often_as_they_should():
    r = np.random.default_rng(4)
    rules = resemblance.CopyRules()
    missed, matches = 0, []
    for _ in range(300):
        common, a, b = (r.integers(0, 1 << 63, n, dtype=np.uint64) for n in (160, 20, 20))
        (keys, marks), (other_keys, other_marks) = (resemblance.signature(np.unique(np.concatenate([common, x])), rules)
                                                    for x in (a, b))
        missed += not any(x == y for x, y in zip(keys, other_keys))
        matches.append(sum(x == y for x, y in zip(marks, other_marks)) / len(marks))
    assert not missed and min(matches) > rules.estimate and abs(np.mean(matches) - 0.8) < 0.01


def test_the_tree_links_what_its_fingerprints_link(spark):
    random_hashes = np.random.default_rng(3).integers(0, 1 << 64, 999, np.uint64)
    brute = sum(1 << i for i in range(64) if 2 * sum((int(h) >> i) & 1 for h in random_hashes) > len(random_hashes))
    assert resemblance.set_fingerprint(random_hashes) == brute
    bits = [0, 0b1111, 0b111111111, -1, -1, 1 << 40 | 0b1111 << 20]
    heads = spark.createDataFrame(list(enumerate(bits)), "vertex bigint, bits bigint")
    got = {frozenset((r["a"], r["b"])) for r in resemblance.tree_links(heads).collect()}
    assert got == {frozenset((0, 1)), frozenset((3, 4))}
