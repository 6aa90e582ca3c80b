"""The quality classifier: features by hand, held-out accuracy, odd rows."""

import random
import zlib
from collections import Counter
from dataclasses import replace

import numpy as np

from deltawarden.llm import subwords

RULES = subwords.SubwordRules(buckets=1 << 14, steps=8000, chunk=50)
SCHEMA = "doc_id bigint, text string, score double, predicted int"
LABELS = "doc_id bigint, quality int, toxic int"


def by_hand(text, rules):
    """Features of a text one by one."""
    words = [w for w in text.translate(subwords._SPACES).split(b" ") if w]
    found = Counter([subwords.end_bucket(rules)])
    for word in words:
        own, buckets = subwords.word_features([word], subwords.word_hashes([word]), rules)
        signs = len(word.decode()) + 2
        assert len(own) == 1 + sum(max(0, signs - n + 1) for n in range(rules.shortest, rules.longest + 1))
        found.update(buckets.tolist())
    for n in range(2, rules.word_ngrams + 1):
        for i in range(len(words) - n + 1):
            last = dict(subwords.word_ngrams(subwords.word_hashes(words[i:i + n]), rules))[n]
            found.update(last.tolist())
    return found


def test_features_of_parts_are_those_of_the_whole():
    r = random.Random(1)
    for ngrams in (1, 2, 3):
        rules = replace(RULES, word_ngrams=ngrams)
        for _ in range(20):
            text = "".join(r.choice(["a", "été ", " ", "b\t", "漢字 ", "xyz", "\n"]) for _ in range(60)).encode()
            found, often = subwords.feature_counts(text, rules)
            assert dict(zip(found.tolist(), often.tolist(), strict=True)) == by_hand(text, rules)


def test_scores_many_texts_like_one():
    r = random.Random(2)
    texts = [" ".join(r.choice(["on", "of", "to", "x" * 9]) for _ in range(r.randint(0, 200))).encode() for _ in range(30)]
    for ngrams in (1, 2, 3):
        rules = replace(RULES, word_ngrams=ngrams, kept_words=3)
        logits = np.random.default_rng(ngrams).normal(size=(rules.buckets, 3))
        model = subwords.SubwordModel(rules, (0, 1, 2), logits)
        for text, got in zip(texts, subwords.Scorer(model).probabilities(texts), strict=True):
            found, often = subwords.feature_counts(text, rules)
            z = often @ logits[found] / often.sum()
            assert np.allclose(got, np.exp(z) / np.exp(z).sum())


def corpus(r, many):
    good = ["river", "stone", "walk", "green", "house", "over", "the", "and"]
    for i in range(many):
        words = [r.choice(good) for _ in range(r.randint(10, 80))]
        quality = int(r.random() < 0.8)
        if not quality:
            words = [w + r.choice(["***", "$$$"]) for w in words] if r.random() < 0.5 else [
                w for w in words for _ in range(4)]
        yield i, " ".join(words), quality


def test_held_out_accuracy_and_odd_rows(spark):
    rows = list(corpus(random.Random(3), 400))
    docs = [(i, text, 9.0, 9) for i, text, _ in rows]
    docs += [(None, "river stone", 0.0, 0), (401, None, 0.0, 0), (402, "", 0.0, 0), (403, "walk " * 20_000, 0.0, 0),
             (0, docs[0][1], 0.0, 0), (404, "w" * 200_000, 0.0, 0)]
    labels = [(i, q, 0) for i, _, q in rows] + [(0, None, 0), (None, 0, 0), (9999, 0, 0), (1, 0, 1), (1, 1, 0)]
    run = lambda: subwords.quality_scores(
        spark.createDataFrame(docs, SCHEMA).repartition(3), spark.createDataFrame(labels, LABELS), rules=RULES).collect()
    got = run()
    assert len(got) == len(docs)
    truth = {i: q for i, _, q in rows}
    held = [row for row in got if row["held_out"] and row["doc_id"] in truth]
    assert all(row["held_out"] == (zlib.crc32(str(row["doc_id"]).encode()) % 5 == 0)
               for row in got if row["doc_id"] is not None)
    assert len(held) > 50 and np.mean([truth[row["doc_id"]] == row["predicted"] for row in held]) > 0.95
    assert all(0 <= row["score"] <= 1 and row["predicted"] == (row["score"] >= 0.3) for row in got)
    assert len({row["score"] for row in got if row["doc_id"] in (401, 402)}) == 1
    key = lambda row: (str(row["doc_id"]), row["score"])
    assert sorted(map(key, got)) == sorted(map(key, run()))


def test_labels_of_held_out_rows_change_nothing(spark):
    rows = list(corpus(random.Random(4), 120))
    docs = spark.createDataFrame([(i, text, 0.0, 0) for i, text, _ in rows], SCHEMA)
    labels = [(i, q, 0) for i, _, q in rows]
    turned = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q, 0) for i, q, _ in labels]
    score = lambda found: {r["doc_id"]: r["score"] for r in subwords.quality_scores(
        docs, spark.createDataFrame(found, LABELS), rules=RULES).collect()}
    assert score(labels) == score(turned)


def test_sample_is_bounded(spark):
    rows = list(corpus(random.Random(5), 60))
    docs = spark.createDataFrame([(i % 5, text, 0.0, 0) for i, text, _ in rows], SCHEMA)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)], LABELS)
    assert len(subwords.training_rows(docs, labels, "quality", replace(RULES, sample_rows=7))) == 7
    small = subwords.training_rows(docs, labels, "quality", replace(RULES, sample_entries=400))
    assert 0 < sum(len(found) for _, found, _ in small) <= 400


def test_no_labels_and_no_documents(spark):
    docs = spark.createDataFrame([(1, "a b", 0.0, 0)], SCHEMA)
    none = spark.createDataFrame([], LABELS)
    assert subwords.quality_scores(docs, none, rules=RULES).first()["score"] == 0.5
    assert subwords.quality_scores(docs.limit(0), none, rules=RULES).collect() == []
