"""Phrases against a count by hand, and what a summary promises."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from deltawarden.llm import phrases

SCHEMA = "doc_id bigint, text string, lang string, phrase string, score int"


def brute(rows, rules):
    counts, totals = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for n in range(1, rules.longest + 1):
                for i in range(len(words) - n + 1):
                    counts[lang, tuple(words[i:i + n])] += 1
    candidates = {key: a for key, a in counts.items() if len(key[1]) > 1 and a >= rules.threshold}
    out = []
    for (lang, words), a in candidates.items():
        score, k = min((10 ** 6 * a * a // (counts[lang, words[:k]] * counts[lang, words[k:]]), k)
                       for k in range(1, len(words)))
        covered = any(other == lang and len(longer) > len(words) and 100 * b >= rules.covered * a and any(
            longer[i:i + len(words)] == words for i in range(len(longer))) for (other, longer), b in candidates.items())
        if not covered:
            out.append((lang, score, a, " ".join(words), counts[lang, words[:k]], counts[lang, words[k:]]))
    out.sort(key=lambda r: (r[0], -r[1], -r[2], r[3].encode()))
    seen, result = Counter(), []
    for lang, score, a, phrase, left, right in out:
        seen[lang] += 1
        if seen[lang] <= rules.first:
            result.append((lang, seen[lang], phrase, a, left, right, totals[lang], score))
    return result


def compare(spark, rows, rules):
    found = phrases.collocations(spark.createDataFrame(rows, SCHEMA).repartition(3), rules)
    got = sorted(tuple(r) for r in found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())
    assert got == sorted(brute(rows, rules))
    return got


def made_up(r, many):
    words = ["a", "B", "Été", "of", "the", "x-y", "漢字", "O'N", "z" * 30]
    for i in range(many):
        text = "".join(r.choice(words) + r.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", " ! "])
                       for _ in range(r.randint(0, 60)))
        yield i, text, r.choice(["en", "en", "de", None, "und"]), "p", 1


@pytest.mark.parametrize("longest, chunk", [(3, 10 ** 6), (3, 7), (4, 25), (2, 1)])
def test_same_as_a_count_by_hand(spark, longest, chunk):
    rules = phrases.PhraseRules(longest=longest, threshold=4, covered=60, first=40, bits=1 << 14, chunk=chunk)
    rows = list(made_up(random.Random(chunk), 120))
    rows += [(1, None, "en", None, None), (2, "", "de", None, None), (None, "of the of the", None, "", 0)] * 3
    rows += [(5, rows[0][1], rows[0][2], "", 0)] * 30
    assert len(compare(spark, rows, rules)) > 30


def test_a_full_bitmap_changes_nothing(spark):
    rows = list(made_up(random.Random(5), 60))
    small = phrases.PhraseRules(threshold=3, bits=8)  # every n-gram passes the filter
    assert compare(spark, rows, small) == compare(spark, rows, phrases.PhraseRules(threshold=3, bits=1 << 20))


def test_empty_table_and_long_text(spark):
    assert compare(spark, [], phrases.PhraseRules()) == []
    long = [(1, "one two " * 30_000 + "w" * 100_000, "en", "", 0)]
    assert len(compare(spark, long, phrases.PhraseRules(chunk=1000))) > 0


def test_counts_beyond_64_bits(spark):
    f = 3_000_000_000
    counts = spark.createDataFrame([("en", 1, "a", 2 * f), ("en", 1, "b", f + 7), ("en", 2, "a b", f)],
                                   "lang string, n int, phrase string, f bigint")
    assert phrases.scored(counts).first()["score"] == 10 ** 6 * f * f // (2 * f * (f + 7))


def test_no_frequent_item_is_lost_in_merged_summaries():
    r = np.random.default_rng(1)
    for capacity in (5, 20, 200):
        items = r.zipf(1.3, 20_000) % 3000
        true = Counter(items.tolist())
        merged = phrases.Summary(capacity)
        for part in np.array_split(items, 13):
            keys, counts = np.unique(part, return_counts=True)
            one = phrases.Summary(capacity)
            one.merge(keys.astype(np.uint32), counts)
            merged.merge(one.keys, one.counts, one.taken_off)
        assert len(merged.keys) <= capacity and merged.taken_off <= len(items) / (capacity + 1)
        held = dict(zip(merged.keys.tolist(), merged.counts.tolist(), strict=True))
        assert all(held.get(k, 0) <= f <= held.get(k, 0) + merged.taken_off for k, f in true.items())
        threshold = len(items) // capacity + 1
        assert {k for k, f in true.items() if f >= threshold} <= set(merged.survivors(threshold).tolist())


def test_keys_and_counts_are_packed_and_unpacked():
    keys = np.array([0, 1, 255, 65536, 2 ** 32 - 1], np.uint32)
    assert phrases.unpacked_keys(phrases.packed_keys(keys)).tolist() == keys.tolist()
    assert phrases.unpacked_keys(phrases.packed_keys(keys[:0])).tolist() == []
    dense = np.arange(0, 4_000_000, 1000, dtype=np.uint32)
    packed = phrases.packed_keys(dense)
    assert packed[len(dense) * 2:] == bytes(len(dense) * 2)  # two planes of zeros


def test_ngrams_are_shuffled_and_not_written_besides(spark, monkeypatch):
    def no_table(df):
        raise AssertionError("the n-grams of the first pass were written to a table")

    monkeypatch.setattr(phrases, "cut_lineage", no_table)
    texts = spark.createDataFrame([("en", "a b c. " * 12), ("en", "d e"), ("de", "a b")], "lang string, text string")
    marked = phrases.survivor_bits(texts, phrases.PhraseRules())
    assert np.unpackbits(marked).sum() == 6  # a, b, c, a b, b c, a b c
