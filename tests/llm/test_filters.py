"""Compression bands, exact duplicates, near duplicates: small cases against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import zstandard
from pyspark.sql import types as T

from deltawarden.llm import compression, components, fingerprints, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, source string, Verdict string, parts string"


def prose(random_, n):
    vowels, others = "aeiou", "bcdfglmnprst"
    return " ".join("".join(random_.choice(others) + random_.choice(vowels) for _ in range(random_.randint(1, 4)))
                    for _ in range(n))


@pytest.fixture
def docs(spark):
    r = random.Random(5)
    base = prose(r, 300)
    words = base.split()
    rows = [
        (0, None, "a"), (1, "", "a"), (2, " \t\n", None), (3, base, "a"), (4, base.replace(" ", "  ", 3), "b"),
        (5, base + "\n", None), (6, " ".join(["spam and eggs"] * 300), "a"), (7, prose(r, 30), "a"),
        (8, "line one here\n" * 40 + base, "a"), (9, "".join(r.choice("0123456789abcdef#$&") for _ in range(3000)), "a"),
        (10, base, "a"), (10, base, "a"), (None, base, "a"), (11, " ".join(words[:150] + ["x"] + words[151:]), "a"),
        (12, prose(r, 9000), "c"), (13, "é ü ß 漢字 " * 20, "a"), (14, " ".join(
            hashlib.sha256(str(i).encode()).hexdigest() for i in range(120)), "a"), (15, prose(r, 9000), "c"),
        (16, "One two three four", "a"), (17, "one TWO three four", "a")]
    return spark.createDataFrame([(i, t, s, "v", "p") for i, t, s in rows], SCHEMA)


def brute_verdict(text):
    text = text or ""
    words = WORD.findall(text)
    grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), failed)


def test_verdicts(docs):
    small = docs.where("doc_id not in (12, 15) or doc_id is null")
    judged, name = compression.judge(small)
    assert name == "verdict_" and judged.columns[:-1] == docs.columns
    for row in judged.collect():
        v = row[name]
        assert (v.n_words, v.word_chars, v.n_symbols, v.n_dup_lines, v.n_repeat_words, v.base_failed) == \
            brute_verdict(row.text), row.doc_id
        assert v.kept == (v.reason is None) and (not v.base_failed or not v.kept)
        data = (row.text or "").encode()
        if data:
            assert v.ratio == pytest.approx(len(zstandard.ZstdCompressor(level=3).compress(data)) / len(data))
    reasons = {r.doc_id: r[name].reason for r in judged.collect()}
    assert reasons[3] is None and reasons[4] is None and reasons[11] is None
    assert reasons[0] == reasons[7] == "too_short" and reasons[6] == "repeated_windows"
    kept = compression.keep_good(docs)
    assert kept.columns == docs.columns
    assert {12, 3, 10, 11} <= {r.doc_id for r in kept.collect()}


def test_bands_reject_noise_and_repetition_without_base_failure():
    rules, packer = compression.CompressionRules(), zstandard.ZstdCompressor(level=3)
    r = random.Random(1)

    def judge(text):
        return compression.judge_text(text, text.encode(), len(text), rules, packer)[-2:]

    noise = " ".join("".join(chr(r.randint(33, 126)) for _ in range(12)) for _ in range(400))
    assert judge(noise) == ("incompressible", False)
    # Words differ each time, so no window repeats, yet almost nothing is new.
    counted = " ".join(f"chapter{i} verse{i}" for i in range(2000))
    assert judge(counted)[1] is False
    assert judge(prose(r, 2000)) == (None, True)
    half = prose(r, 3500) + " " + " ".join(f"aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa{i}" for i in range(300))
    assert judge(half) == ("repetitive_chunks", False)


def test_bands_tell_labelled_texts_apart():
    """Texts that pass the base rules: all of quality 1 stay, and the method itself rejects most of the others."""
    import pyarrow.parquet as pq

    folder, rules = "/root/testdata/sf0.01", compression.CompressionRules()
    packer = zstandard.ZstdCompressor(level=3)
    quality = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{folder}/labels.parquet").to_pylist()}
    kept = {0: [], 1: []}
    symbols = []
    for row in pq.read_table(f"{folder}/documents.parquet").to_pylist():
        text = row["text"] or ""
        v = compression.judge_text(text, text.encode(), len(text), rules, packer)
        if not v[5] and row["doc_id"] in quality:
            kept[quality[row["doc_id"]]].append(v[-1])
        if not v[5] and v[2] > 2 * v[0] and len(text.encode()) >= 2048:
            symbols.append(v[-1])
    assert len(kept[1]) > 300 and all(kept[1])
    assert len(kept[0]) > 20 and 2 * sum(kept[0]) < len(kept[0])
    assert len(symbols) > 5 and 4 * sum(symbols) < len(symbols)


def test_huge_vocabulary_windows():
    words = [str(i % 2_000_003).encode() for i in range(2_000_010)]
    assert compression.repeated_words(words) == 14


def brute_groups(rows):
    groups = {}
    for r in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r.text or ""), []).append(r)
    out = []
    for norm, members in groups.items():
        keep = min(members, key=lambda r: (-len(r.text or ""), r.doc_id is None, r.doc_id or 0))
        out += [(r.doc_id, keep.doc_id, len(members), hashlib.sha256(norm.encode()).hexdigest()) for r in members]
    return sorted(out, key=str)


@pytest.mark.parametrize("rules", [
    fingerprints.Polynomials(), fingerprints.Polynomials(chunk_chars=700),
    # A fingerprint of one weak field: texts of equal length collide and are told apart by their chunks.
    fingerprints.Polynomials(chunk_chars=700, fields=((2, 1),))])
def test_exact_duplicates(spark, docs, rules):
    more = docs.unionByName(spark.createDataFrame(
        [(100 + i, t, "a", "", "") for i, t in enumerate(
            ["ab", "ba", "a b", "cd", "x" * 1500, "x" * 1499 + "y", "y" + "x" * 1499, "x" * 1500])], SCHEMA))
    found = fingerprints.deduplicate(more, rules).collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found], key=str) == \
        brute_groups(more.collect())
    stay = [r.doc_id for r in found if r.kept]
    assert len(stay) == len({r.text_sha256 for r in found}) and 5 not in stay and 4 in stay
    kept = fingerprints.keep_first(more, rules)
    assert kept.columns == more.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(stay)


def test_one_of_repeated_rows_stays(spark):
    rows = spark.createDataFrame([(1, "a b", "", "", "")] * 3 + [(None, "c", "", "", "")] * 2, SCHEMA)
    assert sorted(r.text for r in fingerprints.keep_first(rows).collect()) == ["a b", "c"]


def test_polynomial_is_composable():
    fields = fingerprints.Polynomials().fields
    data = bytes(random.Random(3).randrange(256) for _ in range(200_000))
    whole = fingerprints.polynomials(data, fields)
    for cut in (0, 1, 65536, 70_001, len(data)):
        left, right = fingerprints.polynomials(data[:cut], fields), fingerprints.polynomials(data[cut:], fields)
        assert whole == [(a * pow(b, len(data) - cut, p) + c) % p for a, c, (p, b) in zip(left, right, fields)]
    p, b = fields[0]
    value = 0
    for byte in data:
        value = (value * b + byte) % p
    assert whole[0] == value


def brute_simhash(text):
    import xxhash
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(bits, link):
    """vertex -> smallest vertex it reaches."""
    todo, out = set(bits), {}
    while todo:
        group, front = set(), [min(todo)]
        while front:
            x = front.pop()
            if x in group:
                continue
            group.add(x)
            front += [y for y in bits if (x ^ y).bit_count() <= link]
        out |= dict.fromkeys(group, min(group))
        todo -= group
    return out


def test_near_duplicates(spark, docs):
    rows = docs.collect()
    prints = {id(r): brute_simhash(r.text) for r in rows}
    component = brute_components(set(prints.values()), 4)
    first = {}
    for r in rows:
        if r.doc_id is not None:
            c = component[prints[id(r)]]
            first[c] = min(first.get(c, r.doc_id), r.doc_id)
    want = sorted([(r.doc_id, prints[id(r)], first[component[prints[id(r)]]]) for r in rows], key=str)
    got = simhash.near_duplicates(docs)
    assert sorted([(r.doc_id, r.bits % (1 << 64), r.component_id) for r in got.collect()], key=str) == want
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == set(first.values()) | {None}


@pytest.mark.parametrize("shard_rows", [40, 300, 100_000])
def test_tree_loses_no_link(spark, shard_rows):
    r = np.random.default_rng(2)
    centres = r.integers(0, 1 << 63, 60, dtype=np.uint64)
    rows = set(r.integers(0, 1 << 63, 700, dtype=np.uint64).tolist())
    for c in centres.tolist():
        for _ in range(12):
            x = c
            for bit in r.choice(64, r.integers(0, 4), replace=False):
                x ^= 1 << int(bit)
            rows.add(x)
    signed = [x - (1 << 64) if x >> 63 else x for x in rows]
    frame = spark.createDataFrame([(x,) for x in signed], "bits bigint")
    rules = simhash.SimHashRules(shard_rows=shard_rows, sample_rows=500)
    found = {e.vertex: e.component for e in components.components(simhash.linked(frame, rules)).collect()}
    want = brute_components(rows, 4)
    groups = {}
    for x in rows:
        groups.setdefault(want[x], set()).add(x - (1 << 64) if x >> 63 else x)
    for group in groups.values():
        if len(group) == 1:
            assert not group & found.keys()
        else:
            assert {found.get(x) for x in group} == {min(group)}


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, x) for x in range(101, 160)] + [(7, 7)]
    found = dict(components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect())
    assert found == {i: 0 for i in range(51)} | {i: 100 for i in range(100, 160)}


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert compression.keep_good(none).count() == 0
    assert fingerprints.keep_first(none).count() == 0
    assert fingerprints.deduplicate(none).count() == 0
    assert simhash.near_duplicates(none).count() == 0
    assert simhash.keep_one(none).schema == T._parse_datatype_string(SCHEMA)
