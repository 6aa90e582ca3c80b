"""Bin completion, token pieces, mixing, the pipeline: against brute force and exact round trips."""

import math
import random
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from deltawarden.llm import mixing, packing, simhash, tokens

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def check_packing(counts, packing_, capacity):
    used = Counter()
    for many, filling in packing_.fillings:
        assert sum(s * c for s, c in filling) <= capacity
        for s, c in filling:
            used[s] += many * c
    assert used == Counter({s: n for s, n in counts.items() if n})


def fewest(pieces, capacity):
    """Sequences of an optimal packing, by trying all placements of a few pieces."""
    best = len(pieces)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(pieces):
            best = len(rooms)
            return
        for k in range(len(rooms)):
            if rooms[k] >= pieces[i] and rooms[k] not in rooms[:k]:
                place(i + 1, rooms[:k] + [rooms[k] - pieces[i]] + rooms[k + 1:])
        place(i + 1, [*rooms, capacity - pieces[i]])

    place(0, [])
    return best


def test_small_packings_are_minimal():
    r = random.Random(4)
    for _ in range(150):
        pieces = sorted((r.choice([r.randint(1, 30), r.randint(8, 15)]) for _ in range(r.randint(1, 11))), reverse=True)
        counts = Counter(pieces)
        found = packing.complete_bins(counts, 30)
        check_packing(counts, found, 30)
        assert found.sequences == fewest(pieces, 30) >= found.bound


def test_search_beats_best_fit():
    r = random.Random(8)
    won = 0
    for _ in range(300):
        rooms = []
        for _ in range(12):  # cut full sequences into pieces, so that a packing without waste exists
            left = 100
            while left:
                piece = min(left, r.randint(15, 55))
                rooms.append(piece)
                left -= piece
        counts = Counter(rooms)
        found = packing.complete_bins(counts, 100)
        check_packing(counts, found, 100)
        greedy = sum(m for m, _ in packing.best_fit(counts, 100))
        assert 12 <= found.sequences <= greedy
        won += found.sequences < greedy
    assert won > 20


def test_large_histogram():
    r = np.random.default_rng(5)
    sizes = np.minimum(2048, 1 + r.lognormal(5.5, 1.2, 2_000_000)).astype(int)
    counts = Counter(sizes.tolist())
    found = packing.complete_bins(counts, 2048)
    check_packing(counts, found, 2048)
    assert found.sequences <= math.ceil(sizes.sum() / 2048) * 1.001


def waste(filling, room):
    return room - sum(s * c for s, c in filling)


def test_fillings_come_least_waste_first():
    r = random.Random(2)
    for _ in range(200):
        counts = Counter(r.randint(2, 20) for _ in range(r.randint(1, 9)))
        listed = packing.fillings(counts, 25, 25, 10_000)
        assert [waste(f, 25) for f in listed] == sorted(waste(f, 25) for f in listed)
        assert all(c <= counts[s] for f in listed for s, c in f)
        pieces, best = list(counts.elements()), 0
        for chosen in range(1 << len(pieces)):
            size = sum(p for i, p in enumerate(pieces) if chosen >> i & 1)
            best = max(best, size if size <= 25 else 0)
        assert waste(listed[0], 25) == 25 - best


@pytest.mark.parametrize("times", [1, 3, 12, 1000])
def test_search_ends_at_any_size(times):
    """The same search on any multiple of a histogram; its work is bounded, so is its time."""
    r = np.random.default_rng(17)
    counts = {s: n * times for s, n in Counter(np.minimum(2048, 1 + r.lognormal(6, 1.3, 20_000)).astype(int).tolist()).items()}
    started = time.process_time()
    found = packing.complete_bins(counts, 2048)
    assert time.process_time() - started < 30
    check_packing(counts, found, 2048)
    assert found.bound <= found.sequences <= sum(m for m, _ in packing.best_fit(counts, 2048))
    assert found.steps < 4_100_000


def test_search_that_runs_out_proves_its_packing():
    counts = {7: 3, 6: 2, 5: 2, 4: 1}
    found = packing.complete_bins(counts, 12)
    assert found.minimal and found.sequences == fewest([7, 7, 7, 6, 6, 5, 5, 4], 12)
    # Small pieces in plenty make dominance tests long; they end undecided.
    many = {s: 40 for s in range(1, 60)}
    check_packing(many, packing.complete_bins(many, 211, max_steps=200_000), 211)


def test_dominated_fillings_are_left_out():
    # {5} fills as much as {3, 2} with a piece that is harder to place.
    assert packing.fillings({5: 1, 3: 1, 2: 1}, 6, 6, 100)[0] == ((5, 1),)
    assert packing.fillings({6: 1, 3: 2}, 6, 6, 100) == [((6, 1),)]
    assert ((3, 1), (2, 1)) not in packing.fillings({5: 1, 3: 1, 2: 1}, 5, 5, 100)


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


TEXTS = [
    None, "", " ", "Hello  World\n\nit's O'Neil's 42nd <|endoftext|> x", "é́ ﬁ ǆ İstanbul ΑΣ Σ. 漢字仮名  a b\x1cc",
    "tab\tand\x0bvertical\x85next ́combining", "word " * 9000, "x" * 5000, "don't<|startoftext|>we'll", "a\r\nb"]


def test_ids_are_those_of_the_tokenizer(tokenizer):
    table = tokens.word_ids("word_bpe_49k.json", limit=5)
    for text in TEXTS[1:]:
        want = tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(tokens.text_ids(text, table), "<u4").tolist() == want
    r = random.Random(7)
    alphabet = "abzA9'.,%(<|> -éÉß漢\u0301…½²_"
    for _ in range(3000):
        text = "".join(r.choice(alphabet) for _ in range(r.randint(1, 12)))
        want = tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(tokens.text_ids(text, table), "<u4").tolist() == want, text
    plain = tokens.word_ids("word_bpe_49k.json", plain_specials=True)
    assert 49407 not in np.frombuffer(tokens.text_ids("<|endoftext|> a<|endoftext|>b", plain), "<u4")


def check_placed(rows, capacity):
    by_sequence = {}
    for row in rows:
        by_sequence.setdefault(row.sequence_id, []).append(row)
    for members in by_sequence.values():
        at = 0
        for row in sorted(members, key=lambda r: r.offset):
            assert row.offset == at
            at += row.length
        assert at <= capacity
    return by_sequence


def test_packed_documents(spark, tokenizer):
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "", "", 0), (None, "no id", "", "", 0)]
    rows += [(100 + i, " ".join(["of"] * i), "", "", 0) for i in range(300)]
    frame = spark.createDataFrame(rows, SCHEMA)
    placed = packing.pack_documents(frame, capacity=256, keep_ids=True)
    got = placed.collect()
    want = []
    for doc_id, text, *_ in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(doc_id, k, s, len(ids[s:s + 256]), zlib.crc32(ids[s:s + 256].tobytes()))
                 for k, s in enumerate(range(0, len(ids), 256))]
    assert sorted([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got], key=str) == sorted(want, key=str)
    by_sequence = check_placed(got, 256)
    assert len(by_sequence) == packing.lower_bound(Counter(w[3] for w in want), 256)
    whole = {r.sequence_id: r for r in packing.sequences(placed).collect()}
    for number, members in by_sequence.items():
        joined = b"".join(bytes(r.ids) for r in sorted(members, key=lambda r: r.offset))
        assert bytes(whole[number].ids) == joined and whole[number].n_tokens == len(joined) // 4
    assert packing.pack_documents(frame.limit(0)).count() == 0


def brute_targets(sizes, most=3):
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    total, full, open_ = sum(sizes.values()), {}, set(sizes)
    while open_:
        level = (total - sum(full.values())) / sum(weights[s] for s in open_)
        over = {s for s in open_ if level * weights[s] > most * sizes[s]}
        if not over:
            return full | {s: level * weights[s] for s in open_}
        full |= {s: most * sizes[s] for s in over}
        open_ -= over
    return full


def mixing_rows(seed, sources):
    r = random.Random(seed)
    rows = []
    for s, docs in sources.items():
        for _ in range(docs):
            rows.append((len(rows), " ".join(["w"] * r.randint(0, 40)), "en", s, 7))
    return rows


@pytest.mark.parametrize("sources", [
    {"a": 300, "b": 100, "c": 50, None: 80}, {"tiny": 3, "huge": 900, "mid": 60}, {None: 10}, {"a": 50, "B": 50, "é": 50,
                                                                                          "z": 400, "zz": 3, "": 5}])
def test_mix(spark, sources):
    rows = mixing_rows(1, sources)
    rows += [(0, None, "en", next(iter(sources)), 7), rows[1], (None, "w w", "en", next(iter(sources)), 7)]
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("size", F.lit("clash")).withColumn("target", F.lit(1))
    plan = mixing.plan_mix(frame).collect()
    sizes = Counter()
    for row in rows:
        sizes[row[3]] += len((row[1] or "").split())
    want = brute_targets(dict(sizes))
    taken = Counter()
    for p in plan:
        assert p.source_size == sizes[p.source] and p.target == pytest.approx(want[p.source])
        rate = p.target / p.source_size if p.source_size else 0
        assert math.floor(rate) <= p.copies <= min(3, math.floor(rate) + 1)
        taken[p.source] += p.size * p.copies
    assert len(plan) == len(rows)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(40, 0.05 * want[s])
    again = mixing.plan_mix(frame.repartition(3)).collect()
    assert sorted(map(str, again)) == sorted(map(str, plan))
    copies = Counter()
    for p in plan:
        copies[(p.doc_id, p.source)] += p.copies
    mixed = mixing.mix(frame)
    assert mixed.columns == frame.columns
    assert Counter((r.doc_id, r.source) for r in mixed.collect()) == +copies
    nodes = mixed._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in nodes and "Arrow" not in nodes and "Pandas" not in nodes


def test_mix_of_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert mixing.plan_mix(none).count() == 0 and mixing.mix(none).count() == 0
    empty = spark.createDataFrame([(1, None, "", "a", 0), (2, "", "", None, 0)], SCHEMA)
    assert [(p.size, p.copies, p.target) for p in mixing.plan_mix(empty).collect()] == [(0, 0, 0.0)] * 2


def test_words_are_counted_without_a_list_of_them(spark):
    texts = ["", " ", "\t\n ", "a", " a", "a ", "  a  b\t\n\x0bc ", "\u00a0", "a\u00a0b", "\x1ca\x1c b", "\x00 \x00", "x x x",
             "$1 \\ $0", "\u00e9\U0001f600 \U0001f600", "\n\r\x0c" * 1000 + "w", "w" + " " * 50_000, " " * 50_000]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    found = frame.select("text", mixing.count_words(F.col("text")).alias("n"))
    assert found.schema["n"].dataType.simpleString() == "bigint"
    assert {r.text: r.n for r in found.collect()} == {t: len(t.encode().split()) for t in texts}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" in plan and "extract" not in plan


def test_sizes_are_written_to_few_files(spark):
    docs = [(i, "word " * (i % 9), "en", f"s{i % 3}", 0) for i in range(200)]
    frame = spark.createDataFrame(docs, SCHEMA).repartition(16)
    thin = mixing.sized(frame)
    assert len(thin.inputFiles()) <= 4
    assert sorted((r.doc_id, r.source, r.size) for r in thin.collect()) == [(i, s, i % 9) for i, _, _, s, _ in docs]


def test_targets_hold_where_a_third_of_the_ids_is_null(spark):
    r = random.Random(12)
    rows = [(None if r.random() < 1 / 3 else i, " ".join(["w"] * r.randint(1, 200)) + f" {i}", "en",
             r.choice(["a", "a", "a", "b", "c", "d", None]), 0) for i in range(4000)]
    plan = mixing.plan_mix(spark.createDataFrame(rows, SCHEMA)).groupBy("source").agg(
        F.sum(F.col("size") * F.col("copies")).alias("taken"), F.max("target").alias("target")).collect()
    assert len(plan) == 5 and all(abs(p["taken"] / p["target"] - 1) < 0.02 for p in plan)


def test_targets_of_many_sources(spark):
    """Ranges of sources give the same weights and targets as one sorted list."""
    r = random.Random(13)
    sizes = {f"s{k:03d}": r.choice([0, 1, 5, r.randint(1, 10_000)]) for k in range(300)} | {None: 77}
    frame = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint").repartition(5)
    got = {x["source"]: (x["weight"], x["target"]) for x in mixing.targets(frame).collect()}
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)}
    open_, left = set(names), sum(sizes.values())
    while True:  # raise all targets together; those over their limit stop there
        level = left / sum(weight[n] for n in open_) if open_ else 0
        over = {n for n in open_ if level * weight[n] > 3 * sizes[n]}
        if not over:
            break
        open_ -= over
        left -= sum(3 * sizes[n] for n in over)
    want = {n: (weight[n], level * weight[n] if n in open_ else 3 * sizes[n]) for n in names}
    assert all(got[n][0] == want[n][0] and math.isclose(got[n][1], want[n][1], abs_tol=1e-6) for n in names)


def test_pipeline_stages(spark, tokenizer):
    r = random.Random(6)
    vocabulary = ["".join(r.choice("abcdefghiklmnoprstu") for _ in range(r.randint(1, 8))) for _ in range(3000)]
    clean = [" ".join(r.choice(vocabulary) for _ in range(r.randint(80, 400))) for _ in range(60)]
    rows = [(i, t, "en", f"s{i % 4}", len(t)) for i, t in enumerate(clean)]
    rows += [(200 + i, clean[i] + " \n", "en", "s0", 0) for i in range(5)]
    words = [clean[i].split() for i in range(10, 15)]
    rows += [(300 + i, " ".join([*w, "extra"]), "en", "s1", 0) for i, w in enumerate(words)]
    rows += [(400, "spam " * 500, "en", None, 0), (401, None, None, None, None), (402, "too short", "en", "s0", 0)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({
        "copies": F.lit("x"), "Verdict": F.lit(None).cast("string"), "whole": F.lit(1), "bits": F.lit(2),
        "size": F.lit(None).cast("int"), "goal_key": F.lit("k"), "norm": F.lit("n"), "row_id": F.lit(0)})
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact", "near", "mix", "pack"]
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality"](spark, docs, "")
    assert {x.doc_id for x in good.collect()} == {x[0] for x in rows if x[0] < 400}
    once = stages["exact"](spark, good, "")
    assert {x.doc_id for x in once.collect()} == {*range(5, 60), *range(200, 205), *range(300, 305)}
    near = stages["near"](spark, once, "")
    kept = {x.doc_id for x in near.collect()}
    assert kept == {x.component_id for x in simhash.near_duplicates(once).collect()}
    assert set(range(15, 60)) <= kept and not {300, 301, 302, 303, 304} <= kept
    mixed = stages["mix"](spark, near, "")
    assert {good.columns == docs.columns, once.columns == docs.columns, near.columns == docs.columns,
            mixed.columns == docs.columns} == {True}
    plan = {p.doc_id: p.copies for p in mixing.plan_mix(near).collect()}
    assert Counter(x.doc_id for x in mixed.collect()) == +Counter(plan)
    packed = stages["pack"](spark, mixed, "").collect()
    check_placed(packed, 2048)
    text = {x[0]: x[1] for x in rows}
    assert sum(x.length for x in packed) == sum(
        n * (1 + len(tokenizer.encode(text[d], add_special_tokens=False).ids)) for d, n in plan.items())
    for name in ("quality", "exact", "near", "mix", "pack"):
        assert stages[name](spark, docs.limit(0), "").count() == 0
