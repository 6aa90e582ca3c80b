"""Repeated passages: remove every word inside a window of words that also starts somewhere else.

Equal windows must meet in one index, and no index can hold the corpus. So every window names an anchor, the word
group inside it with the least hash, and consecutive windows with the same anchor form a run. Equal windows have equal
anchors; the shard of a window is the hash of its anchor's words. Runs whose anchor occurs once in the corpus hold
nothing repeated and go no further. Of the others, each distinct run travels once, with the number of its occurrences
as weight. A shard builds a compressed FM-index over its runs, streams those that occur once as a whole through it, and
reports the windows whose backward search ends with two occurrences or more. Windows are judged on the input.

An anchor that very many different runs share would crowd one shard. Such anchors are estimated from a sample of rows
and ranked last when anchors are chosen; there can be no more of them than runs over ``hot_runs``. The choice moves
work between shards and does not change the result.

Defined results: a null, empty or white text has no words, and its kept text is empty; a text shorter than the window
keeps all its words. Repeated rows are occurrences of
their own. Null doc_ids are documents like others. An empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from deltawarden.llm.common import same, whole_text
from deltawarden.llm.wavelet import FMIndex, repeated_windows
from deltawarden.session import cut_lineage


@dataclass(frozen=True)
class PassageRules:
    """window: words of a passage. anchor: words of an anchor, fewer than a window. shard_words: words per index."""

    window: int = 35
    anchor: int = 6
    shard_words: int = 1_500_000
    hot_runs: int = 100_000
    hot_sample: int = 64


class WordHashes(dict):
    """64-bit hashes of recent words; bounded."""

    def __init__(self, limit: int = 500_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        value = xxh64_intdigest(word)
        if len(self) >= self.limit:
            self.clear()
        if len(word) <= 64:
            self[word] = value
        return value


HASHES = WordHashes()
_MULTIPLY, _SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD)
_PLACE_BITS = np.uint64(24)
_PLACE = np.uint64((1 << 24) - 1)


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(33))) * _SPREAD
    return values ^ (values >> np.uint64(29))


def runs(words: list[bytes], rules: PassageRules, hot: np.ndarray) -> tuple[np.ndarray, ...]:
    """Per run: first window, number of windows, anchor hash, hash of all its words.

    hot: sorted anchor hashes that are chosen only where a window has no other.
    """
    n, span = len(words), rules.window - rules.anchor + 1
    if n < rules.window:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2
    hashes = np.fromiter(map(HASHES.__getitem__, words), np.uint64, n)
    groups = hashes[:n - rules.anchor + 1].copy()
    for j in range(1, rules.anchor):
        groups *= _MULTIPLY
        groups += hashes[j:n - rules.anchor + 1 + j]
    groups = _mixed(groups)
    order = groups >> np.uint64(1)
    if len(hot):
        at = np.minimum(np.searchsorted(hot, groups), len(hot) - 1)
        order |= (hot[at] == groups).astype(np.uint64) << np.uint64(63)
    anchors = []
    # Places take 24 bits of the compared number, so very long texts go in parts that overlap by a window.
    step = (1 << 24) - rules.window
    for begin in range(0, n - rules.window + 1, step):
        part = order[begin:begin + step + span - 1]
        least = (part & ~_PLACE) | np.arange(len(part), dtype=np.uint64)
        have = 1
        while have * 2 <= span:
            least = np.minimum(least[:-have], least[have:])
            have *= 2
        if have < span:
            least = np.minimum(least[:len(least) - (span - have)], least[span - have:])
        anchors.append((least & _PLACE).astype(np.int64) + begin)
    place = np.concatenate(anchors)
    cut = np.flatnonzero(np.diff(place)) + 1
    first, end = np.concatenate([[0], cut]), np.concatenate([cut, [len(place)]])
    # Hash of a range of words from prefix sums of word hash times a power of an odd number, scaled back to the start.
    powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, _MULTIPLY)]))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(hashes * powers)])
    inverse = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, np.uint64(pow(int(_MULTIPLY), -1, 1 << 64)))]))
    content = (sums[end + rules.window - 1] - sums[first]) * inverse[first]
    return first, end - first, groups[place[first]], _mixed(content ^ (end - first).astype(np.uint64))


def _text_key(text: Column) -> Column:
    """128 bits of a text: many different texts may come without a doc_id, and none may be taken for another."""
    return F.unhex(F.substring(F.sha2(text.cast("binary"), 256), 1, 32))


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(docs[doc_id].alias("doc_id"), whole_text(docs, text).alias("text"))


def anchored_runs(rows: DataFrame, rules: PassageRules, hot: np.ndarray) -> DataFrame:
    """doc_id, text_key, firsts, windows, anchor, content: one row per different run of a document, with the places it
    starts at; no text goes further."""
    key = rows.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, keys, row_of, parts = [], [], [], []
            for i, item in enumerate(batch.column(1).cast(pa.binary())):
                data = item.as_buffer().to_pybytes()
                found = runs(data.split(), rules, hot)
                if len(found[0]):
                    index.append(np.full(len(found[0]), i))
                    keys.append(hashlib.sha256(data).digest()[:16])
                    row_of.append(np.full(len(found[0]), len(keys) - 1))
                    parts.append(found)
            if not parts:
                continue
            first, windows, anchor, content = (np.concatenate(c) for c in zip(*parts, strict=True))
            of_row = np.concatenate(index)
            # A text that repeats itself has one run many times: these become one row.
            order = np.lexsort((first, content, anchor, of_row))
            same_run = np.ones(len(order), bool)
            for values in (of_row, anchor, content):
                same_run[1:] &= values[order][1:] == values[order][:-1]
            same_run[0] = False
            start = np.flatnonzero(~same_run)
            at = order[start]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(of_row[at])), pa.array(keys, pa.binary()).take(pa.array(np.concatenate(row_of)[at])),
                 pa.ListArray.from_arrays(pa.array(np.append(start, len(order)), pa.int32()),
                                          pa.array(first[order].astype(np.int32))),
                 pa.array(windows[at].astype(np.int32)), pa.array(anchor[at].view(np.int64)),
                 pa.array(content[at].view(np.int64))],
                ["doc_id", "text_key", "firsts", "windows", "anchor", "content"])

    return rows.select("doc_id", "text").mapInArrow(
        work, f"doc_id {key}, text_key binary, firsts array<int>, windows int, anchor bigint, content bigint")


def crowded_anchors(rows: DataFrame, rules: PassageRules) -> np.ndarray:
    """Anchors that more than ``hot_runs`` different runs seem to share, from one row in ``hot_sample``."""
    some = rows.where(F.pmod(F.monotonically_increasing_id(), F.lit(rules.hot_sample)) == 0)
    counts = anchored_runs(some, rules, np.zeros(0, np.uint64)).groupBy("anchor").agg(F.count(F.lit(1)).alias("n"))
    found = counts.where(F.col("n") > F.lit(max(1, rules.hot_runs // rules.hot_sample))).select("anchor").collect()
    return np.sort(np.array([r["anchor"] for r in found], np.int64).view(np.uint64))


def search_shard(rows: pa.Table, rules: PassageRules) -> pa.Table:
    """anchor, content, spans of a shard's runs; spans are pairs of first and last repeated window start."""
    first_rows: dict[tuple, int] = {}
    for i, pair in enumerate(zip(rows.column("anchor").to_pylist(), rows.column("content").to_pylist(), strict=True)):
        first_rows.setdefault(pair, i)  # a repeated row may have brought a run twice
    rows = rows.take(pa.array(list(first_rows.values()), pa.int64()))
    weights = rows.column("weight").to_numpy()
    vocabulary: dict[bytes, int] = {}
    coded = [np.fromiter((vocabulary.setdefault(w, len(vocabulary) + 1) for w in item.as_py().split(b" ")), np.int32)
             for item in rows.column("words")]
    lengths = np.array([len(c) for c in coded], np.int64)
    symbols = np.zeros(int(lengths.sum()) + len(coded), np.int64)
    starts = np.cumsum(lengths + 1) - lengths - 1
    for start, codes in zip(starts, coded, strict=True):
        symbols[start:start + len(codes)] = codes
    index = FMIndex(symbols, len(vocabulary) + 1, np.repeat(weights, lengths + 1), int(lengths.max()))
    # A run that occurs twice as a whole is repeated from end to end; the others are streamed through the index.
    spans: list[list[int]] = [[0, int(n) - rules.window] for n in lengths]
    streamed = np.flatnonzero(weights < 2)
    for begin in range(0, len(streamed), 16384):
        block = streamed[begin:begin + 16384]
        texts = np.zeros((len(block), int(lengths[block].max())), np.int32)
        for lane, i in enumerate(block):
            texts[lane, :lengths[i]] = coded[i]
        flags = repeated_windows(index, texts, lengths[block], rules.window)
        edges = np.diff(flags.astype(np.int8), axis=1, prepend=0, append=0)
        for lane, i in enumerate(block):
            spans[i] = []
        for lane, begin_at in zip(*np.nonzero(edges == 1), strict=True):
            spans[block[lane]].append(int(begin_at))
        ends = iter(np.nonzero(edges == -1)[1])
        for i in block:
            spans[i] = [x for begin_at in spans[i] for x in (begin_at, int(next(ends)) - 1)]
    found = [i for i, s in enumerate(spans) if s]
    return pa.table({
        "anchor": rows.column("anchor").take(pa.array(found, pa.int64())),
        "content": rows.column("content").take(pa.array(found, pa.int64())),
        "spans": pa.array([spans[i] for i in found], pa.list_(pa.int32()))})


def repeated_spans(rows: DataFrame, rules: PassageRules) -> DataFrame:
    """doc_id, text_key, spans: the repeated passages of every document that has one.

    spans: flat pairs (first word, last word), not yet merged.
    """
    hot = crowded_anchors(rows, rules)
    found = cut_lineage(anchored_runs(rows, rules, hot))
    # Counts come from partial sums and meet the runs again in a join, so no task needs all runs of an anchor.
    together = cut_lineage(found.groupBy(F.col("anchor").alias("of_anchor")).agg(F.sum(F.size("firsts")).alias("n")).where(
        "n > 1").select("of_anchor"))
    shared = cut_lineage(found.join(together, F.col("anchor") == F.col("of_anchor"), "left_semi"))

    # Each distinct run once, from the first document that has it.
    distinct = shared.groupBy("anchor", "content").agg(
        F.sum(F.size("firsts")).alias("weight"),
        F.min(F.struct("doc_id", "text_key", F.get("firsts", F.lit(0)).alias("first"), "windows")).alias("at"))
    distinct = cut_lineage(distinct.select("anchor", "content", "weight", "at.*"))
    total = distinct.agg(F.sum(F.col("windows") + F.lit(rules.window - 1))).first()[0] or 0
    shards = max(1, math.ceil(total / rules.shard_words))
    wanted = distinct.groupBy(F.col("doc_id").alias("from_id"), F.col("text_key").alias("from_key")).agg(
        F.collect_list(F.struct("anchor", "content", "weight", "first", "windows")).alias("wanted"))
    texts = rows.withColumn("text_key", _text_key(rows["text"]))
    joined = wanted.hint("shuffle_hash").join(
        texts, same(texts["doc_id"], wanted["from_id"]) & (texts["text_key"] == wanted["from_key"]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, wants in zip(batch.column(0).cast(pa.binary()), batch.column(1), strict=True):
                words = text.as_buffer().to_pybytes().split()
                for w in wants.as_py():
                    stop = w["first"] + w["windows"] + rules.window - 1
                    out.append((w["anchor"] % shards, w["anchor"], w["content"], w["weight"],
                                b" ".join(words[w["first"]:stop])))
            if out:
                shard, anchor, content, weight, runs_ = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard, pa.int64()), pa.array(anchor, pa.int64()), pa.array(content, pa.int64()),
                     pa.array(weight, pa.int64()), pa.array(runs_, pa.binary())],
                    ["shard", "anchor", "content", "weight", "words"])

    pieces = joined.select("text", "wanted").mapInArrow(
        cut, "shard bigint, anchor bigint, content bigint, weight bigint, words binary")
    results = cut_lineage(pieces.groupBy("shard").applyInArrow(
        lambda t: search_shard(t, rules), "anchor bigint, content bigint, spans array<int>"))
    # Window starts of a run become words of the document: the last window of a span reaches window - 1 words on.
    placed = F.flatten(F.transform("firsts", lambda first: F.transform("spans", lambda s, i: (
        s + first + F.when(i % 2 == 1, rules.window - 1).otherwise(0)))))
    return shared.join(results, ["anchor", "content"]).select("doc_id", "text_key", placed.alias("spans")).groupBy(
        "doc_id", "text_key").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def without_repeats(docs: DataFrame, rules: PassageRules = PassageRules(), doc_id: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_text (kept words joined by one space, as bytes)."""
    rows = _rows(docs, doc_id, text)
    spans = repeated_spans(rows, rules).select(
        F.col("doc_id").alias("span_id"), F.col("text_key").alias("span_key"), "spans")
    texts = rows.withColumn("text_key", _text_key(rows["text"]))
    joined = texts.join(spans.hint("shuffle_hash"), same(texts["doc_id"], spans["span_id"])
                        & (texts["text_key"] == spans["span_key"]), "left")

    @F.arrow_udf("struct<n_words: bigint, n_removed: bigint, kept_text: binary>")
    def kept(column: pa.Array, span_lists: pa.Array) -> pa.Array:
        words_, removed, texts_ = [], [], []
        for item, found in zip(column.cast(pa.binary()), span_lists, strict=True):
            words = item.as_buffer().to_pybytes().split()
            gone = 0
            if found.is_valid:
                pairs = found.values.to_numpy(zero_copy_only=False).reshape(-1, 2)
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, pairs[:, 0], 1)
                np.add.at(edge, pairs[:, 1] + 1, -1)
                stay = np.cumsum(edge[:-1]) == 0
                gone = int(len(words) - stay.sum())
                left = list(compress(words, stay.tolist()))
            else:
                left = words
            words_.append(len(words))
            removed.append(gone)
            texts_.append(b" ".join(left))
        return pa.StructArray.from_arrays(
            [pa.array(words_, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts_, pa.binary())],
            ["n_words", "n_removed", "kept_text"])

    return joined.withColumn("result", kept("text", "spans")).select("doc_id", "result.*")
