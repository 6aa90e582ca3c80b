"""Frequent phrases and how well their words stick together, per language.

First pass: every task counts the n-grams of its texts by hash and deals the counts to hash partitions, in one shuffle of
packed keys that is written nowhere else. A partition
merges them into one Misra-Gries summary: when it has more than its capacity of counters, the count of the first one
too many is taken off all and those at zero go. As the capacity exceeds a multiple of the partition's mass over
the threshold, what was taken off stays below the threshold, so an n-gram that is frequent enough survives: its count
plus what was taken off reaches the threshold. Survivors are marked in a bitmap of a fixed number of bits.

Second pass: n-grams whose bit is set are counted exactly, by their words. The bitmap is a filter alone: an n-gram it
lets through by chance is counted and found too rare, none that is frequent is missing, at any size. Single words take
the same way, as the parts of a frequent phrase are themselves frequent.

A text's pieces end at punctuation and line ends; phrases lie within a piece. The lowest-scoring cut of a phrase into
two parts counts, with score floor(10^6 a^2 / (l r)) in decimals of 38 digits, exact while a is below 10^15.

Defined results: a null or empty text has no words; a null language is ``und`` and joins rows that say so; repeated
rows count each; ties in score and count come in the order of the phrase's bytes; an empty table gives an empty result.
Texts of any length are read in parts, and a task holds the n-grams of ``chunk`` words at a time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from deltawarden.llm.common import slices, whole_text
from deltawarden.session import cut_lineage

# What ends a piece, and what separates words inside one.
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
UPPER, LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
_PLAIN = bytes.maketrans(UPPER + PIECE_ENDS + b"\t", LOWER + b"\n" * len(PIECE_ENDS) + b" ")


@dataclass(frozen=True)
class PhraseRules:
    """longest: words of a phrase. threshold: occurrences of a frequent one. covered: a phrase goes if one around it
    has at least so many hundredths of its occurrences. first: phrases of a language.

    spare: counters of a summary, as a multiple of mass over threshold. partition_mass: occurrences a hash partition is
    meant to get. bits: size of the bitmap. chunk: words counted at a time.
    """

    longest: int = 3
    threshold: int = 10
    covered: int = 50
    first: int = 2000
    spare: int = 4
    partition_mass: int = 4_000_000
    bits: int = 1 << 28
    chunk: int = 2_000_000
    unknown: str = "und"


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Chunk:
    """Words of one language as numbers in the order of the texts; 0 ends a piece."""

    def __init__(self, lang: str):
        self.lang, self.numbers, self.size, self.carried = lang, [], 0, 0
        self.words: list[bytes] = [b"\n"]
        self.known: dict[bytes, int] = {b"\n": 0}

    def add(self, words: list[bytes]) -> None:
        known = self.known
        for word in set(words).difference(known):
            known[word] = len(self.words)
            self.words.append(word)
        self.numbers.append(np.fromiter(map(known.__getitem__, words), np.int32, len(words)))
        self.size += len(words)

    def next(self, longest: int) -> Chunk:
        """The chunk that goes on after this one; its first words belong to phrases that go on, and are not counted."""
        after = Chunk(self.lang)
        if self.size:
            tail = np.concatenate(self.numbers[-longest:])[-(longest - 1):] if longest > 1 else []
            after.add([self.words[k] for k in tail])
            after.carried = after.size
        return after

    def ngrams(self, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(words, numbers of all words of the chunk, places where an n-gram starts, hashes of these n-grams)."""
        from xxhash import xxh64_intdigest

        numbers = np.concatenate(self.numbers) if self.numbers else np.zeros(0, np.int32)
        seed = xxh64_intdigest(self.lang.encode())
        own = np.fromiter((xxh64_intdigest(w, seed) for w in self.words), np.uint64, len(self.words))[numbers]
        starts, hashes = np.flatnonzero(numbers), None
        for n in range(1, longest + 1):
            if n > 1:
                goes_on = starts + n - 1 < len(numbers)
                goes_on[goes_on] = numbers[starts[goes_on] + n - 1] > 0
                starts, hashes = starts[goes_on], hashes[goes_on]
            last = own[starts + n - 1]
            hashes = _mixed(last if hashes is None else hashes * np.uint64(0x9E3779B97F4A7C15) + last)
            fresh = starts + n - 1 >= self.carried
            yield n, numbers, starts[fresh], hashes[fresh]


def chunks(batches: Iterator[pa.RecordBatch], rules: PhraseRules) -> Iterator[Chunk]:
    """Columns lang, text. A chunk has one language; texts go on in the next chunk where one is full."""
    open_chunks: dict[str, Chunk] = {}
    held = 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
            chunk = open_chunks.setdefault(lang, Chunk(lang))
            plain = text.as_py().translate(_PLAIN)
            for part in slices(plain):
                words = part.replace(b"\n", b" \n ").split(b" ")
                words = [w for w in words if w] if b"" in words else words
                chunk.add(words)
                held += len(words)
                if held >= rules.chunk:
                    yield from open_chunks.values()
                    open_chunks = {lang: chunk.next(rules.longest)}
                    chunk, held = open_chunks[lang], 0
            chunk.add([b"\n"])
    yield from open_chunks.values()


def _deal(hashes: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Partition and key within it."""
    return ((hashes >> np.uint64(32)) % np.uint64(parts)).astype(np.int64), (hashes & np.uint64(0xFFFFFFFF)).astype(np.uint32)


class Summary:
    """A Misra-Gries summary over 32-bit keys, as sorted arrays. ``taken_off`` bounds what a count lacks."""

    def __init__(self, capacity: int):
        self.capacity, self.taken_off = capacity, 0
        self.keys, self.counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def merge(self, keys: np.ndarray, counts: np.ndarray, taken_off: int = 0) -> None:
        """Add another summary, or several at once: a key may come more than once."""
        keys = np.concatenate([self.keys, keys])
        counts = np.concatenate([self.counts, counts])
        # Key and count in one number sort faster than places; counts of 2^32 and more take the other way.
        if counts.max(initial=0) < 1 << 32:
            both = np.sort(keys.astype(np.uint64) << np.uint64(32) | counts.astype(np.uint64))
            keys, counts = (both >> np.uint64(32)).astype(np.uint32), (both & np.uint64(0xFFFFFFFF)).astype(np.int64)
        else:
            order = np.argsort(keys, kind="stable")
            keys, counts = keys[order], counts[order]
        if len(keys):
            starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            keys, counts = keys[starts], np.add.reduceat(counts, starts)
        self.keys, self.counts = keys, counts
        self.taken_off += taken_off
        if len(self.keys) > self.capacity:
            cut = int(np.partition(self.counts, -self.capacity - 1)[-self.capacity - 1])
            left = self.counts > cut
            self.keys, self.counts = self.keys[left], self.counts[left] - cut
            self.taken_off += cut

    def survivors(self, threshold: int) -> np.ndarray:
        """Keys of all items that may have come ``threshold`` times."""
        return self.keys[self.counts + self.taken_off >= threshold]


def _planes(numbers: np.ndarray) -> bytes:
    """32-bit numbers, all their first bytes before all their second ones: shuffle files keep planes of zeros small."""
    return numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _from_planes(packed: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(packed, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def packed_keys(keys: np.ndarray) -> bytes:
    """Ascending keys as what each adds to the one before."""
    return _planes(np.diff(keys, prepend=keys.dtype.type(0)))


def unpacked_keys(packed: bytes) -> np.ndarray:
    return np.cumsum(_from_planes(packed), dtype=np.uint32)


def _bit(keys: np.ndarray, bits: int) -> np.ndarray:
    """Place of a key among the bits of its partition."""
    return (keys.astype(np.uint64) * np.uint64(bits)) >> np.uint64(32)


def survivor_bits(texts: DataFrame, rules: PhraseRules) -> np.ndarray:
    """One row of bytes per hash partition: the bitmap of the n-grams that may be frequent."""
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # A word takes two bytes with what separates it, so this is no less than the mass; it sizes partitions only.
    parts = max(64, math.ceil(size / 2 * rules.longest / rules.partition_mass))
    bits = max(8, rules.bits // parts // 8 * 8)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, rules):
            hashes = np.concatenate([h for _, _, _, h in chunk.ngrams(rules.longest)])
            hashes, counts = np.unique(hashes, return_counts=True)
            part, keys = _deal(hashes, parts)
            order = np.lexsort((keys, part))
            part, keys, counts = part[order], keys[order], counts[order].astype(np.uint32)
            edges = np.flatnonzero(np.diff(part, prepend=-1, append=-1))
            # The first row of a partition is its mass alone: sorted before all others, it sets the size of the summary.
            out: list[tuple] = []
            for start, stop in zip(edges[:-1], edges[1:], strict=True):
                own, often = keys[start:stop], counts[start:stop]
                once = often == 1
                out.append((int(part[start]), int(often.sum()), None, None, None))
                out.append((int(part[start]), 0, packed_keys(own[once]), packed_keys(own[~once]), _planes(often[~once])))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), (
                        pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)],
                    ["part", "mass", "once", "often", "counts"])

    dealt = texts.select("lang", "text").mapInArrow(
        count, "part bigint, mass bigint, once binary, often binary, counts binary")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summary, part, mass = None, None, 0
        waiting: list[tuple[np.ndarray, np.ndarray]] = []

        def add() -> None:
            if waiting:
                keys, counts = zip(*waiting, strict=True)
                summary.merge(np.concatenate(keys), np.concatenate(counts))
                waiting.clear()

        def row() -> pa.RecordBatch:
            add()
            marked = np.zeros(bits, np.uint8)
            marked[_bit(summary.survivors(rules.threshold), bits)] = 1
            return pa.RecordBatch.from_arrays([pa.array([part]), pa.array([np.packbits(marked).tobytes()])],
                                              ["part", "bits"])

        for batch in batches:
            for number, some, once, often, counts in zip(*batch.columns, strict=True):
                if number.as_py() != part:
                    if summary:
                        yield row()
                    summary, part, mass = None, number.as_py(), 0
                mass += some.as_py()
                if not once.is_valid:
                    continue
                if summary is None:
                    summary = Summary(rules.spare * mass // rules.threshold + 1)
                ones, more = unpacked_keys(once.as_py()), unpacked_keys(often.as_py())
                many = _from_planes(counts.as_py())
                waiting.append((np.concatenate([ones, more]),
                                np.concatenate([np.ones(len(ones), np.int64), many.astype(np.int64)])))
                # Merging as much as a summary holds at a time sorts each count a few times only.
                if sum(len(keys) for keys, _ in waiting) >= summary.capacity:
                    add()
        if summary:
            yield row()

    # Shuffled once and written nowhere else: the masses of a partition come before its keys.
    grouped = dealt.repartition(parts, "part").sortWithinPartitions("part", F.col("once").isNotNull())
    rows = grouped.mapInArrow(merge, "part bigint, bits binary").toArrow()  # ``bits`` bits at most
    out = np.zeros((parts, bits // 8), np.uint8)
    for part, marked in zip(rows["part"].to_pylist(), rows["bits"], strict=True):
        out[part] = np.frombuffer(marked.as_py(), np.uint8)
    return out


def phrase_counts(texts: DataFrame, rules: PhraseRules) -> DataFrame:
    """lang, n (words), phrase, f: every n-gram that comes ``threshold`` times; with n = 0 all words of a language."""
    shared = texts.sparkSession.sparkContext.broadcast(survivor_bits(texts, rules))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = shared.value
        parts, bits = marked.shape[0], marked.shape[1] * 8
        for chunk in chunks(batches, rules):
            for n, numbers, starts, hashes in chunk.ngrams(rules.longest):
                if n == 1:
                    yield rows(chunk.lang, 0, [""], np.array([len(starts)]))
                part, keys = _deal(hashes, parts)
                at = _bit(keys, bits).astype(np.int64)
                starts = starts[(marked[part, at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1]
                code = numbers[starts].astype(np.int64)
                for later in range(1, n):  # words decide what is equal, not hashes
                    _, code = np.unique(code, return_inverse=True)
                    code = code * len(chunk.words) + numbers[starts + later]
                _, one, often = np.unique(code, return_index=True, return_counts=True)
                found = [b" ".join([chunk.words[k] for k in numbers[s:s + n]]).decode("utf-8", "replace")
                         for s in starts[one]]
                for start in range(0, len(found), 65536):
                    yield rows(chunk.lang, n, found[start:start + 65536], often[start:start + 65536])

    def rows(lang: str, n: int, found: list[str], often: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(found), pa.string()), pa.array([n] * len(found), pa.int32()),
             pa.array(found, pa.string()), pa.array(often.astype(np.int64))], ["lang", "n", "phrase", "f"])

    counted = texts.select("lang", "text").mapInArrow(count, "lang string, n int, phrase string, f bigint")
    summed = counted.groupBy("lang", "n", "phrase").agg(F.sum("f").alias("f"))
    return cut_lineage(summed.where((F.col("f") >= rules.threshold) | (F.col("n") == 0)))


def scored(counts: DataFrame, rules: PhraseRules = PhraseRules()) -> DataFrame:
    """lang, n, phrase, a, k, l, r, score of every frequent phrase of two and more words: its lowest-scoring cut."""
    known = counts.where("n > 0").select("lang", "phrase", "f")
    words = F.split("phrase", " ")
    cuts = counts.where("n > 1").select(
        "lang", "n", "phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("n") - 1)).alias("k"),
        words.alias("words"))
    cuts = cuts.select(
        "lang", "n", "phrase", "a", "k", F.array_join(F.slice("words", 1, F.col("k")), " ").alias("head"),
        F.array_join(F.slice("words", F.col("k") + 1, F.col("n") - F.col("k")), " ").alias("rest"))
    for part, name in (("head", "l"), ("rest", "r")):
        cuts = cuts.join(known.select(F.col("lang").alias("of_lang"), F.col("phrase").alias("part"),
                                      F.col("f").alias(name)),
                         (F.col("lang") == F.col("of_lang")) & (F.col(part) == F.col("part"))).drop("of_lang", "part")
    wide = {name: F.col(name).cast("decimal(38,0)") for name in ("a", "l", "r")}
    cuts = cuts.withColumns({"over": F.lit(1000000).cast("decimal(38,0)") * wide["a"] * wide["a"],
                             "under": wide["l"] * wide["r"]}).withColumn("score", F.expr("over div under"))
    lowest = F.min(F.struct("score", "k", "l", "r")).alias("cut")
    return cuts.groupBy("lang", "n", "phrase", "a").agg(lowest).select("lang", "n", "phrase", "a", "cut.*")


def uncovered(candidates: DataFrame, rules: PhraseRules = PhraseRules()) -> DataFrame:
    """The candidates without those whose words lie inside a longer one that is nearly as frequent."""
    words, n = F.split("phrase", " "), F.col("n")
    inner = candidates.where("n > 2").select(
        "lang", F.col("a").alias("longer"), F.explode(F.array_distinct(F.flatten(F.transform(
            F.sequence(F.lit(2), n - 1), lambda size: F.transform(
                F.sequence(F.lit(1), n - size + 1), lambda at: F.array_join(F.slice(words, at, size), " ")))))).alias("part"))
    around = inner.groupBy(F.col("lang").alias("of_lang"), "part").agg(F.max("longer").alias("longer"))
    joined = candidates.join(around, (F.col("lang") == F.col("of_lang")) & (F.col("phrase") == F.col("part")), "left")
    return joined.where(F.col("longer").isNull() | (100 * F.col("longer") < rules.covered * F.col("a"))).select(
        *candidates.columns)


def collocations(docs: DataFrame, rules: PhraseRules = PhraseRules(), lang: str = "lang",
                 text: str = "text") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first phrases of every language."""
    texts = docs.select(F.coalesce(docs[lang].cast("string"), F.lit(rules.unknown)).alias("lang"),
                        whole_text(docs, text).alias("text"))
    counts = phrase_counts(texts, rules)
    kept = uncovered(cut_lineage(scored(counts, rules)), rules)
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    best = kept.drop("n").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= rules.first)
    totals = counts.where("n = 0").select(F.col("lang").alias("of_lang"), F.col("f").alias("n"))
    return best.join(totals, F.col("lang") == F.col("of_lang")).select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score")
