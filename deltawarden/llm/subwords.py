"""A text classifier of supervised subword embeddings.

A word stands for itself and for its character n-grams, marked where the word begins and ends; neighbouring words
stand for word n-grams. All are hashed into one table of learned vectors. A document is the average of the vectors of
all its features, repeats included, and a softmax over its product with one learned vector per class gives the
probabilities. Both tables are trained by stochastic gradient descent in numpy, one document at a time.

The model is fitted on a bounded sample: of the rows that may be learned from, the first ``sample_rows`` in the order
of a hash of doc_id, as long as they have no more than ``sample_entries`` distinct features together. Features are
counted by Spark tasks; what comes to the driver is bounded by these two. Scoring reads every text whole. As the
average goes into a linear layer, a feature's share of the logits can be worked out beforehand: what tasks get is a
table of ``buckets`` rows of one number per class.

Defined results: a null or empty text has one feature, the mark of the end of a text, that every document has; so it
has a score like any other. A doc_id with several labels counts as the smallest; null labels and labels of no
document are not learned from; without any label every class is equally likely. Repeated rows are scored each on its
own and alike. Only doc_id and text of the documents are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from deltawarden.llm.common import WHITE_BYTES, slices, whole_text
from deltawarden.session import cut_lineage

# Fixed value: the mark that ends every text.
END = b"</s>"
_SPACES = bytes.maketrans(WHITE_BYTES, b" " * len(WHITE_BYTES))
_TURN, _STIR = np.uint64(116049371), np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class SubwordRules:
    """shortest, longest: characters of an n-gram; word_ngrams: the most words of one. steps: documents seen in
    training, over as many passes as that takes. kept_words: words that a task remembers the shares of; chunk: words
    scored at a time."""

    dim: int = 8
    buckets: int = 1 << 18
    shortest: int = 3
    longest: int = 5
    word_ngrams: int = 2
    steps: int = 25_000
    rate: float = 0.5
    sample_rows: int = 3000
    sample_entries: int = 8_000_000
    seed: int = 13
    kept_words: int = 500_000
    chunk: int = 500_000


def _bucket(hashes: np.ndarray, salt: int, rules: SubwordRules) -> np.ndarray:
    stirred = (hashes + np.uint64(salt)) * _STIR
    return ((stirred ^ (stirred >> np.uint64(32))) % np.uint64(rules.buckets)).astype(np.int64)


def end_bucket(rules: SubwordRules) -> int:
    return int(_bucket(word_hashes([END]), 0, rules)[0])


def word_hashes(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))


def word_features(words: list[bytes], hashes: np.ndarray, rules: SubwordRules) -> tuple[np.ndarray, np.ndarray]:
    """(place in the list, bucket) of every word itself and of each of its character n-grams, in the order of n."""
    owners, buckets = [np.arange(len(words))], [_bucket(hashes, 0, rules)]
    marked = b"<" + b"> <".join(words) + b">"  # no word has a space in it
    signs = np.frombuffer(marked.decode("utf-8", "replace").encode("utf-32-le"), "<u4").astype(np.uint64)
    space = signs == 32
    owner = np.cumsum(space)
    joined = signs
    for n in range(2, rules.longest + 1):
        joined = joined[:-1] * _TURN + signs[n - 1:]
        if n >= rules.shortest:
            inside = (owner[:len(joined)] == owner[n - 1:]) & ~space[:len(joined)]
            owners.append(owner[:len(joined)][inside])
            buckets.append(_bucket(joined[inside], n, rules))
    return np.concatenate(owners), np.concatenate(buckets)


def word_ngrams(hashes: np.ndarray, rules: SubwordRules) -> Iterator[tuple[int, np.ndarray]]:
    """(n, buckets of the n-grams that start at each word). They are hashed from the differences of neighbours, so a
    word that follows itself has the same bucket whatever the word: repetition is learned as such."""
    steps = hashes[1:] - hashes[:-1]
    joined = steps
    for n in range(2, rules.word_ngrams + 1):
        if n > 2:
            joined = joined[:-1] * _TURN + steps[n - 2:]
        yield n, _bucket(joined, n << 8, rules)


def feature_counts(text: bytes, rules: SubwordRules) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and how often each comes."""
    total = np.zeros(rules.buckets, np.int64)
    total[end_bucket(rules)] = 1
    before: list[bytes] = []
    for part in slices(text.translate(_SPACES)):
        words = part.split()
        often = Counter(words)
        distinct = list(often)
        if distinct:
            own, buckets = word_features(distinct, word_hashes(distinct), rules)
            many = np.fromiter(often.values(), np.int64, len(often))[own]
            total += np.bincount(buckets, many, rules.buckets).astype(np.int64)
        run = before + words
        for n, buckets in word_ngrams(word_hashes(run), rules):
            total += np.bincount(buckets[max(0, len(before) - n + 1):], minlength=rules.buckets)
        before = run[max(0, len(run) - rules.word_ngrams + 1):]
    found = np.flatnonzero(total)
    return found, total[found]


class Scorer:
    """Sums of logit shares over texts, many at a time. The shares of a word are worked out once and remembered."""

    def __init__(self, model: SubwordModel):
        self.model, self.rules = model, model.rules
        self.forget()

    def forget(self) -> None:
        self.numbers: dict[bytes, int] = {}
        self.hashes = np.zeros(0, np.uint64)
        self.shares = np.zeros((0, len(self.model.classes) + 1))  # of the classes, and the number of features

    def learn(self, words: list[bytes]) -> None:
        self.numbers.update(zip(words, range(len(self.numbers), len(self.numbers) + len(words))))
        hashes = word_hashes(words)
        own, buckets = word_features(words, hashes, self.rules)
        columns = [np.bincount(own, share[buckets], len(words)) for share in self.model.logits.T]
        columns.append(np.bincount(own, minlength=len(words)).astype(np.float64))
        self.hashes = np.concatenate([self.hashes, hashes])
        self.shares = np.concatenate([self.shares, np.stack(columns, axis=1)])

    def totals(self, texts: list[bytes]) -> np.ndarray:
        """Per text the sums over its features, and how many these are."""
        end = end_bucket(self.rules)
        out = np.tile(np.append(self.model.logits[end], 1.0), (len(texts), 1))
        runs: list[tuple[int, list[bytes], int]] = []  # (text, words, words counted before)
        held = 0
        for i, text in enumerate(texts):
            before: list[bytes] = []
            for part in slices(text.translate(_SPACES)):
                run = before + part.split()
                runs.append((i, run, len(before)))
                held += len(run)
                before = run[max(0, len(run) - self.rules.word_ngrams + 1):]
                if held >= self.rules.chunk:
                    self._add(runs, out)
                    runs, held = [], 0
        self._add(runs, out)
        return out

    def _add(self, runs: list[tuple[int, list[bytes], int]], out: np.ndarray) -> None:
        if len(self.numbers) > self.rules.kept_words:
            self.forget()
        seen: set[bytes] = set()
        for _, words, _ in runs:
            seen.update(words)
        if fresh := list(seen.difference(self.numbers)):
            self.learn(fresh)
        sizes = np.array([len(words) for _, words, _ in runs], np.int64)
        words = np.fromiter((self.numbers[w] for _, run, _ in runs for w in run), np.int64, int(sizes.sum()))
        of = np.repeat(np.array([i for i, _, _ in runs], np.int64), sizes)  # text of each word
        run = np.repeat(np.arange(len(runs)), sizes)
        place = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        known = np.repeat(np.array([k for _, _, k in runs], np.int64), sizes)
        new = place >= known
        for c in range(out.shape[1]):
            out[:, c] += np.bincount(of[new], self.shares[words[new], c], len(out))
        for n, buckets in word_ngrams(self.hashes[words], self.rules):
            # Inside one run, and ending in a word that was not counted before.
            at = np.flatnonzero((run[:len(buckets)] == run[n - 1:]) & new[n - 1:])
            for c, share in enumerate(self.model.logits.T):
                out[:, c] += np.bincount(of[at], share[buckets[at]], len(out))
            out[:, -1] += np.bincount(of[at], minlength=len(out))

    def probabilities(self, texts: list[bytes]) -> np.ndarray:
        sums = self.totals(texts)
        logits = sums[:, :-1] / sums[:, -1:]
        odds = np.exp(logits - logits.max(axis=1, keepdims=True))
        return odds / odds.sum(axis=1, keepdims=True)


@dataclass(frozen=True)
class SubwordModel:
    """logits: one row per bucket, one column per class; shares of a document's logits before they are averaged."""

    rules: SubwordRules
    classes: tuple[int, ...]
    logits: np.ndarray

    @staticmethod
    def fit(rows: list[tuple[int, np.ndarray, np.ndarray]], classes: tuple[int, ...],
            rules: SubwordRules) -> SubwordModel:
        """rows: (label, distinct buckets, counts). The same rows in the same order give the same model."""
        random = np.random.default_rng(rules.seed)
        vectors = random.uniform(-1 / rules.dim, 1 / rules.dim, (rules.buckets, rules.dim)).astype(np.float32)
        out = np.zeros((len(classes), rules.dim), np.float32)
        place = {label: i for i, label in enumerate(classes)}
        done = 0
        while rows and done < rules.steps:
            for at in random.permutation(len(rows))[:rules.steps - done]:
                label, buckets, counts = rows[at]
                rate = rules.rate * (1 - done / rules.steps)
                done += 1
                share = (counts / counts.sum()).astype(np.float32)
                hidden = share @ vectors[buckets]
                logits = out @ hidden
                odds = np.exp(logits - logits.max())
                error = odds / odds.sum()
                error[place[label]] -= 1
                back = error @ out
                out -= rate * np.outer(error, hidden)
                vectors[buckets] -= rate * share[:, None] * back
        return SubwordModel(rules, classes, (vectors @ out.T).astype(np.float64))


def id_remainder(doc_id: Column, folds: int = 5) -> Column:
    """CRC-32 of the doc_id as text, modulo the folds; a null doc_id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, rules: SubwordRules, doc_id: str = "doc_id",
                  text: str = "text") -> list[tuple[int, np.ndarray, np.ndarray]]:
    """The sample: (label, distinct buckets, counts). ``labels`` has doc_id and label of the rows to learn from."""
    order = F.xxhash64(F.col("label_id").cast("string"), F.lit(rules.seed))
    wanted = cut_lineage(
        labels.select(labels["doc_id"].alias("label_id"), labels[label].cast("int").alias("label"))
        .where("label_id is not null and label is not null").groupBy("label_id").agg(F.min("label").alias("label"))
        .withColumn("place", order).orderBy("place", "label_id").limit(rules.sample_rows))
    texts = docs.select(docs[doc_id].alias("doc_id"), whole_text(docs, text).alias("text"))
    # Rows that share a doc_id must not make the sample larger.
    chosen = texts.join(F.broadcast(wanted), texts["doc_id"] == wanted["label_id"]).select(
        "place", "label_id", "label", "text").orderBy("place", "label_id", "text").limit(rules.sample_rows)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, value in enumerate(batch.column(3).cast(pa.binary())):
                found, often = feature_counts(value.as_py(), rules)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).slice(i, 1) for k in range(3)),
                     pa.array([found.astype("<i4").tobytes()]), pa.array([often.astype("<i4").tobytes()]),
                     pa.array([len(found)], pa.int64())],
                    ["place", "label_id", "label", "buckets", "counts", "entries"])

    kind = dict(docs.dtypes)[doc_id]
    parts = docs.sparkSession.sparkContext.defaultParallelism
    counted = cut_lineage(chosen.repartition(parts).mapInArrow(
        count, f"place bigint, label_id {kind}, label int, buckets binary, counts binary, entries bigint"))
    # One row per sampled document: the window is as bounded as the sample.
    so_far = Window.orderBy("place", "label_id", "buckets", "counts").rowsBetween(Window.unboundedPreceding, 0)
    taken = (counted.withColumn("so_far", F.sum("entries").over(so_far)).where(F.col("so_far") <= rules.sample_entries)
             .orderBy("place", "label_id", "buckets", "counts").select("label", "buckets", "counts").toArrow())
    return [(label_value.as_py(), np.frombuffer(buckets.as_buffer(), "<i4"), np.frombuffer(counts.as_buffer(), "<i4"))
            for label_value, buckets, counts in zip(*taken.columns, strict=True)]


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", classes: tuple[int, ...] = (0, 1),
          rules: SubwordRules = SubwordRules()) -> SubwordModel:
    """A model of the label from all rows of ``labels`` whose label is one of the classes."""
    known = labels.where(labels[label].isin(*classes))
    return SubwordModel.fit(training_rows(docs, known, label, rules), classes, rules)


def probabilities(docs: DataFrame, model: SubwordModel, name: str = "probabilities", text: str = "text") -> DataFrame:
    """Add an array with the probability of every class, in the order of ``model.classes``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # buckets x classes numbers

    @F.arrow_udf("array<double>")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(shared.value)
        for texts in batches:
            found = scorer.probabilities([value.as_py() for value in texts.cast(pa.binary())])
            yield pa.ListArray.from_arrays(
                np.arange(len(found) + 1, dtype=np.int32) * found.shape[1], pa.array(found.ravel()))

    return docs.withColumn(name, score(whole_text(docs, text)))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, folds: int = 5,
                   rules: SubwordRules = SubwordRules()) -> DataFrame:
    """doc_id, held_out, score, predicted; labels of held-out documents are never read into the model."""
    learned = labels.where(id_remainder(labels["doc_id"], folds) != 0)
    model = train(docs, learned, "quality", (0, 1), rules)
    thin = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text"))
    scored = probabilities(thin, model)
    score = F.col("probabilities")[1]
    return scored.select("doc_id", (id_remainder(F.col("doc_id"), folds) == 0).alias("held_out"),
                         score.alias("score"), F.when(score >= threshold, 1).otherwise(0).alias("predicted"))
