"""Mixing sources to target weights, on DataFrame functions alone.

Words are counted per source, targets are set by weight, and a source's rate is target over size. A document goes
out floor(rate) times, plus once more when a number in [0, 1) falls in an arc as long as the
fraction. The number is hashed from doc_id and text, so rows without a doc_id draw apart, and it is the same in every
run. Where the arc starts is chosen per source out of ``arcs`` evenly
spaced starts, the one whose words come nearest to the target: for each start every document has its chance equal to
the fraction, and one aggregate over the documents weighs all starts at once.

Sources can be as many as sites: their order and running sums come from range partitions and one row for each.

Defined results: a null text has size 0; a null source is a source of its own, last in order; a null doc_id hashes
like the word null; rows of equal doc_id and text are counted each on its own and draw alike. Sources of size 0 get target
0. Only doc_id, source and text are read; the other columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from deltawarden.llm.common import WHITE, WORD, same, whole_text
from deltawarden.session import cut_lineage

WEIGHTS = (5, 2, 1)


def unit_hash(doc_id: Column, text: Column, seed: int) -> Column:
    """A number in [0, 1) from 48 bits of an MD5 hash; any SQL engine can make the same."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), F.md5(text))
    return F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("bigint") / F.lit(float(1 << 48))


def count_words(text: Column) -> Column:
    """How many words a text has; no list of them is made, which would take many times the memory of the text.

    Every word becomes one letter together with the white space behind it; what is left before the first word goes.
    """
    letters = F.regexp_replace(text, rf"{WORD}[\x20\x09-\x0D]*", "x")
    return F.length(F.ltrim(letters, F.lit(WHITE))).cast("bigint")


def with_sums_before(rows: DataFrame, order: list[Column], values: dict[str, Column]) -> DataFrame:
    """Add for every value its sum over all rows that come earlier in a total order.

    Rows are dealt out by ranges of the order; only one row of sums per range meets in one place.
    """
    ranged = cut_lineage(rows.repartitionByRange(*order).withColumn("range_part", F.spark_partition_id()))
    sums = ranged.groupBy("range_part").agg(*[F.sum(v).alias(n) for n, v in values.items()])
    earlier = Window.orderBy("range_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    starts = sums.select(F.col("range_part").alias("of_part"), *[
        F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"{n}_start") for n in values])
    inside = Window.partitionBy("range_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return ranged.join(starts, F.col("range_part") == F.col("of_part")).select(
        *rows.columns, *[(F.col(f"{n}_start") + F.coalesce(F.sum(v).over(inside), F.lit(0))).alias(n)
                         for n, v in values.items()])


def source_sizes(docs: DataFrame, source: str, size: str) -> DataFrame:
    """source, source_size; one row per source, the null source included."""
    return docs.groupBy(docs[source].alias("source")).agg(F.sum(size).alias("source_size"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """Add weight and target to source sizes.

    Weights go round by code point of the source. The target is the smaller of ``most`` times the size and one common
    level times the weight. With sources ordered by size per weight, those before some point reach their limit first,
    and the level is what is left over the weights that remain.
    """
    # Spark compares strings by their UTF-8 bytes, which is the order of code points.
    by_name = F.col("source").asc_nulls_last()
    turn = F.pmod(F.col("place"), F.lit(len(weights))).cast("int")
    weighed = with_sums_before(sizes, [by_name], {"place": F.lit(1)}).withColumn(
        "weight", F.element_at(F.array(*[F.lit(w) for w in weights]), turn + 1)).drop("place")
    ratio = F.col("source_size") / F.col("weight")
    ordered = with_sums_before(weighed, [ratio.asc(), by_name], {"full": F.col("source_size"), "taken": F.col("weight")})
    ordered = cut_lineage(ordered)
    total, weight = ordered.agg(F.sum("source_size"), F.sum("weight")).first()
    level = (F.lit(total) - most * F.col("full")) / (F.lit(weight) - F.col("taken"))
    # The first source that stays below its limit fixes the level; if none does, every source is at its limit.
    first = ordered.select(ratio.alias("ratio"), F.col("source").isNull().alias("last"), "source", level.alias("level")).where(
        F.col("level") * ordered["weight"] <= most * ordered["source_size"]).agg(
        F.min(F.struct("ratio", "last", "source", "level"))).first()[0]
    limit = (most * F.col("source_size")).cast("double")
    common = F.lit(first["level"] if first else None).cast("double") * F.col("weight")
    return ordered.select("source", "source_size", "weight", F.coalesce(F.least(limit, common), limit).alias("target"))


def _extra(hashed: Column, fraction: Column, arc: Column, arcs: int) -> Column:
    """1 if the hashed number lies in the arc of the fraction's length that starts at arc / arcs, around the circle."""
    turned = hashed - arc / F.lit(float(arcs))
    return F.when(turned - F.floor(turned) < fraction, 1).otherwise(0)


def goals(thin: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3, arcs: int = 64) -> DataFrame:
    """Per source: source_size, target, base (whole copies), fraction and arc; from rows of source, size, hashed.

    One row per source, written as a table, so that Spark knows its size when it joins it.
    """
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rates = cut_lineage(targets(source_sizes(thin, "source", "size"), weights, most).select(
        F.col("source").alias("goal_source"), "source_size", "target",
        F.least(F.floor(rate), F.lit(most)).cast("bigint").alias("base"), (rate - F.floor(rate)).alias("fraction")))
    taken = thin.join(rates, same(thin["source"], F.col("goal_source"))).groupBy(*rates.columns).agg(*[
        F.sum(F.col("size") * _extra(F.col("hashed"), F.col("fraction"), F.lit(float(a)), arcs)).alias(f"arc_{a}")
        for a in range(arcs)])
    misses = F.array(*[
        F.struct(F.abs(F.col("base") * F.col("source_size") + F.col(f"arc_{a}") - F.col("target")).alias("miss"),
                 F.lit(a).alias("arc")) for a in range(arcs)])
    return cut_lineage(taken.select(*rates.columns, F.array_min(misses)["arc"].alias("arc")))


def copies(goal: DataFrame, hashed: Column, arcs: int = 64) -> Column:
    """How often a row goes out, once it is joined to the goals of its source."""
    return goal["base"] + _extra(hashed, goal["fraction"], goal["arc"].cast("double"), arcs)


def sized(docs: DataFrame, seed: int = 42, doc_id: str = "doc_id", source: str = "source",
          text: str = "text") -> DataFrame:
    """doc_id, source, size in words and the hashed number of every row, written once; texts go no further.

    The thin rows are dealt out again before they are written: a few full files instead of one for each split of the texts.
    """
    whole = whole_text(docs, text)
    return cut_lineage(docs.select(
        docs[doc_id].alias("doc_id"), docs[source].cast("string").alias("source"), count_words(whole).alias("size"),
        unit_hash(docs[doc_id], whole, seed).alias("hashed")).hint("rebalance"))


def plan_mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3, seed: int = 42,
             arcs: int = 64) -> DataFrame:
    """doc_id, source, size, source_size, target and copies of every document."""
    thin = sized(docs, seed)
    goal = goals(thin, weights, most, arcs)
    return thin.join(goal, same(thin["source"], goal["goal_source"])).select(
        "doc_id", "source", "size", "source_size", "target",
        copies(goal, thin["hashed"], arcs).cast("bigint").alias("copies"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3, seed: int = 42, arcs: int = 64,
        doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The mixed corpus: every row as often as it is drawn, with the columns it came with.

    A row's copies follow from its doc_id, its text and the goals of its source, so texts are read once more and not
    shuffled where Spark broadcasts the goals.
    """
    goal = goals(sized(docs, seed, doc_id, source, text), weights, most, arcs)
    key, drawn_by, whole = "goal_key", "goal_hashed", F.struct(*[docs[c] for c in docs.columns])
    rows = docs.select(whole.alias("whole"), docs[source].cast("string").alias(key),
                       unit_hash(docs[doc_id], whole_text(docs, text), seed).alias(drawn_by))
    drawn = rows.join(goal, same(rows[key], goal["goal_source"])).select(
        "whole", copies(goal, rows[drawn_by], arcs).alias("copies"))
    return drawn.where("copies > 0").select(
        "whole", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("whole.*")
