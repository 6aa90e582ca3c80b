"""Preference pairs for chat models, on DataFrame functions alone.

A pair is a chosen and a rejected conversation. Turns that both have in common from the start are the prompt, rendered
once; what follows is the chosen and the rejected completion, in which only what the assistant says is trained on.

Turns are compared as rows: one aggregate over (pair, turn, role, text) counts how often each side has a turn, the
first key that the sides have in different numbers is where the prompt ends, and all keys before it are the prompt. No
conversation is gathered, sorted in memory or compared with another, so a conversation of any length is spread over
the cluster. The result has one row per rendered turn; ``assemble`` joins the turns of pairs that fit in a row.

Defined results: turns of a side follow each other by turn number, then role, then text, nulls first, and a repeated
row is a turn of its own. A null text is empty and a null role is ``user`` when rendered, but null and empty differ in
the comparison. A side that ends early makes the prompt end there; equal sides are all prompt, with no completion rows.
Pairs of which one side is missing have an empty prompt. A null pair_id is a pair like others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from deltawarden.llm.common import same

# The marks of the chat template.
START, STOP = "<|im_start|>", "<|im_end|>"


def _heading(role: Column) -> Column:
    return F.concat(F.lit(START), F.coalesce(role, F.lit("user")), F.lit("\n"))


def turn_counts(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """pair_id, key (turn, role, text), n_chosen, n_rejected. Both inputs have pair_id, turn, role and text."""
    def side(df: DataFrame, is_chosen: int) -> DataFrame:
        return df.select(
            "pair_id", F.struct(F.col("turn").alias("turn"), F.col("role").alias("role"), F.col("text").alias("text"))
            .alias("key"), F.lit(is_chosen).alias("c"), F.lit(1 - is_chosen).alias("r"))

    return side(chosen, 1).unionByName(side(rejected, 0)).groupBy("pair_id", "key").agg(
        F.sum("c").alias("n_chosen"), F.sum("r").alias("n_rejected"))


def render_pairs(chosen: DataFrame, rejected: DataFrame, trained_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per rendered turn: pair_id, part (prompt, chosen, rejected), turn, role, copy, segment, and where the
    trained characters of the segment start and end (equal if nothing is trained)."""
    counts = turn_counts(chosen, rejected)
    differ = F.min(F.when(F.col("n_chosen") != F.col("n_rejected"), F.col("key")))
    ends = counts.groupBy("pair_id").agg(differ.alias("stop")).select(F.col("pair_id").alias("end_id"), "stop")
    keyed = counts.join(ends, same(counts["pair_id"], ends["end_id"]))
    # Of the first differing key, the copies that both sides have still belong to the prompt.
    before = F.col("stop").isNull() | (F.col("key") < F.col("stop"))
    both = F.least("n_chosen", "n_rejected")
    shared = F.when(before, F.col("n_chosen")).when(same(F.col("key"), F.col("stop")), both).otherwise(0)
    parts = F.array(
        F.struct(F.lit("prompt").alias("part"), F.lit(0).cast("bigint").alias("skip"), shared.alias("n")),
        F.struct(F.lit("chosen").alias("part"), shared.alias("skip"), (F.col("n_chosen") - shared).alias("n")),
        F.struct(F.lit("rejected").alias("part"), shared.alias("skip"), (F.col("n_rejected") - shared).alias("n")))
    each = keyed.select("pair_id", "key.*", F.explode(parts).alias("p")).where("p.n > 0").select(
        "pair_id", "p.part", "turn", "role", "text",
        F.explode(F.sequence(F.col("p.skip"), F.col("p.skip") + F.col("p.n") - 1)).alias("copy"))
    head, said = _heading(F.col("role")), F.coalesce(F.col("text"), F.lit(""))
    trained = (F.col("part") != "prompt") & F.col("role").isin(*trained_roles)
    start = F.length(head)
    return each.select(
        "pair_id", "part", "turn", "role", "copy", F.concat(head, said, F.lit(STOP + "\n")).alias("segment"),
        F.when(trained, start).otherwise(0).cast("bigint").alias("train_start"),
        F.when(trained, start + F.length(said) + len(STOP)).otherwise(0).cast("bigint").alias("train_end"))


def assemble(segments: DataFrame) -> DataFrame:
    """pair_id, prompt, chosen, rejected, and the trained spans of both completions; for pairs that fit in a row."""
    turn = F.struct("turn", "role", "segment", "copy", "train_start", "train_end")

    def ordered(part: str) -> Column:
        return F.sort_array(F.collect_list(F.when(F.col("part") == part, turn)))

    def text(name: str) -> Column:
        return F.concat_ws("", F.transform(name, lambda t: t["segment"])).alias(name)

    def spans(name: str) -> Column:
        start = F.struct(F.lit(0).cast("bigint").alias("at"),
                         F.array().cast("array<struct<train_start: bigint, train_end: bigint>>").alias("spans"))

        def add(state: Column, t: Column) -> Column:
            span = F.struct((state["at"] + t["train_start"]).alias("train_start"),
                            (state["at"] + t["train_end"]).alias("train_end"))
            return F.struct((state["at"] + F.length(t["segment"])).alias("at"), F.when(
                t["train_end"] > t["train_start"], F.concat(state["spans"], F.array(span))).otherwise(
                state["spans"]).alias("spans"))

        return F.aggregate(name, start, add, lambda s: s["spans"]).alias(f"{name}_spans")

    grouped = segments.groupBy("pair_id").agg(*[ordered(p).alias(p) for p in ("prompt", "chosen", "rejected")])
    return grouped.select("pair_id", text("prompt"), text("chosen"), text("rejected"), spans("chosen"),
                          spans("rejected"))
