"""The registered queries of this subpackage: each operator over the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from deltawarden.llm import (
    compression, fingerprints, mixing, negatives, packing, phrases, preferences, revisits, separators, simhash,
    substrings, subwords, tagpaths)
from deltawarden.llm.common import table
from deltawarden.llm.oracles import ORACLES  # noqa: F401 - registered with the queries
from deltawarden.session import scratch_path


def captures(pages: DataFrame) -> DataFrame:
    """Archive records made from pages: a full response per page, and a not-modified revisit of it.

    The revisit writes the URL in another way and may come before the response; its validators are right, weak,
    absent, wrong or a date only, by page_id.
    """
    day = F.pmod(F.col("page_id") * 7919, F.lit(365))
    when = F.timestamp_seconds(F.lit(1700000000) + day * 86400 + F.pmod("page_id", F.lit(86400)))
    tag = F.concat(F.lit('"'), F.substring(F.md5(F.coalesce("html", F.lit(""))), 1, 16), F.lit('"'))
    changed = F.concat(F.lit("day "), day.cast("string"))

    def named(name: str, value) -> F.Column:
        return F.struct(F.lit(name).alias("name"), F.lit(value).cast("string").alias("value"))

    stored = F.array(named("Content-Type", "text/html"), named("ETag", tag), named("Last-Modified", changed),
                     named("Content-Length", F.length(F.coalesce("html", F.lit("")))), named("Cache-Control", "no-store"))
    case = F.pmod("page_id", F.lit(5))
    proof = (F.when(case == 0, F.array(named("etag", tag)))
             .when(case == 1, F.array(named("ETag", F.concat(F.lit("W/"), tag)), named("Last-Modified", changed)))
             .when(case == 2, F.array(named("X-Cache", "hit")))
             .when(case == 3, F.array(named("ETag", '"other"'))).otherwise(F.array(named("Last-Modified", changed))))
    sent = F.concat(proof, F.array(named("Content-Length", "0"), named("cache-control", "max-age=60"),
                                   named("Connection", "X-Hop, close"), named("X-Hop", "1")))
    later = F.timestamp_seconds(F.unix_seconds(when) + (F.pmod("page_id", F.lit(11)) - 2) * 86400)
    other = F.concat(F.regexp_replace("url", "^https?://", "HTTPS://www."), F.when(
        F.col("url").contains("#"), "").otherwise("#again"))
    response = pages.select(
        (F.col("page_id") * 2).alias("record_id"), F.lit("response").alias("warc_type"),
        F.lit(None).cast("string").alias("profile"), F.col("url").alias("target_uri"), when.alias("captured_at"),
        F.lit(200).alias("http_status"), stored.alias("http_headers"))
    revisit = pages.select(
        (F.col("page_id") * 2 + 1).alias("record_id"), F.lit("revisit").alias("warc_type"),
        F.lit("http://netpreserve.org/warc/1.1/revisit/server-not-modified").alias("profile"),
        other.alias("target_uri"), later.alias("captured_at"), F.lit(304).alias("http_status"),
        sent.alias("http_headers"))
    return response.unionByName(revisit)


def op1_revisit_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    resolved = revisits.resolve_revisits(captures(table(spark, sf_dir, "pages")))
    lines = F.transform("headers", lambda h: F.concat_ws(": ", h["name"], h["value"]))
    return resolved.select(
        ((F.col("record_id") - 1) / 2).cast("bigint").alias("page_id"), "url_key", "status",
        (F.col("base_id") / 2).cast("bigint").alias("base_page_id"), F.concat_ws("\n", lines).alias("headers"))


def op2_tag_path_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tagpaths.main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("bigint"))


def op3_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged, name = compression.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", F.col(name)["n_words"].alias("n_words"), *[
        F.col(name)[c].alias(c) for c in (
            "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "ratio", "n_chunks",
            "n_low_chunks", "n_high_chunks", "reason", "kept")])


def op4_bin_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), capacity=2048, separator=0)


def op5_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.without_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op6_polynomial_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.deduplicate(table(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op7_target_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.plan_mix(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op8_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "tokens")
    written = separators.write_token_files(table(spark, sf_dir, "documents"), folder)
    counted = separators.document_counts(spark, folder)
    return written.join(counted, ["file", "doc_index"]).select(
        "doc_id", "n_tokens", "file", "doc_index", "start", "terminated")


def preference_sides(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chosen and rejected sides made from conversations: one answer of the rejected side has its words backwards.

    It is the last answer, or the first for every third conversation, so that later turns differ by what came before.
    """
    turns = conversations.select(F.col("conv_id").alias("pair_id"), "turn", "role", "text")
    answer = F.when(F.col("role") == "assistant", F.col("turn"))
    spoiled = turns.groupBy("pair_id").agg(F.when(
        F.pmod("pair_id", F.lit(3)) == 1, F.min(answer)).otherwise(F.max(answer)).alias("spoiled"))
    spoiled = spoiled.withColumnRenamed("pair_id", "of_pair")
    backwards = F.array_join(F.reverse(F.split("text", " ")), " ")
    rejected = turns.join(spoiled, F.col("pair_id").eqNullSafe(F.col("of_pair"))).select(
        "pair_id", "turn", "role", F.when((F.col("turn") == F.col("spoiled")) & (F.col("role") == "assistant"),
                                          backwards).otherwise(F.col("text")).alias("text"))
    return turns, rejected


def op9_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preferences.render_pairs(*preference_sides(table(spark, sf_dir, "conversations")))


def op10_vantage_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    digits = F.lower(F.lpad(F.hex("bits"), 16, "0"))
    return near.select("doc_id", digits.alias("fingerprint"), "component_id")


def op11_range_tree_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.pmod("vec_id", F.lit(7)) == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    return negatives.hard_negatives(negatives.quantised(rows.withColumn("label", label)))


def op12_misra_gries_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_subword_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subwords.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_revisit_resolution, op2_tag_path_ratios, op3_compression_bands, op4_bin_completion, op5_fm_index,
        op6_polynomial_fingerprints, op7_target_weights, op8_separator_scan, op9_preference_pairs, op10_vantage_tree,
        op11_range_tree_negatives, op12_misra_gries_phrases, op13_subword_quality)
}
