"""Token counts of documents in flat token files that have no index.

A flat file is token ids one after another, each document closed by an end-of-document id. Files are cut into blocks
at fixed offsets, whatever the documents do. Each block is searched for the id at once, as an array. A document that
crosses blocks is put together from the counts: how many ends came before a block gives the number of its documents,
the last end before it gives where its first document starts. Both come from a prefix scan over one small row per
block. So a file of any size is counted by many tasks, and a document may span any number of blocks.

Defined results: an empty file has no documents; ids after the last end form one more document, marked as not
terminated; two ends in a row enclose a document of 0 tokens. Files whose size is no multiple of the id size are an
error. A null text is written as a document of 0 tokens; repeated rows are documents of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from deltawarden.llm.common import whole_text
from deltawarden.llm.tokens import text_ids, word_ids
from deltawarden.session import cut_lineage


def _open(path: str):
    """The file system of a path and the path in it, as the executors reach it."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), unquote("/" + path[5:].lstrip("/"))
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def write_token_files(docs: DataFrame, folder: str, tokenizer: str = "word_bpe_49k.json", end: int = 49407,
                      dtype: str = "<u2", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write one flat file per task; return doc_id, file, doc_index of every document, as a written table.

    A token id that ``dtype`` cannot hold is an error: it would be written as another id, or as a separator. The
    strings of special tokens in a text are ordinary text, so the end id stands only between documents. A file is
    written under a name of its attempt and then renamed, so a task that runs again leaves the same file.
    """
    rows = docs.select(docs[doc_id].alias("doc_id"), whole_text(docs, text).alias("text"))
    key = rows.schema["doc_id"].dataType.simpleString()
    most = np.iinfo(dtype).max
    if not 0 <= end <= most:
        raise ValueError(f"the end id {end} does not fit {dtype}")
    mark = np.array([end], dtype).tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name = f"tokens-{task.partitionId():06d}.bin"
        system, root = _open(folder)
        system.create_dir(root, recursive=True)
        own = f"{root}/_{name}.{task.taskAttemptId()}"
        table, count = word_ids(tokenizer, plain_specials=True), 0
        with system.open_output_stream(own) as out:
            for batch in batches:
                for item in batch.column(1):
                    ids = np.frombuffer(text_ids(item.as_py(), table), "<u4")
                    if ids.max(initial=0) > most:
                        raise ValueError(f"token id {ids.max()} does not fit {dtype}; use a wider type")
                    out.write(ids.astype(dtype).tobytes() + mark)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([name] * batch.num_rows, pa.string()),
                     pa.array(np.arange(count, count + batch.num_rows))], ["doc_id", "file", "doc_index"])
                count += batch.num_rows
        system.move(own, f"{root}/{name}")

    return cut_lineage(rows.mapInArrow(write, f"doc_id {key}, file string, doc_index bigint"))


def flat_blocks(spark: SparkSession, folder: str, dtype: str = "<u2", block_tokens: int = 1 << 22) -> DataFrame:
    """file, block, start, n_tokens of every block; reads names and sizes only."""
    width = np.dtype(dtype).itemsize
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(folder).select(
        "path", F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "length")
    odd = F.raise_error(F.concat(F.lit("not a whole number of token ids: "), F.col("path")))
    total = F.when(F.col("length") % width == 0, (F.col("length") / width).cast("bigint")).otherwise(
        odd.cast("bigint"))
    sized = files.select("path", "file", total.alias("total")).where("total > 0")
    last = ((F.col("total") - 1) / F.lit(block_tokens)).cast("bigint")
    start = F.col("block") * F.lit(block_tokens)
    return sized.select("path", "file", "total", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias(
        "block")).select("path", "file", "block", start.alias("start"),
                         F.least(F.lit(block_tokens).cast("bigint"), F.col("total") - start).alias("n_tokens"))


def scan_blocks(blocks: DataFrame, end: int, dtype: str = "<u2") -> DataFrame:
    """file, block, start, n_tokens, ends: positions of the end id within each block."""
    width = np.dtype(dtype).itemsize

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in ("path", "start", "n_tokens")}
                system, path = _open(row["path"])
                with system.open_input_file(path) as source:
                    data = source.read_at(row["n_tokens"] * width, row["start"] * width)
                ends = np.flatnonzero(np.frombuffer(data, dtype) == end).astype(np.int32)
                one = batch.slice(i, 1)
                yield pa.RecordBatch.from_arrays(
                    [one.column(c) for c in ("file", "block", "start", "n_tokens")]
                    + [pa.ListArray.from_arrays(pa.array([0, len(ends)], pa.int32()), pa.array(ends))],
                    ["file", "block", "start", "n_tokens", "ends"])

    return blocks.repartition("file", "block").mapInArrow(
        work, "file string, block bigint, start bigint, n_tokens bigint, ends array<int>")


def stitched(scanned: DataFrame) -> DataFrame:
    """file, doc_index, start, n_tokens, terminated of every document; scanned is a written table."""
    thin = scanned.select(
        "file", "block", F.size("ends").cast("bigint").alias("n_ends"), (F.col("start") + F.col("n_tokens")).alias(
            "stop"), F.when(F.size("ends") > 0, F.col("start") + F.element_at("ends", -1)).alias("last_end"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = thin.select("file", "block", F.coalesce(F.sum("n_ends").over(before), F.lit(0)).alias("ends_before"),
                          F.last("last_end", ignorenulls=True).over(before).alias("end_before"))
    joined = scanned.join(carried, ["file", "block"])
    # A document starts after the end before it, in this block or an earlier one.
    starts = F.concat(F.array(F.coalesce(F.col("end_before") + 1, F.lit(0).cast("bigint"))), F.transform(
        "ends", lambda e: F.col("start") + e + 1))
    closed = joined.select(
        "file", "ends_before", F.posexplode(F.arrays_zip(
            F.slice(starts, F.lit(1), F.size("ends")).alias("from"),
            F.transform("ends", lambda e: F.col("start") + e).alias("to"))).alias("i", "d")).select(
        "file", (F.col("ends_before") + F.col("i")).alias("doc_index"), F.col("d.from").alias("start"),
        (F.col("d.to") - F.col("d.from")).alias("n_tokens"), F.lit(True).alias("terminated"))
    tails = thin.groupBy("file").agg(
        F.sum("n_ends").alias("doc_index"), F.max("stop").alias("stop"),
        F.coalesce(F.max("last_end") + 1, F.lit(0).cast("bigint")).alias("start")).where("start < stop").select(
        "file", "doc_index", "start", (F.col("stop") - F.col("start")).alias("n_tokens"),
        F.lit(False).alias("terminated"))
    return closed.unionByName(tails)


def document_counts(spark: SparkSession, folder: str, end: int = 49407, dtype: str = "<u2",
                    block_tokens: int = 1 << 22) -> DataFrame:
    """Token counts of all documents in the flat files of a folder."""
    return stitched(cut_lineage(scan_blocks(flat_blocks(spark, folder, dtype, block_tokens), end, dtype)))
