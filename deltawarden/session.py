"""Session settings and the one place where lineage is cut."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# What a cluster run should carry; every value can be overridden by the submitter.
RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

# Explicit broadcasts happen only below this many bytes, measured on the data itself.
BROADCAST_LIMIT_BYTES = 32 * 1024 * 1024


def build_session(app_name: str = "deltawarden", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**RECOMMENDED_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def _configured_folder(spark: SparkSession) -> str | None:
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()


def local_scratch(spark: SparkSession) -> None:
    """Name a checkpoint folder for a session that runs in one process and has none.

    For entry points and tests; the folder goes when the process ends. On a cluster, ``spark.checkpoint.dir`` must name a folder all executors share.
    """
    context = spark.sparkContext
    in_process = context.master == "local" or context.master.startswith("local[")
    if in_process and not _configured_folder(spark):
        folder = f"{tempfile.gettempdir()}/deltawarden-{os.getpid()}"
        context.setCheckpointDir(folder)
        atexit.register(shutil.rmtree, folder, ignore_errors=True)


def scratch_root(spark: SparkSession) -> str:
    """This application's own folder for intermediate tables, below ``spark.checkpoint.dir``."""
    configured = _configured_folder(spark)
    if not configured:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return f"{configured.rstrip('/')}/deltawarden-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the application's folder."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Remove the intermediate tables of this application. Results that still read them must be used up before."""
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    root.getFileSystem(hadoop).delete(root, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows to a table below the shared checkpoint folder and read them from there.

    Survives the loss of any executor, keeps plans short, and unlike ``checkpoint()``
    stays columnar and lets the optimizer see the size.
    """
    path = scratch_path(df.sparkSession, "step")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# What ``cut_large`` sets while it writes.
TIDY = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    # Buckets of one sorted file are read as sorted; others still are sorted.
    "spark.sql.legacy.bucketedTableScan.outputOrdering": "true",
}


def cut_large(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``cut_lineage`` for tables that outgrow the input: in denser files, and what was shuffled to make them is removed
    once they are written, not when the driver next collects garbage.

    With ``keys`` the rows lie, sorted, in as many buckets as a shuffle has partitions. The next ``cut_large`` joins and
    groups them by exactly these keys without a shuffle or a sort. Spark knows buckets by a catalog entry only; it goes
    as soon as it is read.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, "step")
    before = {name: spark.conf.get(name, None) for name in TIDY}
    for name, value in TIDY.items():
        spark.conf.set(name, value)
    try:
        if not keys:
            df.write.option("compression", "zstd").parquet(path)
            return spark.read.schema(df.schema).parquet(path)
        count, entry = shuffle_partitions(spark), f"spark_catalog.default.step_{uuid.uuid4().hex}"
        df.repartition(count, *keys).write.bucketBy(count, *keys).sortBy(*keys).format("parquet").option(
            "compression", "zstd").option("path", path).saveAsTable(entry)
        try:
            return spark.table(entry)
        finally:
            spark.sql(f"DROP TABLE {entry}")  # an external table: its files stay
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def shuffle_partitions(spark: SparkSession) -> int:
    """Into how many partitions Spark shuffles before any are joined."""
    adaptive = spark.conf.get("spark.sql.adaptive.enabled", "true").lower() == "true"
    first = spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None) if adaptive else None
    return int(first or spark.conf.get("spark.sql.shuffle.partitions", "200"))


def discard(df: DataFrame, *kept: DataFrame) -> None:
    """Remove the files of tables that ``cut_lineage`` or ``cut_large`` wrote and that nothing reads any more, but not
    those that ``kept`` read. What lies outside the application's folder stays."""
    spark = df.sparkSession
    own = f"{scratch_root(spark).rsplit('/', 1)[1]}/step-"
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    folders, others = ({f.rsplit("/", 1)[0] for d in ds for f in d.inputFiles()} for ds in ((df,), kept))
    for folder in (f for f in folders - others if own in f):
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(hadoop).delete(path, True)


def grows(df: DataFrame) -> DataFrame:
    """Mark a side of a join that grows with the data, so that it is never broadcast.

    Spark judges a table by its compressed size; key and name columns take many times that in the driver's memory.
    """
    return df.hint("merge")


def meet(left: DataFrame, right: DataFrame, keys: list[str], texts: list[str], how: str = "inner") -> DataFrame:
    """``left.join(grows(right), keys, how)`` by a hash of the ``texts`` among the keys, then by the keys.

    Names share long beginnings ("urn:li:dataset:("): sorted by a number first, they are hardly ever compared.
    """
    hashed = {"_spot": F.xxhash64(*texts)}
    return left.withColumns(hashed).join(grows(right.withColumns(hashed)), ["_spot", *keys], how).drop("_spot")


SPREAD = 16


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a scan to tasks before costly per-row work: as many as there are cores, or ``SPREAD`` for each of
    the scan's splits, so that tasks stay short when the files are compact or of one row group.

    For plain scans only: counting the splits of a plan with shuffles would run them.
    """
    splits = df.rdd.getNumPartitions()
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, SPREAD * splits if splits > 1 else 1))


def settle(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that are computed once per row.

    The optimizer merges neighbouring projections; a column read inside a lambda
    would then be computed anew for every array element. A one-row ``inline`` sits
    between the two and keeps the value.
    """
    row = F.struct(*[value.alias(name) for name, value in columns.items()])
    return df.select("*", F.inline(F.array(row)))


def with_key(df: DataFrame, keys: dict[str, Column | str]) -> DataFrame:
    """Prepend constant or derived key columns."""
    added = [(value if isinstance(value, Column) else F.lit(value)).alias(name) for name, value in keys.items()]
    return df.select(*added, *[c for c in df.columns if c not in keys])
