"""Session settings and the small set of physical helpers the library shares."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_LIMIT = 64 * 1024 * 1024
MAX_SALTS = 1024
#: Bytes of rows that go to a Python worker at once, whatever the texts' lengths.
BATCH_BYTES = 4 << 20
#: Shuffle files of a finished action are deleted.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app: str = "habitus", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and skew-join splitting on, UTC clock."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        # Contents join to a choice of files: filter their scan by the choice first.
        "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
        "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "1g",
        "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "1g",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder of ``spark.checkpoint.dir``.

    Used where a result is read more than once and recomputing it would repeat
    a scan of file contents.  What was shuffled on the way is deleted once the
    result is written; else it stays until the driver collects its garbage.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        # a frame takes the setting when it is made
        return df.select("*").checkpoint(eager=True)
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, ``spark.checkpoint.dir``.

    A private one is set only for a local session that has none; on a cluster
    its absence is an error, since a machine's own folder is lost with it.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="habitus-ckpt-"))
        folder = context.getCheckpointDir()
    return folder


def bounded_batches(spark: SparkSession) -> None:
    """Batches for Python of a few megabytes, unless the cluster's settings name a size."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not spark.sparkContext.getConf().contains(name):
        spark.conf.set(name, BATCH_BYTES)


def salts(df: DataFrame) -> int:
    """How many slices a possibly hot group is cut into: one per shuffle partition."""
    wanted = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, min(wanted, MAX_SALTS))


def salt(df: DataFrame, *columns: str | Column) -> Column:
    """A slice number derived from row values, so a retried task repeats it."""
    return F.pmod(F.xxhash64(*columns), F.lit(salts(df))).cast("int")


def measured_bytes(df: DataFrame) -> int:
    """Actual payload size of a narrow table, by one aggregate."""
    width = F.lit(16)
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            width = width + F.coalesce(F.octet_length(column), F.lit(0))
        elif isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            width = width + F.coalesce(F.octet_length(F.to_json(column)), F.lit(0))
        else:
            width = width + 8
    return df.agg(F.coalesce(F.sum(width), F.lit(0))).first()[0]


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_LIMIT) -> DataFrame | None:
    """The table with a broadcast hint when its measured size allows, else None."""
    return F.broadcast(df) if measured_bytes(df) <= limit else None
