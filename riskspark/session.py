"""Session set-up and the two scale helpers every operator shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Most rows and bytes a side may have to be broadcast by hint; beyond either the join shuffles.
BROADCAST_ROW_LIMIT = 200_000
BROADCAST_BYTE_LIMIT = 64 * 1024 * 1024


def build_session(app: str = "riskspark", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the operators assume; cluster settings win over these."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Call sites of column expressions are not recorded: the rule catalogue has thousands.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach: ``spark.checkpoint.dir`` of the session, else the
    checkpoint folder the application has set.

    Only a local master may fall back to a temporary folder: on a cluster a driver-local folder
    would not survive the loss of an executor.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not configured:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        configured = tempfile.mkdtemp(prefix="riskspark-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(configured)
    return configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder for a table written and read back in one plan."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and drop its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Have the files of shuffles removed that nothing needs. Spark does so when the driver's heap no longer refers to them, and an
    idle driver may not collect its heap for half an hour."""
    spark.sparkContext._jvm.System.gc()


def cut_columns(*parts: DataFrame) -> DataFrame:
    """Like ``cut``, for large frames: a compressed columnar table, built part by part, which takes less than half the disk of rows.

    Dictionaries are off: names and paths hardly repeat, and zstd finds what does. Shuffles of a part go before the next.
    """
    spark, path = parts[0].sparkSession, scratch_path(parts[0].sparkSession, "cut")
    for i, part in enumerate(parts):
        if i:
            release(spark)
        part.write.mode("append").options(**{"compression": "zstd", "parquet.enable.dictionary": "false"}).parquet(path)
    return spark.read.schema(parts[0].schema).parquet(path)


def fits_broadcast(df: DataFrame, limit: int = BROADCAST_ROW_LIMIT, max_bytes: int = BROADCAST_BYTE_LIMIT) -> bool:
    """Measure rows and bytes of ``df``; at most ``limit + 1`` rows are looked at."""
    size = F.sum(F.octet_length(F.to_json(F.struct("*"))))
    found = df.limit(limit + 1).agg(F.count("*").alias("rows"), F.coalesce(size, F.lit(0)).alias("bytes")).first()
    return found.rows <= limit and found.bytes <= max_bytes


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROW_LIMIT) -> DataFrame:
    """Hint a broadcast only for a side measured to be small; a larger side stays unhinted, so the
    join shuffles it (with adaptive skew handling) instead."""
    return F.broadcast(df) if fits_broadcast(df, limit) else df
