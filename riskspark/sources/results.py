"""Stored scan results (S8) and their use."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskspark.schemas import RESULT_KEY
from riskspark.session import cut

BUCKETS = 64
REUSABLE = ("ALLOW", "WARN")
# Life and size of a remote result store.
TTL_SECONDS = 3600
MAX_ENTRIES = 64
MAX_TOTAL_BYTES = 8 * 1024 * 1024


def _bucket() -> Column:
    return F.pmod(F.xxhash64(*[F.coalesce(F.col(k), F.lit("\0")) for k in RESULT_KEY]), F.lit(BUCKETS)).cast("int")


def latest_per_key(results: DataFrame) -> DataFrame:
    """W4 without a lifetime: newest entry of each key, by partial aggregation.

    Of entries with the same time the content decides, so the choice does not depend on the order of rows.
    """
    rest = [c for c in results.columns if c not in RESULT_KEY]
    newest = results.groupBy(*RESULT_KEY).agg(
        F.max_by(F.struct(*rest), F.struct("created_at", F.xxhash64(*[c for c in rest if c != "bucket"]))).alias("r")
    )
    return newest.select(*RESULT_KEY, *[F.col(f"r.{c}").alias(c) for c in rest]).select(*results.columns)


def read_scan_results(spark: SparkSession, path: str) -> DataFrame | None:
    """Stored results; ``None`` where nothing has been stored yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        # No folder, or one without a file: what was written so far held nothing that may be reused.
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def write_scan_results(results: DataFrame, path: str) -> None:
    """S8. Keep ALLOW and WARN results, replacing entries with the same key.

    The table is partitioned by a hash of the key; only partitions that receive results are read,
    merged and overwritten.
    """
    fresh = cut(results.where(F.col("decision").isin(*REUSABLE)).withColumn("bucket", _bucket()))
    touched = [row.bucket for row in fresh.select("bucket").distinct().collect()]  # at most BUCKETS rows
    stored = read_scan_results(results.sparkSession, path)
    if stored is not None:
        fresh = cut(fresh.unionByName(stored.where(F.col("bucket").isin(touched)).select(*fresh.columns)))
    merged = latest_per_key(fresh)
    (
        merged.repartition("bucket")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("bucket")
        .parquet(path)
    )


def _same_key(left: str, right: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in RESULT_KEY])


def lookup_scan_result(keys: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """J4. Keys with a reusable stored result, and keys that must be scanned."""
    usable = latest_per_key(cache.where(F.col("decision").isin(*REUSABLE)))
    extra = [c for c in usable.columns if c not in RESULT_KEY and c not in keys.columns]
    hits = keys.alias("k").join(usable.alias("c"), _same_key("k", "c")).select("k.*", *[f"c.{c}" for c in extra])
    misses = keys.alias("k").join(usable.alias("c"), _same_key("k", "c"), "left_anti")
    return hits, misses


def latest_result(results: DataFrame, now: Column | None = None, ttl_seconds: int = TTL_SECONDS) -> DataFrame:
    """W4. Newest live entry of each key; ``now`` is a parameter so results are reproducible."""
    live = results
    if now is not None:
        live = results.where(F.col("created_at") + F.make_dt_interval(secs=F.lit(ttl_seconds)) > now)
    return latest_per_key(live)


def retain_results(
    results: DataFrame,
    entries: int = MAX_ENTRIES,
    max_bytes: int = MAX_TOTAL_BYTES,
    by: list[str] | None = None,
) -> DataFrame:
    """W5. Per store (``by``), the newest ``entries``, then the newest that fit ``max_bytes``.

    The ranked limit is applied before the shuffle, so the running size is summed over at most
    ``entries`` rows. ``size_bytes`` is the stored size.
    """
    keys = by or []
    if not keys:
        newest = results.orderBy(F.desc("created_at"), *RESULT_KEY).limit(entries)
        window = Window.orderBy(F.desc("created_at"), *RESULT_KEY)
    else:
        rank = Window.partitionBy(*keys).orderBy(F.desc("created_at"), *RESULT_KEY)
        newest = results.withColumn("_rn", F.row_number().over(rank)).where(F.col("_rn") <= entries).drop("_rn")
        window = rank
    running = F.sum("size_bytes").over(window.rowsBetween(Window.unboundedPreceding, 0))
    return newest.withColumn("running_bytes", running).where(F.col("running_bytes") <= max_bytes)
