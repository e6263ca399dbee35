"""Append-only audit logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark import schemas
from riskspark.functions.rows import numbered

# Fixed value: a log rotates before a segment exceeds this size.
MAX_SEGMENT_BYTES = 1024 * 1024


def read_audit(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """S7. Events of JSON-lines segments at ``<path>/<log>/<segment>``, in segment and line order.

    A segment is bounded by rotation and is read as one value, which is what gives every event its
    line number; segments spread over tasks. Lines that are not events keep ``malformed = true``.
    """
    reader = spark.readStream if streaming else spark.read
    segments = reader.format("text").option("wholetext", True).option("recursiveFileLookup", True).load(path).select(
        F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1).alias("log"),
        F.col("_metadata.file_name").alias("segment"),
        "value",
    )
    lines = numbered(segments, F.split("value", "\n"), "line_no", "line").where(F.length("line") > 0)
    event = F.from_json("line", schemas.AUDIT_EVENT)
    return lines.withColumn("e", event).select(
        "log", "segment", (F.col("line_no") + 1).alias("line_no"), F.col("e.event_id").isNull().alias("malformed"), "e.*"
    )
