"""Audit checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskspark.functions.hashing import canonical_json, hmac_sha256

# Fixed values.
COMPLETIONS = ("mutation_committed", "recovery_committed", "recovery_aborted")
MAC_DOMAIN = b"riskspark/audit/record/v1\0"
SIGNED_FIELDS = (
    "event_id", "ts", "event", "operation", "operation_id", "challenge_id", "entry_id", "outcome", "error_code",
    "prepared_event_id", "before_digest", "after_digest", "previous_mac",
)


def unmatched_prepares(audit: DataFrame) -> DataFrame:
    """J13. Prepared mutations no completion refers to."""
    completed = audit.where(F.col("event").isin(*COMPLETIONS) & F.col("prepared_event_id").isNotNull()).select(
        F.col("prepared_event_id").alias("event_id")
    )
    return audit.where("event = 'mutation_prepared'").join(completed, "event_id", "left_anti").select(*audit.columns)


def recovery_status(prepares: DataFrame, state: DataFrame) -> DataFrame:
    """J16. Did an unfinished mutation reach the store? ``state`` has ``entry_id, digest``."""
    same = F.col("before_digest") == F.col("after_digest")
    status = (
        F.when(same | F.col("digest").isNull(), "needs_review")
        .when(F.col("digest") == F.col("after_digest"), "recovery_committed")
        .when(F.col("digest") == F.col("before_digest"), "recovery_aborted")
        .otherwise("needs_review")
    )
    return prepares.join(state, "entry_id", "left").withColumn("status", status)


def record_mac(key: bytes):
    """MAC over the signed fields of a record."""
    fields = {name: F.col(name) for name in SIGNED_FIELDS}
    return hmac_sha256(F.concat(F.lit(bytearray(MAC_DOMAIN)), F.encode(canonical_json(fields), "UTF-8")), key)


def verify_chain(audit: DataFrame, key: bytes) -> DataFrame:
    """W6. Per event: does it link to the event before it, and is its MAC right?

    A line's predecessor is the line before it in its segment, found by equality on (log, segment,
    line), so one long log still spreads over all tasks. Only the last line of each segment, one
    small row per segment, is ordered within its log.
    """
    columns = ["log", "segment", "line_no", "event_id", "previous_mac", "record_mac"]
    lines = audit.withColumn("mac_ok", F.col("record_mac") == record_mac(key)).select(*columns, "mac_ok")
    before = audit.select(
        "log", "segment", (F.col("line_no") + 1).alias("line_no"), F.col("record_mac").alias("line_before")
    )
    edges = audit.groupBy("log", "segment").agg(F.max_by("record_mac", "line_no").alias("last_mac"), F.min("line_no").alias("line_no"))
    carried = edges.withColumn(
        "segment_before", F.lag("last_mac").over(Window.partitionBy("log").orderBy("segment"))
    ).select("log", "segment", "line_no", "segment_before")
    linked = lines.join(before, ["log", "segment", "line_no"], "left").join(
        carried, ["log", "segment", "line_no"], "left"
    )
    expected = F.coalesce("line_before", "segment_before")
    return linked.select(
        "log",
        "segment",
        "line_no",
        "event_id",
        F.coalesce(expected.isNull() | (F.col("previous_mac") == expected), F.lit(False)).alias("link_ok"),
        F.coalesce("mac_ok", F.lit(False)).alias("mac_ok"),
    )
