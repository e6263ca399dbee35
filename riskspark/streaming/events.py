"""Structured Streaming over audit events and stored results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.operators.scan import ALL, scan
from riskspark.sources.results import write_scan_results

# Fixed values.
CHALLENGE_SECONDS = 300
MAX_ISSUES_PER_WINDOW = 32
ISSUE_WINDOW_SECONDS = 60
TOTAL_BUDGET_SECONDS = 90


def stream_findings(files: DataFrame, families=ALL) -> DataFrame:
    """T1. Each file that arrives is scanned once; no state."""
    return scan(files, families)


def stream_issue_rate(events: DataFrame, watermark: str, slide: str = "10 seconds") -> DataFrame:
    """T2. Windows of a minute with more issues than allowed (sliding approximation of T8)."""
    return (
        events.where("event = 'challenge_issued'")
        .withWatermark("ts", watermark)
        .groupBy(F.window("ts", f"{ISSUE_WINDOW_SECONDS} seconds", slide))
        .agg(F.count("*").alias("issues"))
        .where(F.col("issues") > MAX_ISSUES_PER_WINDOW)
        .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "issues")
    )


def _pair(events: DataFrame, watermark: str, how: str) -> DataFrame:
    issued = (
        events.where("event = 'challenge_issued'")
        .select(F.col("challenge_id"), F.col("ts").alias("issued_at"))
        .withWatermark("issued_at", watermark)
    )
    consumed = (
        events.where("event = 'challenge_consumed'")
        .select(F.col("challenge_id").alias("consumed_id"), F.col("ts").alias("consumed_at"))
        .withWatermark("consumed_at", watermark)
    )
    within = (
        (F.col("challenge_id") == F.col("consumed_id"))
        & (F.col("consumed_at") >= F.col("issued_at"))
        & (F.col("consumed_at") < F.col("issued_at") + F.expr(f"INTERVAL {CHALLENGE_SECONDS} SECONDS"))
    )
    return issued.join(consumed, within, how)


def stream_confirmations(events: DataFrame, watermark: str) -> DataFrame:
    """T3. Challenges consumed before they expire."""
    return _pair(events, watermark, "inner").select("challenge_id", "issued_at", "consumed_at")


def stream_expired(events: DataFrame, watermark: str) -> DataFrame:
    """T4. Challenges never consumed in time; a row appears once the watermark rules it out."""
    return _pair(events, watermark, "leftOuter").where("consumed_id IS NULL").select("challenge_id", "issued_at")


def stream_single_use(events: DataFrame, watermark: str) -> DataFrame:
    """T5. First consumption of each challenge."""
    return (
        events.where("event = 'challenge_consumed'")
        .withWatermark("ts", watermark)
        .dropDuplicatesWithinWatermark(["challenge_id"])
    )


def stream_event_counts(events: DataFrame, watermark: str, size: str = "1 hour") -> DataFrame:
    """T6. Events per window, name, outcome and error code."""
    return (
        events.withWatermark("ts", watermark)
        .groupBy(F.window("ts", size), "event", "outcome", "error_code")
        .agg(F.count("*").alias("events"))
        .select(F.col("window.start").alias("window_start"), "event", "outcome", "error_code", "events")
    )


def stream_sessions(events: DataFrame, watermark: str, gap_seconds: int = TOTAL_BUDGET_SECONDS) -> DataFrame:
    """T7. Events of an operation that follow each other within its time budget."""
    return (
        events.where("operation_id IS NOT NULL")
        .withWatermark("ts", watermark)
        .groupBy(F.session_window("ts", f"{gap_seconds} seconds"), "operation_id")
        .agg(F.count("*").alias("events"), F.max_by("event", "ts").alias("last_event"))
        .select(
            "operation_id",
            F.col("session_window.start").alias("session_start"),
            F.col("session_window.end").alias("session_end"),
            "events",
            "last_event",
        )
    )


def stream_live_results(results: DataFrame, path: str, checkpoint: str):
    """T9. Upsert arriving results into the stored table, newest wins; readers apply the lifetime."""

    def upsert(batch: DataFrame, _epoch: int) -> None:
        if not batch.isEmpty():
            write_scan_results(batch, path)

    return results.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def late_rows(query) -> int:
    """T11. Rows a finished query dropped because they were later than its watermark."""
    return sum(
        operator.numRowsDroppedByWatermark for progress in query.recentProgress for operator in progress.stateOperators
    )
