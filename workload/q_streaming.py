"""Streams: T1-T11. Each runs over files with ``availableNow`` and is compared with its batch twin."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.schemas import RESULT_KEY
from riskspark.session import scratch_path
from riskspark.streaming import events as SE
from riskspark.streaming import stateful as ST
from workload.q_rules import FOUND, OUT, R1
from workload.registry import Tables, define, query

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

# A month of events squeezed into about twenty minutes, so that rates and gaps matter.
define("fast", """
  SELECT event_id, user_id, event, outcome, error_code, operation_id, challenge_id,
         make_timestamp(1704067200000000 + (epoch_us(ts) - 1704067200000000) // 2000) AS ts FROM audit""")
define("late_line", "SELECT max(ts) AS top FROM fast")


def _fast(t: Tables) -> DataFrame:
    start = 1704067200000000
    squeezed = F.timestamp_micros(F.lit(start) + F.expr(f"(unix_micros(ts) - {start}L) div 2000"))
    return t.stored("fast", lambda: t.audit.withColumn("ts", squeezed).repartition(4))


def stream_of(t: Tables, stored: DataFrame, **options) -> DataFrame:
    """Stream over the files of a stored table."""
    t.spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    folder = stored.inputFiles()[0].rsplit("/", 1)[0]
    return t.spark.readStream.schema(stored.schema).options(**options).parquet(folder)


def settle(t: Tables, stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over all available files and read what it wrote."""
    out = scratch_path(t.spark, "stream")
    query_ = (
        stream.writeStream.format("parquet").outputMode(mode).option("path", out)
        .option("checkpointLocation", scratch_path(t.spark, "offsets")).trigger(availableNow=True).start()
    )
    query_.awaitTermination()
    return t.spark.read.schema(stream.schema).parquet(out)


@query("t1_stream_findings", f"SELECT {OUT} FROM ({R1})")
def t1(t: Tables):
    stored = t.files
    return settle(t, SE.stream_findings(stream_of(t, stored), ("agent", "docker"))).select(*FOUND)


@query("t2_stream_issue_rate", """
  SELECT epoch_us(start) AS window_start, count(*) AS issues FROM (
    SELECT ts, unnest(generate_series(time_bucket(INTERVAL 10 SECOND, ts) - INTERVAL 50 SECOND, time_bucket(INTERVAL 10 SECOND, ts), INTERVAL 10 SECOND)) AS start
    FROM fast WHERE event = 'challenge_issued') WHERE start + INTERVAL 60 SECOND <= (SELECT max(ts) FROM fast WHERE event = 'challenge_issued') - INTERVAL 30 SECOND
  GROUP BY start HAVING count(*) > 32""")
def t2(t: Tables):
    rates = settle(t, SE.stream_issue_rate(stream_of(t, _fast(t)), "30 seconds"))
    return rates.select(F.unix_micros("window_start").alias("window_start"), "issues")


_PAIRS = """SELECT i.event_id, i.challenge_id, i.ts AS issued_at, c.ts AS consumed_at FROM fast i JOIN fast c ON c.challenge_id = i.challenge_id AND c.event = 'challenge_consumed'
   AND c.ts >= i.ts AND c.ts < i.ts + INTERVAL 300 SECOND WHERE i.event = 'challenge_issued'"""


@query("t3_stream_confirmations", f"SELECT challenge_id, epoch_us(issued_at) AS issued_at, epoch_us(consumed_at) AS consumed_at FROM ({_PAIRS})")
def t3(t: Tables):
    pairs = settle(t, SE.stream_confirmations(stream_of(t, _fast(t)), "1 hour"))
    return pairs.select("challenge_id", F.unix_micros("issued_at").alias("issued_at"), F.unix_micros("consumed_at").alias("consumed_at"))


@query("t4_stream_expired", f"""
  SELECT challenge_id, epoch_us(ts) AS issued_at FROM fast WHERE event = 'challenge_issued' AND event_id NOT IN (SELECT event_id FROM ({_PAIRS}))
   AND ts + INTERVAL 300 SECOND < (SELECT least(max(ts) FILTER (event = 'challenge_issued'), max(ts) FILTER (event = 'challenge_consumed')) FROM fast) - INTERVAL 60 SECOND""")
def t4(t: Tables):
    expired = settle(t, SE.stream_expired(stream_of(t, _fast(t)), "60 seconds"))
    return expired.select("challenge_id", F.unix_micros("issued_at").alias("issued_at"))


@query("t5_stream_single_use", "SELECT DISTINCT challenge_id FROM fast WHERE event = 'challenge_consumed'")
def t5(t: Tables):
    return settle(t, SE.stream_single_use(stream_of(t, _fast(t)), "1 day")).select("challenge_id")


@query("t6_stream_event_counts", """
  SELECT epoch_us(date_trunc('hour', ts)) AS window_start, event, outcome, error_code, count(*) AS events FROM audit
  WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM audit) - INTERVAL 1 HOUR GROUP BY ALL""")
def t6(t: Tables):
    stored = t.stored("audit", lambda: t.audit.repartition(4))
    counts = settle(t, SE.stream_event_counts(stream_of(t, stored), "1 hour"))
    return counts.select(F.unix_micros("window_start").alias("window_start"), "event", "outcome", "error_code", "events")


define("sessions", """
  SELECT operation_id, sum(starts) OVER (PARTITION BY operation_id ORDER BY ts, event_id) AS session, ts FROM (
    SELECT operation_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY operation_id ORDER BY ts, event_id) <= INTERVAL 20 SECOND THEN 0 ELSE 1 END AS starts FROM fast)""")


@query("t7_stream_sessions", """
  SELECT operation_id, epoch_us(min(ts)) AS session_start, count(*) AS events FROM sessions GROUP BY operation_id, session
  HAVING max(ts) + INTERVAL 20 SECOND <= (SELECT max(ts) FROM fast) - INTERVAL 30 SECOND""")
def t7(t: Tables):
    sessions = settle(t, SE.stream_sessions(stream_of(t, _fast(t)), "30 seconds", gap_seconds=20))
    return sessions.select("operation_id", F.unix_micros("session_start").alias("session_start"), "events")


@query("t8_stream_state_machine")
def t8(t: Tables):
    """One ledger per ten users; every issue and consumption gets an outcome."""
    events = stream_of(t, _fast(t)).where("event IN ('challenge_issued', 'challenge_consumed')").select(
        F.concat(F.lit("m"), F.floor(F.col("user_id") / 10).cast("string")).alias("manager"), "event_id", "challenge_id",
        F.when(F.col("event") == "challenge_issued", "issue").otherwise("consume").alias("action"), "ts",
    )
    return settle(t, ST.stream_state_machine(events)).select("manager", "event_id", "outcome", "live")


_K = ", ".join(RESULT_KEY)


@query("t9_stream_live_results", f"""
  SELECT event_id, repo_id FROM (SELECT *, row_number() OVER (PARTITION BY {_K} ORDER BY created_at DESC) AS rn FROM results WHERE decision IN ('ALLOW', 'WARN'))
  WHERE rn = 1 AND created_at + INTERVAL 20 DAY > TIMESTAMP '2024-01-30 00:00:00'""")
def t9(t: Tables):
    from riskspark.sources.results import latest_result

    stored = t.stored("results", lambda: t.results.repartition(3))
    path = scratch_path(t.spark, "live")
    SE.stream_live_results(stream_of(t, stored, maxFilesPerTrigger=2), path, scratch_path(t.spark, "offsets")).start().awaitTermination()
    at = F.lit("2024-01-30 00:00:00").cast("timestamp")
    return latest_result(t.spark.read.parquet(path), at, ttl_seconds=20 * 86400).select("event_id", "repo_id")


@query("t10_stream_approvals")
def t10(t: Tables):
    """Events as approvals (views, sign-ups) and revocations (others) of a user's scope."""
    stored = t.stored("approval_events", lambda: t.audit.repartition(4))
    events = stream_of(t, stored).select(
        F.concat_ws("/", "operation_id", "outcome").alias("approval_key"), "event_id", "entry_id",
        F.when(F.col("event_id") % 3 == 0, "revoke").otherwise("approve").alias("action"), "ts",
        (F.col("ts") + F.expr("INTERVAL 5 DAYS")).alias("expires_at"), (F.col("event_id") % 2 + 1).alias("expected_version"),
    )
    return settle(t, ST.stream_approvals(events)).select("approval_key", "event_id", "outcome")


@query("t11_late_rows", """
  SELECT count(*) AS late FROM audit WHERE event = 'mutation_failed' AND date_trunc('hour', ts) + INTERVAL 1 HOUR <=
    (SELECT max(ts) FROM audit WHERE event <> 'mutation_failed') - INTERVAL 1 HOUR""")
def t11(t: Tables):
    """Failures arrive last, most of them later than the watermark. A batch drops rows by the watermark
    the batch before it ran with, so one more file of recent rows comes in between."""
    t.spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    folder = scratch_path(t.spark, "late")
    failed = F.col("event") == "mutation_failed"
    t.audit.where(~failed).coalesce(1).write.parquet(f"{folder}/part=1")
    t.audit.where(~failed & (F.col("ts") >= "2024-01-30")).coalesce(1).write.parquet(f"{folder}/part=2")
    t.audit.where(failed).coalesce(1).write.parquet(f"{folder}/part=3")
    stream = t.spark.readStream.schema(t.audit.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/part=*")
    counts = stream.withWatermark("ts", "1 hour").groupBy(F.window("ts", "1 hour"), "event_id").agg(F.count("*").alias("n"))
    run = (
        counts.writeStream.format("noop").outputMode("append").option("checkpointLocation", scratch_path(t.spark, "offsets"))
        .trigger(availableNow=True).start()
    )
    run.awaitTermination()
    return t.spark.range(1).select(F.lit(SE.late_rows(run)).cast("bigint").alias("late"))
