"""Reports, comparison and corpora: J5-J8, A11, A12, A17, A18, A20, U3, U4, W2, W3, K4, K5, S3-S5, S9."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskspark.operators import corpus as CO
from riskspark.operators import report as RP
from riskspark.operators import scan as S
from riskspark.session import scratch_path
from riskspark.sources import reports as SR
from riskspark.sources import repo as RS
from workload.q_policy import FAMILIES, plans, repo_findings, verdicts
from workload.registry import Tables, define, query

# Two reports per user: what a user's events were in the first and in the second week.
WEEKS = ("2024-01-01 00:00:00", "2024-01-08 00:00:00", "2024-01-15 00:00:00")
for _name, _from, _to in (("before_items", *WEEKS[:2]), ("after_items", *WEEKS[1:])):
    define(_name, f"""
      SELECT user_id, event_type, floor(arg_max(value, ts) / 10) AS level FROM events
      WHERE ts >= TIMESTAMP '{_from}' AND ts < TIMESTAMP '{_to}' GROUP BY ALL""")
define("item_diff", """
  SELECT coalesce(b.user_id, a.user_id) AS user_id, coalesce(b.event_type, a.event_type) AS event_type,
         CASE WHEN b.user_id IS NULL THEN 'added' WHEN a.user_id IS NULL THEN 'removed' WHEN a.level = b.level THEN 'unchanged' ELSE 'changed' END AS change,
         CAST(b.level AS BIGINT) AS old_level, CAST(a.level AS BIGINT) AS new_level
  FROM before_items b FULL JOIN after_items a ON a.user_id = b.user_id AND a.event_type = b.event_type""")


def _items(t: Tables, after: bool):
    begin, end = (F.lit(day).cast("timestamp_ntz") for day in (WEEKS[1:] if after else WEEKS[:2]))
    return t.given("events").where((F.col("ts") >= begin) & (F.col("ts") < end)).select(
        "user_id", "event_type", F.col("ts").alias("pos"), F.floor(F.col("value") / 10).cast("bigint").alias("level")
    )


def _diff(t: Tables):
    return RP.diff_reports(_items(t, False), _items(t, True), ["user_id", "event_type"])


@query("j5_diff_reports", "SELECT * FROM item_diff")
def j5(t: Tables):
    return _diff(t).select(
        "user_id", "event_type", "change", F.col("baseline.level").alias("old_level"), F.col("candidate.level").alias("new_level")
    )


@query("a20_diff_changed", "SELECT user_id, bool_or(change <> 'unchanged') AS changed FROM item_diff GROUP BY user_id")
def a20(t: Tables):
    return RP.diff_changed(_diff(t), "user_id")


@query("u3_added_keys", "SELECT user_id, event_type FROM item_diff WHERE change = 'added'")
def u3(t: Tables):
    return RP.added_keys(*[_items(t, after).select("user_id", "event_type") for after in (False, True)])


@query("u3_removed_keys", "SELECT user_id, event_type FROM item_diff WHERE change = 'removed'")
def u3_removed(t: Tables):
    return RP.removed_keys(*[_items(t, after).select("user_id", "event_type") for after in (False, True)])


@query("u4_common_keys", "SELECT user_id, event_type FROM item_diff WHERE change IN ('changed', 'unchanged')")
def u4(t: Tables):
    return RP.common_keys(*[_items(t, after).select("user_id", "event_type") for after in (False, True)])


# Scalars of two orders tables side by side: status and priority of a customer's first and last order.
define("first_last", """
  SELECT o_custkey, arg_min(o_orderstatus, o_orderkey) AS s1, arg_max(o_orderstatus, o_orderkey) AS s2,
         arg_min(o_orderpriority, o_orderkey) AS p1, arg_max(o_orderpriority, o_orderkey) AS p2 FROM orders GROUP BY o_custkey""")


@query("j6_diff_scalars", """
  SELECT o_custkey, 'decision' AS field, s1 AS baseline, s2 AS candidate, s1 <> s2 AS changed FROM first_last
  UNION ALL SELECT o_custkey, 'scope', p1, p2, p1 <> p2 FROM first_last""")
def j6(t: Tables):
    def one(pick):
        return t.given("orders").groupBy("o_custkey").agg(
            pick("o_orderstatus", "o_orderkey").alias("decision"), pick("o_orderpriority", "o_orderkey").alias("scope")
        )

    return RP.diff_scalars(one(F.min_by), one(F.max_by), "o_custkey", ["decision", "scope"])


# A corpus: every labelled document expects a decision; its toxicity is the outcome.
_CASES = """SELECT CAST(l.doc_id AS STRING) AS id, d.source AS category, CASE WHEN l.quality = 1 THEN 'ALLOW' ELSE 'BLOCK' END AS expected_decision,
         CASE WHEN l.toxic = 0 THEN 'ALLOW' ELSE 'BLOCK' END AS actual_decision, l.quality AS quality, l.toxic AS toxic
         FROM labels l JOIN documents d ON d.doc_id = l.doc_id"""
define("scored", f"""
  SELECT id, category, expected_decision, CASE WHEN mod(CAST(id AS BIGINT), 11) = 0 THEN NULL ELSE actual_decision END AS actual_decision,
         quality = 1 AS negative_control,
         coalesce(CASE WHEN mod(CAST(id AS BIGINT), 11) = 0 THEN NULL ELSE actual_decision = expected_decision AND (quality = 1) = (toxic = 0) END, false) AS passed FROM ({_CASES})""")


def _scored(t: Tables):
    rows = t.sql(_CASES)
    none = F.array().cast("array<string>")
    cases = rows.select(
        "id", "category", "expected_decision", F.when(F.col("quality") == 1, none).otherwise(F.array(F.lit("R"))).alias("expected_rules")
    )
    results = rows.where("mod(CAST(id AS BIGINT), 11) <> 0").select(
        "id", "actual_decision", F.when(F.col("toxic") == 0, none).otherwise(F.array(F.lit("R"))).alias("actual_rules")
    )
    return CO.score_cases(cases, results)


@query("j7_score_cases", "SELECT id, category, expected_decision, actual_decision, negative_control, passed FROM scored")
def j7(t: Tables):
    return _scored(t).select("id", "category", "expected_decision", "actual_decision", "negative_control", "passed")


@query("a11_group_cases", """
  SELECT s.category, bool_and(s.passed) OVER c AS category_passed, count(*) FILTER (s.negative_control) OVER c AS negative_controls,
         count(*) OVER c AS case_count, s.id, s.passed FROM scored s WINDOW c AS (PARTITION BY s.category)""")
def a11(t: Tables):
    return CO.group_cases(_scored(t)).select("category", "category_passed", "negative_controls", "case_count", "id", "passed")


@query("a12_overall_passed", "SELECT coalesce(bool_and(passed), true) AS passed FROM scored")
def a12(t: Tables):
    return CO.overall_passed(_scored(t))


@query("k5_order_cases", "SELECT id, category FROM scored ORDER BY id")
def k5(t: Tables):
    return CO.order_cases(_scored(t)).select("id", "category")


_BATCH = """SELECT CAST(c_custkey AS STRING) AS name, CASE c_mktsegment WHEN 'BUILDING' THEN NULL WHEN 'MACHINERY' THEN 'WARN' ELSE 'ALLOW' END AS expected,
         CASE WHEN c_acctbal > 9000 THEN NULL WHEN c_acctbal < 0 THEN 'WARN' ELSE 'ALLOW' END AS decision FROM customer"""


@query("j8_score_batch", f"""
  SELECT name, expected, coalesce(decision, 'ERROR') AS decision, decision IS NOT NULL AND (expected IS NULL OR expected = decision) AS passed FROM ({_BATCH})""")
def j8(t: Tables):
    rows = t.sql(_BATCH)
    return CO.score_batch(rows.select("name", "expected"), rows.where("decision IS NOT NULL").select("name", "decision"))


# Findings of many: every line item is a finding of its supplier, its flag the severity.
define("item_findings", """
  SELECT l_suppkey, l_orderkey, l_linenumber, CASE l_returnflag WHEN 'R' THEN 'CRITICAL' WHEN 'A' THEN 'HIGH' ELSE 'LOW' END AS severity,
         CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 3 END AS rank, l_partkey FROM lineitem""")
define("capped", """
  SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY CASE WHEN total > 100 THEN rank ELSE 0 END, l_orderkey, l_linenumber, l_partkey) AS position
  FROM (SELECT *, count(*) OVER (PARTITION BY l_suppkey) AS total,
               row_number() OVER (PARTITION BY l_suppkey ORDER BY rank, l_orderkey, l_linenumber, l_partkey) AS rn FROM item_findings) WHERE rn <= 100""")


def _item_findings(t: Tables):
    flag = F.col("l_returnflag")
    return t.given("lineitem").select(
        "l_suppkey", F.when(flag == "R", "CRITICAL").when(flag == "A", "HIGH").otherwise("LOW").alias("severity"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("ord"),
    )


@query("w2_cap_findings", "SELECT l_suppkey, position, severity, l_orderkey, l_linenumber, total FROM capped")
def w2(t: Tables):
    return RP.cap_findings(_item_findings(t), ["l_suppkey"]).select(
        "l_suppkey", "position", "severity", "ord.l_orderkey", "ord.l_linenumber", "total"
    )


@query("k4_top_findings", "SELECT l_suppkey, severity FROM item_findings ORDER BY rank, l_suppkey, l_orderkey, l_linenumber, l_partkey LIMIT 100")
def k4(t: Tables):
    return RP.top_findings(_item_findings(t)).select("l_suppkey", "severity")


@query("a17_omitted_counts", """
  SELECT l_suppkey, 'findings' AS collection, 100 AS maximum, least(count(*), 100) AS included, greatest(count(*) - 100, 0) AS omitted FROM lineitem GROUP BY l_suppkey""")
def a17(t: Tables):
    return RP.omitted_counts(t.given("lineitem").withColumn("collection", F.lit("findings")), {"findings": 100}, ["l_suppkey"])


@query("w3_cap_graph", """
  SELECT l_suppkey, position, l_partkey, NULL AS rule_id FROM (
    SELECT l_suppkey, l_partkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS position FROM lineitem) WHERE position <= 150
  UNION ALL SELECT l_suppkey, NULL, NULL, 'REPORT_SIZE_BUDGET_EXCEEDED' FROM lineitem GROUP BY l_suppkey HAVING count(*) > 150""")
def w3(t: Tables):
    items = t.given("lineitem")
    kept = RP.cap_graph(items, 150, ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey"]).select(
        "l_suppkey", F.col("position").cast("bigint").alias("position"), "l_partkey", F.lit(None).cast("string").alias("rule_id")
    )
    left_out = RP.omitted_counts(items.withColumn("collection", F.lit("edges")), {"edges": 150}, ["l_suppkey"])
    rows = RP.size_budget_rows(left_out, ["l_suppkey"]).select(
        "l_suppkey", F.lit(None).cast("bigint").alias("position"), F.lit(None).cast("bigint").alias("l_partkey"), "rule_id"
    )
    return kept.unionByName(rows)


# ---- stored documents -----------------------------------------------------------------------


@query("s3_read_cases", "SELECT id, category, expected_decision, CASE WHEN negative_control THEN 0 ELSE 1 END AS rules FROM scored")
def s3(t: Tables):
    path = scratch_path(t.spark, "cases")
    _scored(t).select("id", "category", "expected_decision", "expected_rules").write.json(path)
    return RS.read_cases(t.spark, path).select(
        "id", "category", "expected_decision", F.size("expected_rules").alias("rules")
    )


@query("s4_read_batch", f"SELECT name, expected FROM ({_BATCH})")
def s4(t: Tables):
    """Files of 200 entries each: half hold an object with ``repos``, half a bare list."""
    path = scratch_path(t.spark, "batch")
    rows = t.sql(_BATCH).withColumn("part", F.floor(F.col("name").cast("bigint") / 200))
    entry = F.to_json(F.struct("name", "expected"))
    grouped = rows.groupBy("part").agg(F.concat(F.lit("["), F.array_join(F.collect_list(entry), ","), F.lit("]")).alias("list"))
    text = F.when(F.col("part") % 2 == 0, F.col("list")).otherwise(F.concat(F.lit('{"repos":'), "list", F.lit("}")))
    grouped.select(text.alias("value"), "part").write.partitionBy("part").text(path)
    return RS.read_batch(t.spark, path).select("name", "expected")


_DOCS = """SELECT o_orderkey, CASE mod(o_orderkey, 7) WHEN 0 THEN '{' WHEN 1 THEN '[1]' WHEN 2 THEN '{"schemaVersion": "9"}'
   WHEN 3 THEN '{"schemaVersion": "1.0", "decision": "MAYBE", "commandScope": "build", "findings": [], "executionGraph": {}}'
   WHEN 4 THEN '{"schemaVersion": "1.0", "decision": "WARN", "commandScope": "build", "findings": [{"ruleId": "bad id", "file": "a", "line": 1}], "executionGraph": {}}'
   ELSE concat('{"schemaVersion": "1.0", "decision": "WARN", "commandScope": "test", "riskScore": ', CAST(mod(o_custkey, 90) AS STRING),
        ', "findings": [{"ruleId": "RULE_A", "file": "f', CAST(o_custkey AS STRING), '", "line": 3}], "executionGraph": {"uncertainties": [{"ruleId": "R", "file": null}]}}') END AS text FROM orders"""


@query("s5_read_reports", """
  SELECT CAST(o_orderkey AS STRING) AS path, CASE mod(o_orderkey, 7) WHEN 0 THEN 'malformed_json' WHEN 1 THEN 'incompatible_report' WHEN 2 THEN 'unsupported_schema'
         WHEN 3 THEN 'incompatible_report' WHEN 4 THEN 'incompatible_report' END AS error_code,
         CASE WHEN mod(o_orderkey, 7) > 4 THEN CAST(mod(o_custkey, 90) AS INTEGER) END AS risk_score,
         CASE WHEN mod(o_orderkey, 7) > 4 THEN 'f' || o_custkey END AS first_file FROM orders""")
def s5(t: Tables):
    docs = t.sql(_DOCS).select(
        F.col("o_orderkey").cast("string").alias("path"), F.octet_length("text").cast("bigint").alias("size_bytes"), "text"
    )
    good, bad = SR.parse_reports(docs)
    none = F.lit(None)
    return good.select(
        "path", none.cast("string").alias("error_code"), F.col("riskScore").alias("risk_score"), F.col("findings")[0]["file"].alias("first_file")
    ).unionByName(bad.select("path", "error_code", none.cast("int").alias("risk_score"), none.cast("string").alias("first_file")))


@query("s9_write_reports", """
  SELECT DISTINCT c.repo_id, c.command, v.decision, CAST(v.risk_score AS INTEGER) AS risk_score FROM verdicts v JOIN commands c USING (command_id)""")
def s9(t: Tables):
    """Documents written, read back and taken apart again."""
    path = scratch_path(t.spark, "reports")
    rows = verdicts(t).drop("scope").join(plans(t), "plan_id").select(
        F.struct("repo_id", "command", "decision", F.col("risk_score").cast("int").alias("risk_score")).alias("report")
    )
    RS.write_reports(rows, path)
    schema = "repo_id string, command string, decision string, risk_score int"
    return t.spark.read.schema(schema).json(path)
