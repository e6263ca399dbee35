"""Stored report documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values.
MAX_REPORT_BYTES = 2 * 1024 * 1024
SUPPORTED_SCHEMA_VERSIONS = ("1.0",)
DECISIONS = ("ALLOW", "WARN", "ASK_USER", "BLOCK")
SELECTORS = (
    "trust_approval", "hard_block_rule", "command_scope", "scope_adjustment", "policy_matrix", "risk_score", "no_gate",
)
RULE_ID = r"^[A-Z][A-Z0-9_]*\z"


def _get(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "variant")


def _text(value: Column, path: str) -> Column:
    """Field as text, null unless it is a string."""
    return F.when(F.schema_of_variant(_get(value, path)) == "STRING", F.try_variant_get(value, path, "string"))


def _kind(value: Column, path: str) -> Column:
    return F.schema_of_variant(_get(value, path))


def _is_object(value: Column, path: str) -> Column:
    return F.coalesce(_kind(value, path).startswith("OBJECT"), F.lit(False))


def _is_integer(value: Column, path: str) -> Column:
    return F.coalesce(_kind(value, path) == "BIGINT", F.lit(False))


def _rule(value: Column) -> Column:
    return F.coalesce(_text(value, "$.ruleId").rlike(RULE_ID), F.lit(False))


def _list_ok(value: Column, path: str, required: bool, item_ok) -> Column:
    items = F.try_variant_get(value, path, "array<variant>")
    every = F.forall(items, lambda i: F.coalesce(F.schema_of_variant(i).startswith("OBJECT"), F.lit(False)) & item_ok(i))
    is_list = F.coalesce(_kind(value, path).startswith("ARRAY"), F.lit(False))
    absent = _get(value, path).isNull()
    return (F.lit(not required) & absent) | (is_list & F.coalesce(every, F.lit(False)))


def _finding_ok(item: Column) -> Column:
    return _rule(item) & _text(item, "$.file").isNotNull() & _is_integer(item, "$.line")


def _doubt_ok(item: Column) -> Column:
    kind = _kind(item, "$.file")
    return _rule(item) & F.coalesce(kind.isin("STRING", "VOID"), F.lit(False))


def check_report(text: Column, size: Column) -> Column:
    """Error code of a report document, null when it can be compared."""
    v = F.try_parse_json(text)
    selected, contribution = "$.policyExplanation.selectedBy", "$.policyExplanation.commandContribution"
    policy = _get(v, "$.policyExplanation")
    has_policy = policy.isNotNull() & (_kind(v, "$.policyExplanation") != "VOID")
    chosen_rule = _kind(v, f"{selected}.ruleId")
    selection_ok = _get(v, selected).isNull() | (
        _is_object(v, selected)
        & F.coalesce(_text(v, f"{selected}.type").isin(*SELECTORS), F.lit(False))
        & F.coalesce(_text(v, f"{selected}.decision").isin(*DECISIONS), F.lit(False))
        & (
            chosen_rule.isNull()
            | (chosen_rule == "VOID")
            | F.coalesce(_text(v, f"{selected}.ruleId").rlike(RULE_ID), F.lit(False))
        )
    )
    contribution_ok = _get(v, contribution).isNull() | (
        _is_object(v, contribution)
        & _is_integer(v, f"{contribution}.riskScore")
        & F.coalesce(F.try_variant_get(v, f"{contribution}.riskScore", "bigint") >= 0, F.lit(False))
        & F.coalesce(_text(v, f"{contribution}.minimumDecision").isin(*DECISIONS), F.lit(False))
        & F.coalesce(_kind(v, f"{contribution}.affectedFinalGate") == "BOOLEAN", F.lit(False))
    )
    policy_ok = ~has_policy | (
        _is_object(v, "$.policyExplanation")
        & _list_ok(v, "$.policyExplanation.ruleContributions", False, _rule)
        & selection_ok
        & contribution_ok
    )
    sound = (
        F.coalesce(_text(v, "$.decision").isin(*DECISIONS), F.lit(False))
        & _text(v, "$.commandScope").isNotNull()
        & _list_ok(v, "$.findings", True, _finding_ok)
        & _is_object(v, "$.executionGraph")
        & _list_ok(v, "$.executionGraph.capabilities", False, _finding_ok)
        & _list_ok(v, "$.executionGraph.uncertainties", False, _doubt_ok)
        & policy_ok
    )
    version = _text(v, "$.schemaVersion")
    return (
        F.when(size > MAX_REPORT_BYTES, F.lit("report_too_large"))
        .when(v.isNull(), F.lit("malformed_json"))
        .when(~_is_object(v, "$") | version.isNull(), F.lit("incompatible_report"))
        .when(~version.isin(*SUPPORTED_SCHEMA_VERSIONS), F.lit("unsupported_schema"))
        .when(~F.coalesce(sound, F.lit(False)), F.lit("incompatible_report"))
    )


_FINDING = "ruleId string, severity string, title string, file string, line bigint, evidence string"
REPORT = (
    "schemaVersion string, decision string, riskScore int, command string, commandScope string, "
    f"findings array<struct<{_FINDING.replace(' ', ':').replace(',:', ',')}>>, "
    "policyExplanation struct<selectedBy:struct<type:string,decision:string,ruleId:string>,"
    "commandContribution:struct<riskScore:int,minimumDecision:string,affectedFinalGate:boolean>,"
    "ruleContributions:array<struct<ruleId:string,findingCount:int,riskScore:int,affectedFinalGate:boolean>>>, "
    "executionGraph struct<capabilities:array<struct<ruleId:string,severity:string,file:string,line:bigint,capability:string>>,"
    "uncertainties:array<struct<ruleId:string,severity:string,file:string,reason:string>>>"
)


def parse_reports(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split ``path, size_bytes, text`` into parsed reports and rejected documents."""
    checked = documents.withColumn("error_code", check_report(F.col("text"), F.col("size_bytes")))
    good = checked.where("error_code IS NULL").select("path", F.from_json("text", REPORT).alias("r")).select("path", "r.*")
    return good, checked.where("error_code IS NOT NULL").select("path", "error_code")


def read_reports(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """S5. One document per file. Oversized files are rejected by size without being read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    small = files.where(F.col("length") <= MAX_REPORT_BYTES).select(
        "path", F.col("length").alias("size_bytes"), F.col("content").cast("string").alias("text")
    )
    large = files.where(F.col("length") > MAX_REPORT_BYTES).select("path", F.lit("report_too_large").alias("error_code"))
    good, bad = parse_reports(small)
    return good, bad.unionByName(large)
