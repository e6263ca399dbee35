"""Reports: caps, assembly and comparison."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskspark.catalogue import rules as R
from riskspark.functions.rows import exploded
from riskspark.operators.policy import ORDER, severity_rank

SCHEMA_VERSION = "1.0"
# Most items a report shows per collection.
LIMITS = {"findings": 100, "nodes": 100, "edges": 150, "capabilities": 100, "uncertainties": 100}


def _order(frame: DataFrame) -> Column:
    return F.struct(*[c for c in ORDER if c in frame.columns])


def cap_findings(
    findings: DataFrame, keys: list[str], n: int = LIMITS["findings"], totals: DataFrame | None = None
) -> DataFrame:
    """W2. Top ``n`` per key by severity, then order; original order when nothing is left out.

    The ranked limit runs before the shuffle and the total is a partial count, so a key with any
    number of findings sends at most ``n`` rows per task. ``position`` is the place in the report.
    ``totals`` (keys and ``total``) is needed where ``findings`` have been capped before.
    """
    ranked = findings.withColumn("_rank", severity_rank(F.col("severity"))).withColumn("_order", _order(findings))
    best = Window.partitionBy(*keys).orderBy("_rank", "_order")
    top = ranked.withColumn("_rn", F.row_number().over(best)).where(F.col("_rn") <= n)
    if totals is None:
        totals = findings.groupBy(*keys).agg(F.count("*").alias("total"))
    place = Window.partitionBy(*keys).orderBy(
        F.when(F.col("total") > n, F.col("_rank")).otherwise(F.lit(0)), "_order"
    )
    return (
        top.join(totals, keys)
        .withColumn("position", F.row_number().over(place))
        .drop("_rank", "_order", "_rn")
    )


def top_findings(findings: DataFrame, n: int = LIMITS["findings"]) -> DataFrame:
    """K4. The ``n`` worst findings overall; each task keeps ``n`` rows before they meet."""
    order = [c for c in findings.columns if c not in ("severity",)]
    return (
        findings.withColumn("severity_rank", severity_rank(F.col("severity")))
        .orderBy("severity_rank", *order)
        .limit(n)
        .drop("severity_rank")
    )


def omitted_counts(items: DataFrame, limits: dict[str, int], keys: list[str]) -> DataFrame:
    """A17. Per key and collection: maximum, included and omitted; ``items`` has ``collection``."""
    maximum = F.element_at(F.create_map(*[F.lit(v) for pair in limits.items() for v in pair]), F.col("collection"))
    return (
        items.groupBy(*keys, "collection")
        .agg(F.count("*").alias("n"))
        .select(
            *keys,
            "collection",
            maximum.alias("maximum"),
            F.least(F.col("n"), maximum.cast("bigint")).alias("included"),
            F.greatest(F.lit(0).cast("bigint"), F.col("n") - maximum).alias("omitted"),
        )
    )


def cap_graph(items: DataFrame, n: int, keys: list[str], order: list[str]) -> DataFrame:
    """W3. First ``n`` items per key with their place."""
    rank = Window.partitionBy(*keys).orderBy(*order)
    return items.withColumn("position", F.row_number().over(rank)).where(F.col("position") <= n)


def size_budget_rows(omitted: DataFrame, keys: list[str]) -> DataFrame:
    """W3. One doubt per report that left anything out, findings included."""
    rule = next(row for row in R.UNCERTAINTIES if row[0] == "REPORT_SIZE_BUDGET_EXCEEDED")
    return omitted.where("omitted > 0").select(*keys).distinct().select(
        *keys,
        F.lit(rule[0]).alias("rule_id"),
        F.lit(rule[1]).alias("severity"),
        F.lit(None).cast("string").alias("file"),
        F.lit(rule[2]).alias("reason"),
        F.lit(rule[3]).alias("recommendation"),
    )


def _gathered(frame: DataFrame, key: str, name: str, fields: list[Column]) -> DataFrame:
    """Capped rows of a report as one ordered array."""
    return frame.groupBy(key).agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("position", F.struct(*fields).alias("item")))),
            lambda x: x.getField("item"),
        ).alias(name)
    )


def _labels(rule: Column, file: Column, title: Column) -> list[Column]:
    source = (
        F.when(file == R.COMMAND_FILE, F.lit("command-string"))
        .when(rule.startswith("SECRET_"), F.lit("redacted-secret"))
        .when(rule.startswith("AGENT_"), F.lit("fixed-rule-phrase"))
        .when(title == R.UNCERTAINTY_TITLE, F.lit("tool-generated"))
        .otherwise(F.lit("repository-content"))
    )
    return [
        source.alias("evidenceSource"),
        F.lit("untrusted").alias("evidenceTrust"),
        F.lit("treat-as-data").alias("evidenceInstructionBoundary"),
    ]


def assemble_report(
    verdicts: DataFrame,
    findings: DataFrame,
    graph,
    rule_rows: DataFrame,
    summary: DataFrame,
    finding_totals: DataFrame,
    key: str = "plan_id",
) -> DataFrame:
    """A18. One nested document per key. ``findings`` are already capped (``position``).

    ``verdicts`` also carries the command and the repository columns. Every collection gathered
    here is capped first, so no row grows with its repository.
    """
    caps = {
        "nodes": cap_graph(graph.nodes, LIMITS["nodes"], [key], ["ord"]),
        "edges": cap_graph(graph.edges, LIMITS["edges"], [key], ["ord"]),
        "capabilities": cap_graph(
            graph.capabilities, LIMITS["capabilities"], [key], ["ord", "rule_ord", "rule_id", "file", "line"]
        ),
        "uncertainties": cap_graph(
            graph.uncertainties, LIMITS["uncertainties"], [key], ["ord", "rule_id", "file", "reason"]
        ),
    }
    sizes = reduce(
        DataFrame.unionByName,
        [
            frame.select(key, F.lit(name).alias("collection"))
            for name, frame in (
                ("nodes", graph.nodes), ("edges", graph.edges), ("capabilities", graph.capabilities),
                ("uncertainties", graph.uncertainties),
            )
        ],
    )
    omitted = omitted_counts(sizes, LIMITS, [key]).unionByName(
        finding_totals.select(
            key, F.lit("findings").alias("collection"), F.lit(LIMITS["findings"]).alias("maximum"),
            F.least(F.col("total"), F.lit(LIMITS["findings"]).cast("bigint")).alias("included"),
            F.greatest(F.lit(0).cast("bigint"), F.col("total") - LIMITS["findings"]).alias("omitted"),
        )
    )
    extra = size_budget_rows(omitted, [key]).withColumn("position", F.lit(LIMITS["uncertainties"] + 1))
    doubts = caps["uncertainties"].select(
        key, "position", "rule_id", "severity", "file", "reason", "recommendation"
    ).unionByName(extra)

    rule, file = F.col("rule_id"), F.col("file")
    finding_docs = _gathered(
        findings, key, "findings",
        [
            rule.alias("ruleId"), F.col("severity"), F.col("title"), file, F.col("line"), F.col("evidence"),
            F.col("why_it_matters").alias("whyItMatters"), F.col("recommendation"),
            *_labels(rule, file, F.col("title")),
        ],
    )
    node_docs = _gathered(
        caps["nodes"], key, "nodes",
        [F.col("node_id").alias("id"), F.col("type"), F.col("label"), file, F.lit(None).cast("int").alias("line"),
         F.col("command"), F.col("language")],
    )
    edge_docs = _gathered(
        caps["edges"], key, "edges", [F.col("from_id").alias("from"), F.col("to_id").alias("to"), F.col("reason")]
    )
    capability_docs = _gathered(
        caps["capabilities"], key, "capabilities",
        [rule.alias("ruleId"), F.col("severity"), file, F.col("line"), F.col("capability"), F.col("evidence"),
         F.col("recommendation"), *_labels(rule, file, F.lit(R.CAPABILITY_TITLE))],
    )
    doubt_docs = _gathered(
        doubts, key, "uncertainties",
        [rule.alias("ruleId"), F.col("severity"), file, F.col("reason"), F.col("recommendation"),
         *_labels(rule, F.coalesce(file, F.lit("")), F.lit(R.UNCERTAINTY_TITLE))],
    )
    rule_docs = rule_rows.groupBy(key).agg(
        F.sort_array(
            F.collect_list(
                F.struct(
                    rule.alias("ruleId"), F.col("finding_count").alias("findingCount"),
                    F.col("risk_score").alias("riskScore"), F.col("matrix_matched").alias("matrixMatched"),
                    F.col("minimum_decision").alias("minimumDecision"), F.col("hard_block").alias("hardBlock"),
                    F.col("rationale"), F.col("affected_final_gate").alias("affectedFinalGate"),
                    F.col("report_only").alias("reportOnly"),
                )
            )
        ).alias("ruleContributions")
    )
    limit_docs = omitted.groupBy(key).agg(
        F.map_from_entries(
            F.sort_array(F.collect_list(F.struct("collection", F.struct(F.col("maximum").alias("max"), "included", "omitted").alias("l"))))
        ).alias("limits")
    )
    joined = reduce(
        lambda a, b: a.join(b, key, "left"),
        [finding_docs, node_docs, edge_docs, capability_docs, doubt_docs, rule_docs, limit_docs, summary],
        verdicts,
    )

    def limit(name: str) -> Column:
        return F.coalesce(
            F.element_at("limits", name),
            F.struct(F.lit(LIMITS[name]).alias("max"), F.lit(0).cast("bigint").alias("included"), F.lit(0).cast("bigint").alias("omitted")),
        ).alias(name)

    def listed(name: str) -> Column:
        return F.coalesce(F.col(name), F.array().cast(joined.schema[name].dataType)).alias(name)

    def optional(name: str) -> Column:
        return (F.col(name) if name in verdicts.columns else F.lit(None)).cast("string")

    trusted = F.col("selector") == "trust_approval"
    return joined.select(
        key,
        F.struct(
            F.lit(SCHEMA_VERSION).alias("schemaVersion"),
            F.col("decision"),
            F.col("risk_score").cast("int").alias("riskScore"),
            F.col("command"),
            F.col("scope").alias("commandScope"),
            F.struct(
                F.col("repo_id").alias("path"),
                F.coalesce(optional("source_type"), F.lit("local")).alias("sourceType"),
                optional("clone_url").alias("cloneUrl"),
                optional("requested_ref").alias("requestedRef"),
                optional("resolved_commit").alias("resolvedCommit"),
                optional("remote_url").alias("remoteUrl"),
                optional("head_commit").alias("headCommit"),
                optional("critical_fingerprint").alias("criticalFingerprint"),
            ).alias("repo"),
            F.struct(
                *[F.coalesce(F.col(s), F.lit(0)).cast("int").alias(s) for s in ("critical", "high", "medium", "low", "info")]
            ).alias("summary"),
            F.col("reason"),
            F.col("agent_instruction").alias("agentInstruction"),
            F.struct(
                F.col("decision").alias("finalDecision"),
                F.col("scope").alias("commandScope"),
                F.struct(
                    F.col("selector").alias("type"), F.col("decision"), F.col("selected_rule").alias("ruleId")
                ).alias("selectedBy"),
                F.struct(
                    F.col("risk_score").cast("int").alias("riskScore"),
                    F.col("threshold_decision").alias("minimumDecision"),
                    F.col("selector").isin("command_scope", "risk_score", "scope_adjustment").alias("affectedFinalGate"),
                ).alias("commandContribution"),
                listed("ruleContributions"),
            ).alias("policyExplanation"),
            listed("findings"),
            F.struct(
                F.col("command").alias("entryCommand"), listed("nodes"), listed("edges"), listed("capabilities"),
                listed("uncertainties"),
            ).alias("executionGraph"),
            F.struct(
                limit("findings"),
                F.struct(limit("nodes"), limit("edges"), limit("capabilities"), limit("uncertainties")).alias("executionGraph"),
            ).alias("reportLimits"),
            F.struct(
                F.lit(False).alias("usedScanCache"),
                trusted.alias("usedTrustCache"),
                F.when(trusted, F.lit("matching scoped user approval")).alias("cacheReason"),
            ).alias("cache"),
        ).alias("report"),
    )


# ---- comparison -----------------------------------------------------------------------------


def diff_reports(baseline: DataFrame, candidate: DataFrame, identity: list[str]) -> DataFrame:
    """J5. Items added, removed, changed or unchanged, with both payloads.

    ``identity`` includes the key of the report pair; a repeated identity keeps its last item by
    ``pos``. Both sides meet in one partial aggregation instead of two and an outer join, so there
    is a single shuffle and a null in an identity is a value like any other.
    """
    payload = [c for c in baseline.columns if c not in (*identity, "pos")]

    def side(frame: DataFrame, number: int) -> DataFrame:
        place = F.col("pos") if "pos" in frame.columns else F.lit(0)
        return frame.select(*identity, F.lit(number).alias("side"), F.struct(*payload).alias("item"), place.alias("pos"))

    both = side(baseline, 0).unionByName(side(candidate, 1))
    met = both.groupBy(*identity).agg(
        *[F.max_by("item", F.when(F.col("side") == n, F.col("pos"))).alias(name) for n, name in ((0, "baseline"), (1, "candidate"))],
        *[F.bool_or(F.col("side") == n).alias(name) for n, name in ((0, "_b"), (1, "_c"))],
    )
    change = (
        F.when(~F.col("_b"), "added")
        .when(~F.col("_c"), "removed")
        .when(F.col("baseline").eqNullSafe(F.col("candidate")), "unchanged")
        .otherwise("changed")
    )
    return met.select(*identity, change.alias("change"), "baseline", "candidate")


def diff_scalars(baseline: DataFrame, candidate: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """J6. Chosen fields side by side; fields not chosen (cache, path) are ignored."""
    pairs = baseline.select(key, F.struct(*fields).alias("b")).join(
        candidate.select(key, F.struct(*fields).alias("c")), key
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(f).alias("field"),
                F.col(f"b.{f}").cast("string").alias("baseline"),
                F.col(f"c.{f}").cast("string").alias("candidate"),
                (~F.col(f"b.{f}").eqNullSafe(F.col(f"c.{f}"))).alias("changed"),
            )
            for f in fields
        ]
    )
    return exploded(pairs, rows, "r").select(key, "r.*")


def diff_changed(diffs: DataFrame, key: str) -> DataFrame:
    """A20. Did anything but unchanged items turn up; takes J5 rows or J6 rows."""
    moved = F.col("changed") if "changed" in diffs.columns else F.col("change") != "unchanged"
    return diffs.groupBy(key).agg(F.bool_or(moved).alias("changed"))


def added_keys(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """U3."""
    return candidate.distinct().subtract(baseline)


def removed_keys(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """U3."""
    return baseline.distinct().subtract(candidate)


def common_keys(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """U4."""
    return baseline.intersect(candidate)
