"""The whole analysis: files and commands in, findings, graph, verdicts and reports out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark.catalogue import policy as P
from riskspark.catalogue import files as FILES
from riskspark.operators import commands as C
from riskspark.operators import files as FS
from riskspark.operators import graph as G
from riskspark.operators import links as L
from riskspark.operators import policy as PO
from riskspark.operators import report as RP
from riskspark.operators import scan as S
from riskspark.session import broadcast_if_small, cut

SNAP = ["repo_id", "snapshot_id"]
FINDING = ["rule_id", "severity", "title", "file", "line", "evidence", "why_it_matters", "recommendation"]


@dataclass
class Assessment:
    plans: DataFrame  # distinct (snapshot, command) with scope
    repo_findings: DataFrame  # deduplicated findings of each snapshot
    plan_findings: DataFrame  # further findings of each plan
    contributions: DataFrame  # plan x rule
    verdicts: DataFrame  # one row per plan
    graph: G.Graph
    matrix: DataFrame

    def capped_findings(self) -> tuple[DataFrame, DataFrame]:
        """Report findings (with ``position``) and totals per plan.

        Only the worst of a snapshot's findings can be among the worst of a plan's, so snapshots
        are capped before they meet plans.
        """
        n = RP.LIMITS["findings"]
        top = RP.cap_findings(self.repo_findings, SNAP, n).drop("position", "total")
        shared = self.plans.select("plan_id", *SNAP).join(top, SNAP).drop(*SNAP)
        totals = (
            self.contributions.groupBy("plan_id").agg(F.sum("finding_count").cast("bigint").alias("total"))
        )
        # A place in the report depends on the true total, not on the total after the first cap.
        return RP.cap_findings(self.plan_findings.unionByName(shared), ["plan_id"], n, totals), totals

    def summary(self) -> DataFrame:
        """Severity counts per plan."""
        shared = self.plans.select("plan_id", *SNAP).join(
            PO.severity_summary(self.repo_findings, SNAP), SNAP
        ).drop(*SNAP)
        own = PO.severity_summary(self.plan_findings, ["plan_id"])
        names = ["critical", "high", "medium", "low", "info"]
        return own.unionByName(shared).groupBy("plan_id").agg(*[F.sum(n).alias(n) for n in names])

    def reports(self, verdicts: DataFrame | None = None) -> DataFrame:
        """A18. One document per plan."""
        verdicts = self.verdicts if verdicts is None else verdicts
        rules = PO.explain_rules(verdicts, self.contributions, "plan_id")
        capped, totals = self.capped_findings()
        described = verdicts.drop("scope").join(self.plans, "plan_id")
        return RP.assemble_report(described, capped, self.graph, rules, self.summary(), totals)

    def per_command(self, commands: DataFrame) -> DataFrame:
        """Verdicts for every planned command."""
        keyed = commands.withColumn("plan_id", C.plan_id())
        return keyed.join(self.verdicts, "plan_id").drop("plan_id")


def _with_text(files: DataFrame) -> DataFrame:
    return files if "text" in files.columns else FS.bounded_text(files)


def repository_findings(files: DataFrame, origins: DataFrame | None = None, marker: str = FILES.FIXTURE_MARKER) -> DataFrame:
    """Scan findings of critical files, first per rule and file, with their order.

    Markers are no critical files themselves, so directories are excluded by the full listing.
    """
    text = _with_text(files)
    listing = files.select(*SNAP, "path")
    critical = FS.exclude_marked_dirs(FS.exclude_skipped_dirs(FS.critical_files(text)), marker, listing)
    if origins is None:
        origins = text.sparkSession.createDataFrame([], "repo_id string, origin_slug string")
    found = S.scan(critical).unionByName(L.classify_links(L.extract_links(L.documents(critical)), origins))
    ordered = found.withColumns(
        {"phase": F.lit(1), "order_path": F.col("file"), "ord": F.array().cast("array<int>")}
    )
    return PO.dedupe_findings(ordered, SNAP)


def _selected_findings(plans: DataFrame, text: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Findings in files a command selects: all rules for files that are not critical, and the
    Java rules under the role the command gives a file."""
    targets = cut(C.command_targets(plans, text))
    keys = [*SNAP, "path"]
    outside = ~FS.is_critical(F.col("path")) | FS.in_skipped_dir(F.col("path"))
    extra = broadcast_if_small(targets.where(outside).select(*keys).distinct())
    chosen = text.join(extra, keys, "left_semi")
    general = targets.where(outside).select("plan_id", *keys).distinct().withColumnRenamed("path", "file").join(
        S.scan(chosen), [*SNAP, "file"]
    ).drop(*SNAP)
    roles = broadcast_if_small(targets.where("role <> 'argument'"))
    java = S.scan_command_aware(text.select(*SNAP, "path", "text").join(roles, keys))
    return general, java


def assess(
    files: DataFrame,
    commands: DataFrame,
    origins: DataFrame | None = None,
    matrix: DataFrame | None = None,
    marker: str = FILES.FIXTURE_MARKER,
    max_depth: int = FILES.MAX_CHAIN_DEPTH,
    max_nodes: int | None = FILES.MAX_NODES,
) -> Assessment:
    """Analyse every command against the snapshot it is planned in.

    ``max_depth`` and ``max_nodes`` bound how far a command is followed; what lies beyond is reported as a doubt. ``None`` lifts
    the bound on nodes.

    Texts are read by map-side projections; what is shuffled is findings, references and paths.
    Repository findings are never multiplied by commands: verdicts join profiles by rule.
    """
    text = _with_text(files)
    matrix = PO.default_matrix(text.sparkSession) if matrix is None else matrix
    repo_findings = cut(repository_findings(text, origins, marker))
    plans = cut(C.distinct_plans(commands))

    general, java = _selected_findings(plans, text)
    java = cut(java)
    facts = G.file_facts(text)
    graph = G.reach(plans, facts, repo_findings, java, max_depth, max_nodes)
    graph = G.Graph(*[cut(f) for f in (graph.nodes, graph.edges, graph.capabilities, graph.uncertainties)])

    command_rows = C.scan_commands(plans.select("plan_id", "command"))
    everything = PO.union_findings(
        command_rows.withColumn("order_path", F.lit("")),
        general.unionByName(java),
        G.graph_findings(graph.capabilities, graph.uncertainties),
    )
    columns = ["plan_id", *PO.ORDER, *FINDING]
    own = PO.dedupe_findings(everything.select(*columns), ["plan_id"])
    keyed = own.join(plans.select("plan_id", *SNAP), "plan_id")
    shared = repo_findings.select(*SNAP, "rule_id", "file")
    fresh = keyed.join(shared, [*SNAP, "rule_id", "file"], "left_anti")
    fresh = PO.drop_subsumed(fresh, SNAP, direct=repo_findings)
    plan_findings = cut(PO.drop_subsumed(fresh.drop(*SNAP).select(*columns), ["plan_id"]))

    by_repo = plans.select("plan_id", *SNAP).join(PO.profile(repo_findings, SNAP), SNAP).drop(*SNAP)
    profiles = (
        by_repo.unionByName(PO.profile(plan_findings, ["plan_id"]))
        .groupBy("plan_id", "rule_id")
        .agg(F.sum("finding_count").alias("finding_count"), F.sum("score").alias("score"))
    )
    contributed = cut(PO.contributions(profiles, plans, matrix, "plan_id"))
    verdicts = PO.evaluate_profile(plans, contributed, "plan_id")
    return Assessment(plans, repo_findings.select(*SNAP, *PO.ORDER, *FINDING), plan_findings, contributed, verdicts, graph, matrix)


def approve(result: Assessment, identities: DataFrame, approvals: DataFrame, now: Column) -> DataFrame:
    """Verdicts after approvals: ``identities`` gives commit and fingerprint per snapshot."""
    keyed = result.plans.join(identities, SNAP, "left").select(
        "plan_id", "repo_id", "head_commit", "critical_fingerprint", F.col("scope").alias("command_scope"),
        F.lit(P.POLICY_VERSION).alias("policy_version"), F.lit(P.RULESET_VERSION).alias("ruleset_version"),
    )
    return PO.trust_override(result.verdicts, PO.match_approval(keyed, approvals, now), "plan_id")
