"""Incremental analysis: what stored results cover is looked up, the rest is scanned and stored.

A plan (a command in a snapshot) is identified by the digest of what it is judged on: the critical files of its snapshot,
the other files the command names, and the command. Contents are hashed in one map-side pass, and from then on only lines of
path and digest travel. Plans with a stored ``ALLOW`` or ``WARN`` of the same key are done; only snapshots that still have an
open plan are scanned.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark.catalogue import files as FILES
from riskspark.catalogue import policy as P
from riskspark.operators import commands as C
from riskspark.operators import files as FS
from riskspark.operators import policy as PO
from riskspark.plans.assess import assess
from riskspark.schemas import RESULT_KEY
from riskspark.session import broadcast_if_small, cut
from riskspark.sources import results as RE

SNAP = ["repo_id", "snapshot_id"]
VERDICT = ["decision", "risk_score", "reason", "agent_instruction", "selector", "selected_rule"]


@dataclass
class Incremental:
    plans: DataFrame  # distinct plans with their keys
    verdicts: DataFrame  # plan_id, VERDICT, used_scan_cache, used_trust_cache
    scanned: DataFrame  # plans that were scanned

    def per_command(self, commands: DataFrame) -> DataFrame:
        """Verdicts for every planned command."""
        return commands.withColumn("plan_id", C.plan_id()).join(self.verdicts, "plan_id").drop("plan_id")


def plan_fingerprints(files: DataFrame, plans: DataFrame, marker: str = FILES.FIXTURE_MARKER) -> DataFrame:
    """``plan_id, critical_fingerprint``: digest of the snapshot's critical files and of other files the command names.

    The lines of a snapshot are hashed once; a plan that names further files adds their lines to that digest, so no
    snapshot's lines are multiplied by its plans.
    """
    lines = cut(FS.digest_lines(files))
    listing = files.select(*SNAP, "path")
    critical = FS.exclude_marked_dirs(FS.exclude_skipped_dirs(FS.critical_files(lines)), marker, listing)
    snapshots = FS.fingerprint_of(critical)
    outside = ~FS.is_critical(F.col("path")) | FS.in_skipped_dir(F.col("path"))
    named = C.command_targets(plans, files).where(outside).select("plan_id", *SNAP, "path").distinct()
    # As many lines as a command has words at most.
    further = named.join(lines, [*SNAP, "path"]).groupBy("plan_id").agg(
        F.array_join(F.array_sort(F.collect_set("line")), "\n").alias("further")
    )
    base = F.coalesce("fingerprint", F.concat(F.lit("sha256:"), F.sha2(F.lit(""), 256)))
    whole = F.when(F.col("further").isNull(), base).otherwise(
        F.concat(F.lit("sha256:"), F.sha2(F.concat_ws("\n", base, "further"), 256))
    )
    joined = plans.select("plan_id", *SNAP).join(snapshots, SNAP, "left").join(further, "plan_id", "left")
    return joined.select("plan_id", whole.alias("critical_fingerprint"))


def result_keys(plans: DataFrame, fingerprints: DataFrame, identities: DataFrame, policy_version: str, ruleset_version: str) -> DataFrame:
    """Plans with the key their results are stored under, and the plain fingerprint approvals refer to.

    The command is part of the key's fingerprint: with the scope alone, an allowed command would vouch for every other
    command of its scope.
    """
    own = F.concat(F.lit("sha256:"), F.sha2(F.concat_ws("\n", "approved_fingerprint", "command"), 256))
    keyed = plans.join(identities.select(*SNAP, "head_commit"), SNAP, "left").join(
        fingerprints.withColumnRenamed("critical_fingerprint", "approved_fingerprint"), "plan_id"
    )
    return keyed.select(
        "plan_id", *SNAP, "command", "approved_fingerprint", "head_commit", own.alias("critical_fingerprint"),
        F.col("scope").alias("command_scope"), F.lit(policy_version).alias("policy_version"),
        F.lit(ruleset_version).alias("ruleset_version"), F.lit(P.REPORT_FORMAT_VERSION).alias("report_format_version"),
    )


def assess_incremental(
    files: DataFrame,
    commands: DataFrame,
    identities: DataFrame,
    store: str,
    created_at: Column,
    origins: DataFrame | None = None,
    matrix: DataFrame | None = None,
    approvals: DataFrame | None = None,
    marker: str = FILES.FIXTURE_MARKER,
    max_depth: int = FILES.MAX_CHAIN_DEPTH,
    max_nodes: int | None = FILES.MAX_NODES,
    policy_version: str = P.POLICY_VERSION,
    ruleset_version: str = P.RULESET_VERSION,
) -> Incremental:
    """Analyse commands, reusing and extending the results in the folder ``store``.

    ``identities`` gives ``head_commit`` per snapshot. Results are stored with ``created_at``, which also decides which
    approvals are alive. An approved plan is allowed whatever was found; its verdict is not stored. With another ``matrix``
    or other limits, pass another ``policy_version``: it is part of the key.
    """
    spark = files.sparkSession
    plans = cut(C.distinct_plans(commands))
    keyed = cut(result_keys(plans, plan_fingerprints(files, plans, marker), identities, policy_version, ruleset_version))
    stored = RE.read_scan_results(spark, store)
    if stored is None:
        hits, misses = keyed.limit(0).select("plan_id", *[F.lit(None).alias(c) for c in VERDICT]), keyed
    else:
        hits, misses = RE.lookup_scan_result(keyed, stored)
        # Written below into the same folder, so what was found is kept first.
        hits, misses = cut(hits.select("plan_id", *VERDICT)), cut(misses)
    flags = {"used_scan_cache": F.lit(True), "used_trust_cache": F.lit(False)}
    if misses.isEmpty():
        return Incremental(keyed, hits.withColumns(flags), misses)

    snapshots = broadcast_if_small(misses.select(*SNAP).distinct())
    found = assess(
        files.join(snapshots, SNAP, "left_semi"), misses.select(*SNAP, "command"), origins, matrix, marker, max_depth, max_nodes
    ).verdicts
    trusted = F.lit(False)
    if approvals is not None:
        asked = misses.drop("critical_fingerprint").withColumnRenamed("approved_fingerprint", "critical_fingerprint")
        found = PO.trust_override(found, PO.match_approval(asked, approvals, created_at), "plan_id")
        trusted = F.col("entry_id").isNotNull()
    fresh = cut(found.select("plan_id", *VERDICT, trusted.alias("used_trust_cache")))
    entries = misses.join(fresh.where("NOT used_trust_cache"), "plan_id").select(*RESULT_KEY, *VERDICT, created_at.alias("created_at"))
    RE.write_scan_results(entries, store)
    verdicts = fresh.withColumn("used_scan_cache", F.lit(False))
    if stored is not None:
        verdicts = verdicts.unionByName(hits.withColumns(flags))
    return Incremental(keyed, verdicts, misses)
