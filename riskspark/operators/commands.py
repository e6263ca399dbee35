"""Rules about the command string itself (R17) and files it selects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark.catalogue import rules as R
from riskspark.catalogue.files import COMMAND_TARGET_TOOLS
from riskspark.functions.paths import collapse_dots
from riskspark.functions.regex import SEP, jre
from riskspark.functions.rows import exploded, numbered
from riskspark.functions.scope import build_tool_invocation, classify_scope
from riskspark.functions.words import joined_words, split_segments

PLAN = ["repo_id", "snapshot_id", "command"]


def plan_id() -> Column:
    """Same command in the same snapshot: the unit that is analysed once."""
    return F.md5(F.to_json(F.struct(*PLAN), {"ignoreNullFields": "false"}))


def distinct_plans(commands: DataFrame) -> DataFrame:
    """One row per (snapshot, command) with its scope; repeated commands are analysed once."""
    return (
        commands.select(*PLAN)
        .distinct()
        .withColumn("plan_id", plan_id())
        .withColumn("c", classify_scope(F.col("command")))
        .select("plan_id", *PLAN, F.col("c.scope").alias("scope"), F.col("c.reason").alias("scope_reason"))
    )


def _segment_rules(segment: Column) -> list[Column]:
    def has(pattern: str) -> Column:
        return segment.rlike(jre(pattern, "i"))

    docker_run = has(R.DOCKER_RUN)
    words = F.lower(F.translate(F.regexp_replace(segment, r"\\(.)", "$1"), "\"'", ""))
    broad = has(R.BROAD_ROOT_FLAG) & (
        (words.rlike(r"(?U)^\s*npx(?:\s|\z)") & F.contains(F.lower(segment), F.lit("mcp")))
        | words.rlike(r"(?U)^\s*(?:node|python|python3)\s+\S*server")
    )
    return [
        has(R.REMOTE_SHELL_PIPE),
        has(R.POWERSHELL) & has(R.POWERSHELL_ENCODED),
        has(R.POWERSHELL) & has(R.DOWNLOADER) & has(R.POWERSHELL_EXECUTOR),
        has(R.DOCKER_PRIVILEGED),
        docker_run & has(R.DOCKER_HOST_ROOT),
        docker_run & has(R.DOCKER_SOCKET),
        has(R.INLINE_INTERPRETER),
        broad,
    ]


def scan_commands(commands: DataFrame) -> DataFrame:
    """R17. Rules per segment, one finding per rule and command; ``commands`` keeps its keys."""
    keys = [c for c in commands.columns if c != "command"]
    segments = numbered(commands, split_segments(F.col("command")), "seg_no", "segment")
    matches = F.array(
        *[F.when(condition, F.lit(i)) for i, condition in enumerate(_segment_rules(F.col("segment")))]
    )
    hits = (
        exploded(segments, matches, "rule_ord")
        .groupBy(*keys, "command", "rule_ord")
        .agg(F.min("seg_no").alias("seg_no"))
    )
    dim = commands.sparkSession.createDataFrame(
        [(i, *rule) for i, rule in enumerate(R.COMMAND_RULES)],
        "rule_ord int, rule_id string, severity string, title string, why_it_matters string, recommendation string",
    )
    return hits.join(F.broadcast(dim), "rule_ord").select(
        *keys,
        F.col("rule_ord").cast("int").alias("rule_ord"),
        F.col("seg_no").cast("int").alias("match_ord"),
        "rule_id",
        "severity",
        "title",
        F.lit(R.COMMAND_FILE).alias("file"),
        F.lit(0).alias("line"),
        F.col("command").alias("evidence"),
        "why_it_matters",
        "recommendation",
    )


def selected_paths(plans: DataFrame) -> DataFrame:
    """Paths a command names for a tool to read: ``plan_id, snapshot, path, role``."""
    segments = exploded(plans, split_segments(F.col("command")), "segment").select(
        "plan_id", "repo_id", "snapshot_id", joined_words(F.col("segment")).alias("joined")
    )
    built = segments.withColumn("inv", build_tool_invocation(F.col("joined")))

    def items(values: Column, role: str) -> Column:
        return F.transform(values, lambda v: F.struct(v.alias("raw"), F.lit(role).alias("role")))

    tool = F.lower(F.regexp_extract("joined", rf"^([^{SEP}]*){SEP}", 1))
    argument = F.regexp_extract_all(F.col("joined"), F.lit(rf"^[^{SEP}]*{SEP}([^{SEP}]*){SEP}"), 1)
    named = F.when(
        F.col("inv.kind").isNotNull(),
        F.concat(
            items(F.col("inv.maven_files"), "maven"),
            items(F.col("inv.init_scripts"), "init"),
            items(F.col("inv.settings_files"), "settings"),
        ),
    ).when(tool.isin(*COMMAND_TARGET_TOOLS), items(argument, "argument"))
    raw = F.translate(F.col("t.raw"), "\\", "/")
    base = F.translate(F.coalesce(F.col("inv.project_dir"), F.lit("")), "\\", "/")
    return (
        exploded(built, named, "t")
        .where(~raw.startswith("/") & ~base.startswith("/"))
        .select(
            "plan_id", "repo_id", "snapshot_id", collapse_dots(F.concat_ws("/", base, raw)).alias("path"),
            F.col("t.role").alias("role"),
        )
        .where((F.col("path") != "") & ~F.col("path").rlike(r"^\.\.(?:/|\z)"))
        .distinct()
    )


def command_targets(plans: DataFrame, files: DataFrame) -> DataFrame:
    """J17. Existing files named by commands; they join the critical set whatever their name."""
    index = files.select("repo_id", "snapshot_id", "path").distinct()
    return selected_paths(plans).join(index, ["repo_id", "snapshot_id", "path"])
