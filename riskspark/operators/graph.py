"""Reachability (G1, G2, G7-G10, J14): commands to scripts to files, level by level.

What a file refers to does not depend on the command that reached it, so references are extracted
and resolved once for all files; each level is then an equality join of the frontier with those
edges. Every level is stored, which keeps the plan of a level independent of its depth.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskspark.catalogue import rules as R
from riskspark.catalogue.files import COMPOSE_NAMES, MAX_CHAIN_DEPTH, MAX_NODES
from riskspark.functions.paths import basename, collapse_dots, dirname
from riskspark.functions.regex import SEP
from riskspark.functions.rows import exploded, numbered
from riskspark.functions.scope import build_tool_invocation
from riskspark.functions.targets import invocation_targets
from riskspark.functions.words import joined_words, split_segments
from riskspark.operators import reach as X
from riskspark.operators.files import in_skipped_dir, exclude_marked_dirs, language_of
from riskspark.session import BROADCAST_ROW_LIMIT, fits_broadcast, release
from riskspark.session import cut as cut_rows
from riskspark.session import cut_columns as cut

SNAP = ["repo_id", "snapshot_id"]
DOUBT_COLUMNS = ["plan_id", "ord", "rule_id", "file", "detail"]


@dataclass
class FileFacts:
    """Everything about files the graph needs, without their text."""

    index: DataFrame  # snapshot, path, is_link
    walk: DataFrame  # the part of the index outside skipped and marked directories
    edges: DataFrame  # resolved references between files
    scripts: DataFrame  # package.json scripts
    capabilities: DataFrame  # snapshot, file, capability rows
    dynamic: DataFrame  # files with dynamic module references
    unreadable: DataFrame  # files without text
    manifests: DataFrame  # every package.json that is walked, with its parse state


@dataclass
class Graph:
    nodes: DataFrame
    edges: DataFrame
    capabilities: DataFrame
    uncertainties: DataFrame


def file_facts(files: DataFrame) -> FileFacts:
    index = cut_rows(X.file_index(files))
    walk = exclude_marked_dirs(index.where(~in_skipped_dir(F.col("path"))))
    scripts = X.package_scripts(files)
    return FileFacts(
        index=index,
        walk=walk,
        edges=cut_rows(X.file_edges(files, index)),
        scripts=cut_rows(scripts.join(walk.select(*SNAP, "path"), [*SNAP, "path"], "left_semi")),
        capabilities=cut_rows(X.scan_capabilities(files.select(*SNAP, "path", "text"))),
        dynamic=X.dynamic_modules(files),
        unreadable=files.where(F.col("text").isNull()).select(*SNAP, "path"),
        manifests=cut_rows(X.manifest_states(files).join(walk.select(*SNAP, "path"), [*SNAP, "path"], "left_semi")),
    )


# ---- the level loop -------------------------------------------------------------------------


def node_budget(level: DataFrame, used: DataFrame, max_nodes: int | None) -> tuple[DataFrame, DataFrame | None]:
    """G8. Mark rows inside the node budget of their plan, and name the first row beyond it.

    ``used`` is the ledger: nodes each plan has been granted so far, its entry included. Seeds, the package scripts of each
    round and the files of each level are ranked and granted in turn from this one budget. Of the rows only those with
    status ``file`` take budget. Their first ``max_nodes`` per plan are found by a ranked limit that
    Spark applies before the shuffle, so a plan with any number of references does not gather.
    """
    if max_nodes is None:
        return level.withColumn("admitted", F.lit(True)), None
    order = Window.partitionBy("plan_id").orderBy("ord")
    ranked = (
        level.where("status = 'file'")
        .select("plan_id", "ord")
        .withColumn("rn", F.row_number().over(order))
        .where(F.col("rn") <= max_nodes)
    )
    room = F.lit(max_nodes) - F.coalesce("used", F.lit(1))
    full = used.where(F.col("used") >= max_nodes).select("plan_id", F.array().cast("array<int>").alias("last_ord"))
    reached = (
        ranked.join(used, "plan_id", "left")
        .where(F.col("rn") == room)
        .select("plan_id", F.col("ord").alias("last_ord"))
    )
    marked = level.join(reached.unionByName(full), "plan_id", "left").withColumn(
        "admitted", F.col("last_ord").isNull() | (F.col("ord") <= F.col("last_ord"))
    )
    over = (
        marked.where(~F.col("admitted"))
        .groupBy("plan_id")
        .agg(F.min_by(F.struct("ord", "parent_file", "target"), "ord").alias("o"))
        .select(
            "plan_id", F.col("o.ord").alias("ord"), F.lit("SCRIPT_NODE_BUDGET_EXCEEDED").alias("rule_id"),
            F.col("o.parent_file").alias("file"), F.col("o.target").alias("detail"),
        )
    )
    return marked.drop("last_ord"), over


def granted(used: DataFrame, rows: DataFrame) -> DataFrame:
    """The ledger after these rows have taken their budget."""
    taken = rows.groupBy("plan_id").agg(F.count("*").alias("used"))
    return cut_rows(used.unionByName(taken).groupBy("plan_id").agg(F.sum("used").alias("used")))


def depth_budget(level: DataFrame) -> tuple[DataFrame, DataFrame]:
    """G7. Beyond the last level nothing is followed; each such reference is a depth doubt.

    Missing module references were looked up before the depth check, so they stay missing.
    """
    followed = (F.col("kind") != "node") | F.col("status").isin("file", "link")
    too_deep = level.where(followed).select(
        "plan_id", "ord", F.lit("SCRIPT_CHAIN_DEPTH_EXCEEDED").alias("rule_id"),
        F.col("parent_file").alias("file"), F.lit("").alias("detail"),
    )
    return level.where(~followed), too_deep


def _status_doubts(level: DataFrame) -> DataFrame:
    rule = (
        F.when(F.col("status") == "missing", "SCRIPT_TARGET_MISSING")
        .when(F.col("status") == "outside", "SCRIPT_TARGET_OUTSIDE_REPO")
        .otherwise("SCRIPT_PARSE_UNCERTAIN")
    )
    detail = F.when(
        F.col("status") == "link",
        F.concat(F.lit("Reachable target is a symlink and was not read: "), F.col("target")),
    ).otherwise(F.col("target"))
    return level.where("status <> 'file'").select(
        "plan_id", "ord", rule.alias("rule_id"), F.col("parent_file").alias("file"), detail.alias("detail")
    )


@dataclass
class Levels:
    visits: DataFrame | None
    doubts: list[DataFrame]
    used: DataFrame


# Rows of a level that are shuffled at a time; more of them are joined in slices, each read anew.
SLICE_ROWS = 50_000_000


def _sliced(rows: int, *frames: DataFrame) -> list[list[DataFrame]]:
    """Frames with ``key`` cut into slices that only meet each other, so that disk holds the shuffle of one slice."""
    n = max(1, -(-rows // SLICE_ROWS))
    return [[f if n == 1 else f.where(F.pmod("key", F.lit(n)) == i) for f in frames] for i in range(n)]


def _stored(few: bool, *parts: DataFrame) -> DataFrame:
    """What a step of the level loop made; a wide step shuffled much, which goes before the next."""
    stored = cut(*parts)
    if not few:
        release(stored.sparkSession)
    return stored


def _leading(nodes: DataFrame, rows: int, sources: DataFrame) -> DataFrame:
    """Nodes of a wide level whose file refers to anything, by its hash. Most lead nowhere, and need no least path and no join.

    Where two hashes are equal by chance a node is kept that the join with the edges drops. Slices are twice as large as those of
    that join, as no edges are shuffled.
    """
    return _stored(False, *[part.hint("merge").join(leads, "key", "left_semi").drop("key") for part, leads in _sliced(rows // 2, nodes, sources)])


def _packed(edges: DataFrame) -> DataFrame:
    """Edges as they meet a level: a resolved name that equals the target, as most do, is not shuffled and stored twice."""
    same = F.col("resolved").eqNullSafe(F.col("target"))
    return edges.where("kind <> 'compose'").select(
        *SNAP, "path", "ref_ord", "kind", "target", "reason", F.when(~same, F.col("resolved")).alias("resolved"), same.alias("same"), "status"
    )


def _unpacked(level: DataFrame, columns: list[str]) -> DataFrame:
    """A stored level with what is told by its other columns."""
    return level.withColumns(
        {
            "parent_ord": F.slice("ord", 1, F.size("ord") - 1),
            "resolved": F.when(F.col("same"), F.col("target")).otherwise(F.col("resolved")),
        }
    ).select(*columns)


def expand_levels(
    level: DataFrame,
    edges: DataFrame,
    used: DataFrame,
    max_depth: int = MAX_CHAIN_DEPTH,
    max_nodes: int | None = MAX_NODES,
    visited: DataFrame | None = None,
) -> Levels:
    """G1. Follow references breadth first; a file is expanded once per plan.

    ``level`` has ``plan_id, snapshot, ord, parent_ord, parent_file, kind, target, reason, resolved,
    status``. ``ord`` is the path of reference positions from the command, so sorting by it gives
    the order a depth-first reader would meet the nodes.
    """
    columns, parts, few = level.columns, [level], True
    visits, doubts = [], []
    # Sorts start with a hash: names alike in their first letters are slow to compare.
    key, mark = F.xxhash64(*SNAP, "path"), F.xxhash64("plan_id", "path")
    edges, sources = _packed(edges).withColumn("key", key), None
    for depth in range(max_depth + 1):
        level = _stored(few, *parts)
        if depth:
            level = _unpacked(level, columns)
        if level.isEmpty():
            break
        if depth == max_depth:
            level, too_deep = depth_budget(level)
            doubts += [too_deep, _status_doubts(level)]
            break
        marked, over = node_budget(level, used, max_nodes)
        kept = level if over is None else cut(marked.where("admitted").drop("admitted"))
        doubts.append(_status_doubts(kept))
        if over is not None:
            doubts.append(over)
        nodes = kept.where("status = 'file'")
        visits.append(nodes.withColumn("depth", F.lit(depth + 1)))
        used = granted(used, nodes)
        first = nodes.select("plan_id", *SNAP, F.col("resolved").alias("path"), "ord").withColumn("key", key)
        # Rows are counted before bytes are measured: the latter gathers as many rows as may be broadcast from each task.
        few = (rows := first.count()) <= BROADCAST_ROW_LIMIT and fits_broadcast(first)
        if not few:
            sources = _stored(False, edges.select("key").distinct()) if sources is None else sources
            first = _leading(first, rows, sources).withColumn("key", key)
        first = first.groupBy("key", "plan_id", *SNAP, "path").agg(F.min("ord").alias("ord")).drop("key")
        if visited is not None:
            first = first.withColumn("mark", mark).join(visited.withColumn("mark", mark), ["mark", "plan_id", "path"], "left_anti").drop("mark")
        first = _stored(few, first)
        if not few and first.isEmpty():
            break
        visited = first.select("plan_id", "path") if visited is None else visited.unionByName(
            first.select("plan_id", "path")
        )
        # A few files meet the edges where these are read; otherwise both sides are shuffled.
        first = first.withColumn("key", key)
        meeting = [[F.broadcast(first), edges]] if few else _sliced(first.count(), first.hint("merge"), edges)
        parts = [
            found.join(followed, ["key", *SNAP, "path"]).select(
                "plan_id",
                *SNAP,
                F.concat("ord", F.array(F.col("ref_ord"))).alias("ord"),
                F.col("path").alias("parent_file"),
                "kind",
                "target",
                "reason",
                "resolved",
                "same",
                "status",
            )
            for found, followed in meeting
        ]
    return Levels(reduce(DataFrame.unionByName, visits) if visits else None, doubts, used)


# ---- seeds ----------------------------------------------------------------------------------


def _seed_classes(path: Column) -> Column:
    """Groups of project files a build tool reads."""
    name = basename(path)
    bundle = name.isin("Gemfile", "Gemfile.lock", "gems.locked") | path.endswith(".gemspec")
    groups = [
        ("docker_build", name == "Dockerfile"),
        ("docker", (name == "Dockerfile") | name.isin(*COMPOSE_NAMES)),
        ("make", name == "Makefile"),
        ("cargo", name.isin("Cargo.toml", "Cargo.lock", "build.rs") | (path == ".cargo/config.toml")),
        ("go", name.isin("go.mod", "go.sum") | path.endswith(".go")),
        ("pom", name == "pom.xml"),
        ("gradle", name.isin(*R.GRADLE_FILES)),
        ("rake", name == "Rakefile"),
        ("bundle_rake", bundle | (name == "Rakefile")),
        ("bundle_ext", bundle | (name == "extconf.rb")),
    ]
    return F.array_compact(F.array(*[F.when(condition, F.lit(group)) for group, condition in groups]))


# Reason of the edge to a seed file, and the seed's language.
_SEED_TEXT = {
    "docker_build": ("docker command reads configuration", "docker"),
    "docker": ("docker command reads configuration", "docker"),
    "make": ("make command reads Makefile", "make"),
    "cargo": ("cargo command reads Rust project metadata", "rust"),
    "go": ("go command reads Go project metadata and source", "go"),
    "pom": ("Maven command reads project and plugin metadata", "java-kotlin"),
    "gradle": ("Gradle command reads build or settings metadata", "java-kotlin"),
    "settings": ("Gradle -c/--settings-file loads selected settings metadata", "java-kotlin"),
    "init": ("Gradle -I/--init-script loads an initialization script", "java-kotlin"),
    "wrapper": ("Gradle wrapper command reads wrapper metadata", "java-kotlin"),
    "rake": ("Ruby command reads Bundler or Rake project metadata", "ruby"),
    "bundle_rake": ("Ruby command reads Bundler or Rake project metadata", "ruby"),
    "bundle_ext": ("Ruby command reads Bundler or Rake project metadata", "ruby"),
}


def _text_of(group: Column, which: int) -> Column:
    return F.element_at(
        F.create_map(*[F.lit(v) for name, text in _SEED_TEXT.items() for v in (name, text[which])]), group
    )


def _first_per(frame: DataFrame, keys: list[str], order: list[str], limit: int | None) -> DataFrame:
    """First ``limit`` rows per key with their rank, pruned before the shuffle; without a limit all of them."""
    ranked = frame.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked if limit is None else ranked.where(F.col("rank") <= limit)


def _segments(plans: DataFrame) -> DataFrame:
    return (
        numbered(plans, split_segments(F.col("command")), "seg", "segment")
        .select("plan_id", *SNAP, "scope", "command", "seg", "segment")
        .withColumn("joined", joined_words(F.col("segment")))
        .withColumn("words", F.lower("joined"))
    )


def _build_requests(segments: DataFrame) -> DataFrame:
    """What each segment of a build or test command asks for: a script name or a file group."""
    words = F.col("words")
    inv = build_tool_invocation(F.col("joined"))
    run = rf"^(?:npm|pnpm|yarn){SEP}run{SEP}[^{SEP}]*{SEP}"
    short = rf"^(?:npm|pnpm|yarn){SEP}(?:test|start|build){SEP}"
    third = F.regexp_extract("joined", rf"^[^{SEP}]*{SEP}[^{SEP}]*{SEP}([^{SEP}]*){SEP}", 1)
    second = F.regexp_extract("joined", rf"^[^{SEP}]*{SEP}([^{SEP}]*){SEP}", 1)
    group = (
        F.when(words.rlike(rf"^rake{SEP}"), "rake")
        .when(words.rlike(rf"^(?:bundle|bundler){SEP}exec{SEP}rake{SEP}"), "bundle_rake")
        .when(words.rlike(f"{run}|{short}"), F.lit("script"))
        .when(words.rlike(rf"^make{SEP}"), "make")
        .when(words.rlike(rf"^cargo{SEP}"), "cargo")
        .when(words.rlike(rf"^go{SEP}"), "go")
        .when(F.col("inv.kind") == "maven", "pom")
        .when(F.col("inv.kind") == "gradle", "gradle")
    )
    return (
        segments.where(F.col("scope").isin("build", "test"))
        .withColumn("inv", inv)
        .withColumn("group", group)
        .withColumn("script", F.when(words.rlike(run), third).when(words.rlike(short), second))
        .where("group IS NOT NULL")
    )


def _group_seeds(requests: DataFrame, walk: DataFrame, max_nodes: int | None) -> DataFrame:
    """Files of a group for each request. Only as many as a plan has nodes can matter."""
    grouped = exploded(walk.select(*SNAP, "path"), _seed_classes(F.col("path")), "group")
    grouped = _first_per(grouped, [*SNAP, "group"], ["path"], max_nodes)
    return requests.join(grouped, [*SNAP, "group"]).select(
        "plan_id", *SNAP, "group", "path", F.array("seg", F.lit(0), F.col("rank")).alias("ord")
    )


def _exact_seeds(requests: DataFrame, index: DataFrame) -> DataFrame:
    """Files named outright; ``requests`` has ``paths`` as array of (order, group, path)."""
    spread = exploded(requests.select("plan_id", *SNAP, "seg", "paths"), F.col("paths"), "p")
    return (
        spread.select("plan_id", *SNAP, "seg", "p.*")
        .join(index.select(*SNAP, "path"), [*SNAP, "path"])
        .withColumn(
            "rank", F.row_number().over(Window.partitionBy("plan_id", "seg", "order").orderBy("path"))
        )
        .select("plan_id", *SNAP, "group", "path", F.array("seg", "order", "rank").alias("ord"))
    )


def _java_requests(requests: DataFrame) -> DataFrame:
    """Paths a Maven or Gradle command names, in the order they are read."""
    inv = F.col("inv")
    base = F.translate(F.coalesce(inv.getField("project_dir"), F.lit("")), "\\", "/")

    def paths(values: Column, order: int, group: str, folder: Column | None = None) -> Column:
        return F.transform(
            values,
            lambda v: F.struct(
                F.lit(order).alias("order"),
                F.lit(group).alias("group"),
                collapse_dots(
                    F.translate(v, "\\", "/") if folder is None else F.concat_ws("/", folder, F.translate(v, "\\", "/"))
                ).alias("path"),
            ),
        )

    settings = inv.getField("settings_files")
    has_base, has_settings = inv.getField("project_dir").isNotNull(), F.size(settings) > 0
    build_base = F.when(has_base, base).when(
        has_settings, dirname(collapse_dots(F.concat_ws("/", base, F.translate(F.element_at(settings, -1), "\\", "/"))))
    )
    none = F.slice(settings, 1, 0)
    scoped = F.when(
        has_base | has_settings,
        F.concat(
            F.array(F.lit("build.gradle"), F.lit("build.gradle.kts")),
            F.when(has_settings, none).otherwise(F.array(F.lit("settings.gradle"), F.lit("settings.gradle.kts"))),
        ),
    ).otherwise(none)
    executable = F.translate(inv.getField("executable"), "\\", "/")
    wrapper = F.when(
        inv.getField("uses_wrapper"),
        F.array(
            executable,
            F.concat_ws(
                "/", F.when(dirname(executable) != "", dirname(executable)),
                F.lit("gradle/wrapper/gradle-wrapper.properties"),
            ),
        ),
    ).otherwise(none)
    every = F.concat(
        paths(inv.getField("maven_files"), 0, "pom"),
        paths(scoped, 0, "gradle", build_base),
        paths(settings, 1, "settings", base),
        paths(inv.getField("init_scripts"), 2, "init", base),
        paths(wrapper, 3, "wrapper"),
    )
    return requests.where(F.col("group").isin("pom", "gradle")).withColumn("paths", every).withColumn(
        "build_base", F.coalesce(build_base, F.lit(""))
    ).withColumn("scoped", has_base | has_settings)


def _build_src_seeds(requests: DataFrame, walk: DataFrame, max_nodes: int | None) -> DataFrame:
    """Build files below ``buildSrc`` of the project directory a Gradle command selects."""
    parts = F.split("path", "/")
    bases = F.transform(
        F.filter(F.sequence(F.lit(1), F.size(parts)), lambda n: F.element_at(parts, n) == "buildSrc"),
        lambda n: F.array_join(F.slice(parts, F.lit(1), n - 1), "/"),
    )
    builds = walk.where(basename(F.col("path")).isin("build.gradle", "build.gradle.kts"))
    found = exploded(builds.select(*SNAP, "path"), bases, "build_base")
    found = _first_per(found, [*SNAP, "build_base"], ["path"], max_nodes)
    return requests.where("scoped").join(found, [*SNAP, "build_base"]).select(
        "plan_id", *SNAP, F.lit("gradle").alias("group"), "path",
        F.array(F.col("seg"), F.lit(0), F.col("rank") + 10).alias("ord"),
    )


def seed_frontier(
    plans: DataFrame, facts: FileFacts, max_nodes: int | None = MAX_NODES
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """G2. Where analysis of a command starts: ``(script seeds, file seeds, command seeds)``."""
    segments = cut_rows(_segments(plans))
    requests = _build_requests(segments)

    # Package scripts: lifecycle scripts on installs, named scripts on builds.
    lifecycle = facts.scripts.where(F.col("name").isin(*R.LIFECYCLE_SCRIPTS))
    lifecycle = _first_per(lifecycle, SNAP, ["path", "script_ord"], max_nodes)
    installs = plans.where("scope = 'dependency_install'").select("plan_id", *SNAP).join(lifecycle, SNAP).select(
        "plan_id", *SNAP, "path", "name", "command", "indirect", F.array(F.lit(0), F.col("rank")).alias("ord"),
        F.lit("dependency install lifecycle").alias("reason"),
        F.lit("lifecycle script invokes local script").alias("next_reason"),
        F.lit(True).alias("lifecycle"),
    )
    by_name = _first_per(facts.scripts, [*SNAP, "name"], ["path", "script_ord"], max_nodes)
    named = requests.where("group = 'script'").select("plan_id", *SNAP, "seg", F.col("script").alias("name")).join(
        by_name, [*SNAP, "name"]
    ).select(
        "plan_id", *SNAP, "path", "name", "command", "indirect",
        F.array("seg", "rank").alias("ord"),
        F.lit("package run script").alias("reason"),
        F.lit("package script invokes local script").alias("next_reason"),
        F.lit(False).alias("lifecycle"),
    )
    script_seeds = installs.unionByName(named)

    # Project files a tool reads.
    is_build = F.contains(F.lower("command"), F.lit("build"))
    docker = plans.where("scope = 'docker'").select(
        "plan_id", *SNAP, F.lit(0).alias("seg"),
        F.when(is_build, "docker_build").otherwise("docker").alias("group"),
    )
    bundle = (
        segments.where("scope = 'dependency_install'")
        .where(F.col("words").rlike(rf"^(?:bundle|bundler){SEP}install{SEP}"))
        .groupBy("plan_id", *SNAP)
        .agg(F.lit(1 << 20).alias("seg"))
        .withColumn("group", F.lit("bundle_ext"))
    )
    java = _java_requests(requests)
    whole = requests.where(~F.col("group").isin("script", "pom", "gradle")).select("plan_id", *SNAP, "seg", "group")
    whole_java = java.where(
        F.when(F.col("group") == "pom", F.size("inv.maven_files") == 0).otherwise(~F.col("scoped"))
    ).select("plan_id", *SNAP, "seg", "group")
    file_seeds = reduce(
        DataFrame.unionByName,
        [
            _group_seeds(
                reduce(DataFrame.unionByName, [docker, bundle.select(docker.columns), whole, whole_java]),
                facts.walk, max_nodes,
            ),
            _exact_seeds(java, facts.index),
            _build_src_seeds(java, facts.walk, max_nodes),
        ],
    )

    command_seeds = segments.where(F.col("scope").isin("script_execution", "unknown_shell", "mcp_server_start")).select(
        "plan_id", *SNAP, F.array("seg").alias("ord"), F.array().cast("array<int>").alias("parent_ord"),
        F.lit(None).cast("string").alias("parent_file"), F.lit("").alias("base_dir"),
        F.col("segment").alias("command"), F.lit("command target").alias("reason"),
        F.array().cast("array<string>").alias("trail"),
    )
    return script_seeds, file_seeds, command_seeds


# Doubts about files that could not be read or parsed.
_MANIFEST_DOUBT = {"unreadable": "Could not read package.json.", "broken": "Could not parse package.json."}
_ECOSYSTEM_DOUBT = "Could not read ecosystem file."


def manifest_doubts(readers: DataFrame, manifests: DataFrame) -> DataFrame:
    """Doubts of commands that read every package.json of their snapshot (``plan_id``, snapshot, ``ord``), one for each that
    could not be read or parsed: what it starts is unknown.

    Only files that are not sound are joined, so sound snapshots multiply nothing.
    """
    detail = F.create_map(*[F.lit(x) for pair in _MANIFEST_DOUBT.items() for x in pair])
    bad = manifests.where("state <> 'validated'").select(*SNAP, F.col("path").alias("file"), detail[F.col("state")].alias("detail"))
    return readers.select("plan_id", *SNAP, "ord").join(bad, SNAP).select(
        "plan_id", "ord", F.lit("SCRIPT_PARSE_UNCERTAIN").alias("rule_id"), "file", "detail"
    )


def manifest_readers(plans: DataFrame) -> DataFrame:
    """Commands that look for scripts in every package.json: installs, and builds or tests that name a script."""
    installs = plans.where("scope = 'dependency_install'").select("plan_id", *SNAP, F.array(F.lit(0)).alias("ord"))
    requests = _build_requests(_segments(plans)).where("group = 'script'")
    return installs.unionByName(requests.select("plan_id", *SNAP, F.array("seg").alias("ord")))


def expand_commands(
    rows: DataFrame, facts: FileFacts, used: DataFrame, max_nodes: int | None = MAX_NODES
) -> tuple[DataFrame | None, DataFrame | None, list[DataFrame], DataFrame]:
    """Unwrap nested commands and package scripts until only file targets are left.

    Rounds follow how deep commands are wrapped, normally one or two. They end: unwrapping shortens a command, and a script
    takes node budget and is followed once in a trail; one that calls itself would only stop at the node budget, so it is
    reported as exactly that. Returns ``(targets, script nodes, doubts, ledger)``.
    """
    by_name = _first_per(facts.scripts, [*SNAP, "name"], ["path", "script_ord"], max_nodes)
    targets, nodes, doubts = [], [], []
    while True:
        rows = cut_rows(rows)
        if rows.isEmpty():
            break
        parsed = numbered(rows, invocation_targets(F.col("command")), "i", "t").select(
            "plan_id", *SNAP, F.concat("ord", F.array("i")).alias("ord"), "parent_ord", "parent_file", "base_dir",
            "reason", "trail", "t.kind", "t.target", F.col("t.reason").alias("own_reason"),
        )
        parsed = cut_rows(parsed)
        doubts.append(
            parsed.where("kind = 'doubt'").select(
                "plan_id", "ord", F.col("own_reason").alias("rule_id"), F.col("parent_file").alias("file"),
                F.col("target").alias("detail"),
            )
        )
        targets.append(
            parsed.where(F.col("kind").isin("path", "module")).select(
                "plan_id", *SNAP, "ord", "parent_ord", "parent_file", "kind", "target",
                F.when(F.col("reason") != "", F.col("reason")).otherwise(F.col("own_reason")).alias("reason"),
                "base_dir", F.lit(None).cast("string").alias("fallback_dir"),
            )
        )
        nested = numbered(
            parsed.where("kind = 'nested'"), split_segments(F.col("target")), "j", "segment"
        ).select(
            "plan_id", *SNAP, F.concat("ord", F.array("j")).alias("ord"), "parent_ord", "parent_file", "base_dir",
            F.col("segment").alias("command"), "reason", "trail",
        )
        calls = parsed.where("kind = 'script'")
        doubts.append(manifest_doubts(calls, facts.manifests))
        called = (
            calls.withColumnRenamed("target", "name")
            .join(by_name, [*SNAP, "name"])
            .withColumn("label", F.concat(F.col("path"), F.lit(" scripts."), F.col("name")))
            .withColumn("near", dirname(F.col("path")) == F.col("base_dir"))
            .withColumn("next_ord", F.concat("ord", F.array(F.when(F.col("near"), F.lit(0)).otherwise(F.col("rank")))))
        )
        looped = F.array_contains("trail", F.col("label"))
        doubts.append(
            called.where(looped).select(
                "plan_id", F.col("next_ord").alias("ord"), F.lit("SCRIPT_NODE_BUDGET_EXCEEDED").alias("rule_id"),
                F.col("path").alias("file"), F.col("label").alias("detail"),
            )
        )
        asked = called.where(~looped).select(
            "plan_id", *SNAP, F.col("next_ord").alias("ord"), "parent_ord", F.col("parent_file").alias("caller"),
            F.col("path").alias("parent_file"), F.col("label").alias("target"), F.lit("file").alias("status"), "command", "reason", "trail",
        )
        marked, over = node_budget(cut_rows(asked), used, max_nodes)
        if over is not None:
            doubts.append(over)
        fresh = cut_rows(marked.where("admitted"))
        used = granted(used, fresh)
        nodes.append(
            fresh.select(
                "plan_id", *SNAP, "ord", "parent_ord", F.col("caller").alias("parent_file"), F.col("parent_file").alias("file"),
                F.col("target").alias("label"), "command", "reason",
            )
        )
        rows = nested.unionByName(
            fresh.select(
                "plan_id", *SNAP, "ord", F.col("ord").alias("parent_ord"), "parent_file",
                dirname(F.col("parent_file")).alias("base_dir"), "command",
                F.lit("package script invokes local script").alias("reason"),
                F.concat("trail", F.array("target")).alias("trail"),
            )
        )
    if not targets:
        return None, None, doubts, used
    return reduce(DataFrame.unionByName, targets), reduce(DataFrame.unionByName, nodes), doubts, used


def _node_id(ord_column: Column) -> Column:
    return F.concat(F.lit("n"), F.when(F.size(ord_column) > 0, F.concat(F.lit("."), F.array_join(ord_column.cast("array<string>"), "."))).otherwise(F.lit("")))


# Seed groups whose files are judged by the scan rules with these prefixes.
_ECOSYSTEM = (
    ("^(?:RUST|GO)_", ("cargo", "go")),
    ("^RUBY_", ("rake", "bundle_rake", "bundle_ext")),
    ("^JAVA_", ("pom", "gradle", "settings", "init", "wrapper")),
)


def _ecosystem_capabilities(seeds: DataFrame, scan_findings: DataFrame, selected: DataFrame | None) -> DataFrame:
    """Findings in project files a build tool reads are things the command can reach."""
    columns = ["rule_ord", "rule_id", "severity", "file", "line", F.col("title").alias("capability"), "evidence", "recommendation"]
    wanted = reduce(
        lambda a, b: a | b,
        [F.col("group").isin(*groups) & F.col("rule_id").rlike(prefix) for prefix, groups in _ECOSYSTEM],
    )
    own = seeds.select("plan_id", *SNAP, "ord", "file", "group")
    rows = own.join(
        scan_findings.select(*SNAP, "rule_ord", "rule_id", "severity", "file", "line", "title", "evidence", "recommendation"),
        [*SNAP, "file"],
    ).where(wanted).select("plan_id", "ord", *columns)
    if selected is not None:
        chosen = own.join(
            selected.select("plan_id", "rule_ord", "rule_id", "severity", "file", "line", "title", "evidence", "recommendation"),
            ["plan_id", "file"],
        ).where(wanted).select("plan_id", "ord", *columns)
        rows = rows.unionByName(chosen)
    return rows


def reach(
    plans: DataFrame,
    facts: FileFacts,
    scan_findings: DataFrame | None = None,
    selected: DataFrame | None = None,
    max_depth: int = MAX_CHAIN_DEPTH,
    max_nodes: int | None = MAX_NODES,
) -> Graph:
    """G1 for whole commands: seeds, command expansion, then the level loop.

    ``scan_findings`` are the repository's findings and ``selected`` those in files a command names;
    both feed the capabilities of build tools.
    """
    script_seeds, file_seeds, command_seeds = seed_frontier(plans, facts, max_nodes)
    empty_ord = F.array().cast("array<int>")
    label = F.concat(F.col("path"), F.lit(" scripts."), F.col("name"))

    # Seeds take node budget first, in command order.
    seed_rows = script_seeds.select(
        "plan_id", *SNAP, "ord", F.lit("package-script").alias("type"), label.alias("label"), F.col("path").alias("file"),
        "command", F.lit(None).cast("string").alias("group"), "reason", "next_reason", "indirect", "lifecycle", "name",
    ).unionByName(
        file_seeds.select(
            "plan_id", *SNAP, "ord", F.when(F.col("group") == "make", "makefile").otherwise("file").alias("type"),
            F.col("path").alias("label"), F.col("path").alias("file"), F.lit(None).cast("string").alias("command"),
            "group", _text_of(F.col("group"), 0).alias("reason"),
        ),
        allowMissingColumns=True,
    )
    seed_rows = cut_rows(
        seed_rows.withColumns(
            {
                "status": F.lit("file"), "target": F.col("label"), "parent_file": F.col("file"),
            }
        )
    )
    used = plans.select("plan_id", F.lit(1).cast("bigint").alias("used"))
    marked, over = node_budget(seed_rows, used, max_nodes)
    seeds = cut_rows(marked.where("admitted").drop("admitted"))
    doubts = [over] if over is not None else []
    used = granted(used, seeds)
    doubts.append(manifest_doubts(manifest_readers(plans), facts.manifests))
    ecosystem = seeds.where(F.col("group").isin(*[g for _prefix, groups in _ECOSYSTEM for g in groups]))
    unread = ecosystem.select("plan_id", *SNAP, "ord", F.col("file").alias("path")).join(facts.unreadable, [*SNAP, "path"])
    doubts.append(
        unread.select(
            "plan_id", "ord", F.lit("SCRIPT_PARSE_UNCERTAIN").alias("rule_id"), F.col("path").alias("file"),
            F.lit(_ECOSYSTEM_DOUBT).alias("detail"),
        )
    )

    # Commands to unwrap: the planned ones and the scripts of the seeds.
    rows = command_seeds.unionByName(
        seeds.where("type = 'package-script'").select(
            "plan_id", *SNAP, "ord", F.col("ord").alias("parent_ord"), F.col("file").alias("parent_file"),
            dirname(F.col("file")).alias("base_dir"), "command", F.col("next_reason").alias("reason"),
            F.array("label").alias("trail"),
        )
    )
    targets, script_nodes, command_doubts, used = expand_commands(rows, facts, used, max_nodes)
    doubts += command_doubts

    # First level: command targets, compose builds, and what Makefiles start.
    columns = [
        "plan_id", *SNAP, "ord", "parent_ord", "parent_file", "kind", "target", "reason", "resolved", "status",
    ]
    seed_edges = (
        seeds.where(F.col("group").isin("docker", "make"))
        .withColumnRenamed("reason", "seed_reason")
        .drop("target", "status")
        .withColumnRenamed("file", "path")
        .join(facts.edges, [*SNAP, "path"])
        .where(
            ((F.col("group") == "docker") & (F.col("kind") == "compose"))
            | ((F.col("group") == "make") & (F.col("kind") != "compose"))
        )
        .select(
            "plan_id", *SNAP, F.concat("ord", F.array("ref_ord")).alias("ord"), F.col("ord").alias("parent_ord"),
            F.col("path").alias("parent_file"), "kind", "target", "reason", "resolved", "status",
        )
    )
    level = seed_edges
    if targets is not None:
        level = level.unionByName(X.resolve(targets, facts.index).select(*columns))
        script_nodes = cut_rows(script_nodes)
    makefiles = cut_rows(
        seeds.where("group = 'make'").groupBy("plan_id", F.col("file").alias("path")).agg(F.min("ord").alias("ord"))
    )
    levels = expand_levels(level, facts.edges, used, max_depth, max_nodes, visited=makefiles.select("plan_id", "path"))
    doubts += levels.doubts

    # Nodes and edges.
    none = F.lit(None).cast("string")
    entry = plans.select(
        "plan_id", *SNAP, empty_ord.alias("ord"), F.lit("command").alias("type"), F.col("command").alias("label"),
        none.alias("file"), "command", none.alias("language"), F.lit(0).alias("depth"), none.alias("reason"),
        empty_ord.alias("parent_ord"),
    )
    parts = [
        entry,
        seeds.select(
            "plan_id", *SNAP, "ord", "type", "label", "file", "command",
            F.when(F.col("type") == "package-script", F.when(F.col("lifecycle"), F.lit("node-package")))
            .otherwise(_text_of(F.coalesce("group", F.lit("make")), 1)).alias("language"),
            F.lit(0).alias("depth"), "reason", empty_ord.alias("parent_ord"),
        ),
    ]
    if targets is not None:
        parts.append(
            script_nodes.select(
                "plan_id", *SNAP, "ord", F.lit("package-script").alias("type"), "label", "file", "command",
                none.alias("language"), F.lit(0).alias("depth"), "reason", "parent_ord",
            )
        )
    visits = levels.visits
    if visits is not None:
        parts.append(
            visits.select(
                "plan_id", *SNAP, "ord", F.lit("file").alias("type"), F.col("resolved").alias("label"),
                F.col("resolved").alias("file"), none.alias("command"), language_of(F.col("resolved")).alias("language"),
                "depth", "reason", "parent_ord",
            )
        )
    every = cut_rows(reduce(DataFrame.unionByName, parts))
    nodes = every.select(
        "plan_id", _node_id(F.col("ord")).alias("node_id"), "ord", "type", "label", "file", "command", "language", "depth"
    )
    edges = every.where("reason IS NOT NULL").select(
        "plan_id", _node_id(F.col("parent_ord")).alias("from_id"), _node_id(F.col("ord")).alias("to_id"), "ord", "reason"
    )

    # Files read by the resolver, at their first visit.
    read = seeds.where(F.col("group").isin("docker", "docker_build")).select("plan_id", *SNAP, "file", "ord")
    scanned = makefiles.join(plans.select("plan_id", *SNAP), "plan_id").withColumnRenamed("path", "file").select(
        "plan_id", *SNAP, "file", "ord"
    )
    if visits is not None:
        scanned = scanned.unionByName(
            visits.groupBy("plan_id", *SNAP, F.col("resolved").alias("file")).agg(F.min("ord").alias("ord"))
        )
    scanned = cut_rows(scanned)
    capabilities = read.unionByName(scanned).join(facts.capabilities, [*SNAP, "file"]).select(
        "plan_id", "ord", F.col("rule_ord"), "rule_id", "severity", "file", "line", "capability", "evidence",
        "recommendation",
    )
    rule, severity, what, advice = R.INDIRECT_EXECUTION
    indirect = seeds.where((F.col("type") == "package-script") & F.col("lifecycle") & F.col("indirect")).select(
        "plan_id", "ord", F.lit(-1).alias("rule_ord"), F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"),
        "file", F.lit(1).alias("line"), F.lit(what).alias("capability"),
        F.substring(F.concat(F.col("name"), F.lit(": "), F.col("command")), 1, 160).alias("evidence"),
        F.lit(advice).alias("recommendation"),
    )
    if scan_findings is not None:
        capabilities = capabilities.unionByName(_ecosystem_capabilities(seeds, scan_findings, selected))
    at_file = scanned.withColumnRenamed("file", "path")
    doubts.append(
        at_file.join(facts.dynamic, [*SNAP, "path"], "left_semi").select(
            "plan_id", "ord", F.lit("SCRIPT_DYNAMIC_MODULE_REFERENCE").alias("rule_id"), F.col("path").alias("file"),
            F.lit("").alias("detail"),
        )
    )
    doubts.append(
        at_file.join(facts.unreadable, [*SNAP, "path"], "left_semi").select(
            "plan_id", "ord", F.lit("SCRIPT_PARSE_UNCERTAIN").alias("rule_id"), F.col("path").alias("file"),
            F.lit("Could not read reachable file.").alias("detail"),
        )
    )
    return Graph(nodes, edges, indirect.unionByName(capabilities), uncertainties(doubts, max_nodes))


def uncertainties(doubts: list[DataFrame], max_nodes: int | None = MAX_NODES) -> DataFrame:
    """G9. Doubts of all kinds with severity, reason and advice; the budget is reported once."""
    every = reduce(DataFrame.unionByName, [d.select(*DOUBT_COLUMNS) for d in doubts])
    once = every.where("rule_id = 'SCRIPT_NODE_BUDGET_EXCEEDED'").groupBy("plan_id").agg(
        F.min_by(F.struct(*DOUBT_COLUMNS[1:]), "ord").alias("d")
    )
    rows = every.where("rule_id <> 'SCRIPT_NODE_BUDGET_EXCEEDED'").unionByName(once.select("plan_id", "d.*"))
    budget = f"({max_nodes}/{max_nodes})"
    texts = [(rule, severity, prefix.replace("(100/100)", budget), advice) for rule, severity, prefix, advice in R.UNCERTAINTIES]
    dim = every.sparkSession.createDataFrame(
        texts, "rule_id string, severity string, prefix string, recommendation string"
    )
    return rows.join(F.broadcast(dim), "rule_id").select(
        "plan_id", "ord", "rule_id", "severity", "file", F.concat("prefix", "detail").alias("reason"), "recommendation"
    )


def graph_findings(capabilities: DataFrame, doubts: DataFrame) -> DataFrame:
    """G10. Capabilities, then doubts, as findings."""
    first = capabilities.select(
        "plan_id", F.lit(2).alias("phase"), F.lit("").alias("order_path"), "ord", "rule_ord", "rule_id", "severity",
        F.lit(R.CAPABILITY_TITLE).alias("title"), "file", "line", "evidence",
        F.concat(F.lit("The planned command can reach "), F.col("capability"), F.lit(".")).alias("why_it_matters"),
        "recommendation",
    )
    second = doubts.select(
        "plan_id", F.lit(3).alias("phase"), F.lit("").alias("order_path"), "ord", F.lit(0).alias("rule_ord"), "rule_id",
        "severity", F.lit(R.UNCERTAINTY_TITLE).alias("title"), F.coalesce("file", F.lit("")).alias("file"),
        F.lit(0).alias("line"), F.col("reason").alias("evidence"),
        F.lit("Unknown execution paths are not safe for automatic execution.").alias("why_it_matters"),
        "recommendation",
    )
    return first.unionByName(second)


def edge_labels(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """J14. Edges with the label of the node they lead to."""
    labels = nodes.select("plan_id", F.col("node_id").alias("to_id"), "label")
    return edges.join(labels, ["plan_id", "to_id"], "left")
