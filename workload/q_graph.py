"""Reachability and the whole analysis: G1-G10, J9-J11, J14, R18-R21, A18, X3."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.operators import commands as C
from riskspark.operators import graph as G
from riskspark.operators import reach as X
from riskspark.operators import scan as S
from riskspark.catalogue.files import CRITICAL_BASENAMES
from riskspark.plans.assess import assess
from riskspark.plans.incremental import assess_incremental, plan_fingerprints
from riskspark.session import cut_columns, scratch_path
from workload.q_policy import per_command, plans
from workload.q_rules import EXT, NAME, in_list, q
from workload.registry import Tables, define, query

SNAP = ["repo_id", "snapshot_id"]
_KEPT: dict = {}


def kept(t: Tables, name: str, build):
    """Results whose parts are already stored, shared by the queries of one session."""
    key = (t.spark.sparkContext.applicationId, t.folder, name)
    if key not in _KEPT:
        _KEPT[key] = build()
    return _KEPT[key]


def facts(t: Tables):
    return kept(t, "facts", lambda: G.file_facts(t.files))


def analysis(t: Tables):
    return kept(t, "analysis", lambda: assess(t.files, t.commands, t.origins))


# ---- the level loop over the business tables ------------------------------------------------


def _business_edges(t: Tables) -> DataFrame:
    """region -> nation -> customer -> order -> line item, as resolved references; what differs is stored, as every level reads it."""
    return kept(t, "business_edges", lambda: cut_columns(_built_edges(t))).select(
        F.lit("r").alias("repo_id"), F.lit("s").alias("snapshot_id"), "path", "ref_ord", F.lit("shell").alias("kind"), "target",
        F.lit("holds").alias("reason"), F.col("target").alias("resolved"), F.lit("file").alias("status"),
    )


def _built_edges(t: Tables) -> DataFrame:

    def step(table: str, parent: str, parent_key: str, child: str, child_key: str):
        return t.given(table).select(
            F.concat(F.lit(f"{parent}/"), F.col(parent_key).cast("string")).alias("path"),
            F.col(child_key).cast("int").alias("ref_ord"),
            F.concat(F.lit(f"{child}/"), F.col(child_key).cast("string")).alias("target"),
        )

    lines = t.given("lineitem").select(
        F.concat(F.lit("order/"), F.col("l_orderkey").cast("string")).alias("path"),
        F.col("l_linenumber").alias("ref_ord"),
        F.concat_ws("/", F.lit("line"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("target"),
    )
    return reduce(DataFrame.unionByName, [
        step("nation", "region", "n_regionkey", "nation", "n_nationkey"),
        step("customer", "nation", "c_nationkey", "customer", "c_custkey"),
        step("orders", "customer", "o_custkey", "order", "o_orderkey"),
        lines,
    ])


def _first_level(t: Tables) -> DataFrame:
    return t.given("region").select(
        F.col("r_name").alias("plan_id"), F.lit("r").alias("repo_id"), F.lit("s").alias("snapshot_id"),
        F.array(F.lit(0)).alias("ord"), F.array().cast("array<int>").alias("parent_ord"), F.lit(None).cast("string").alias("parent_file"),
        F.lit("shell").alias("kind"), F.concat(F.lit("region/"), F.col("r_regionkey").cast("string")).alias("target"),
        F.lit("starts").alias("reason"), F.concat(F.lit("region/"), F.col("r_regionkey").cast("string")).alias("resolved"),
        F.lit("file").alias("status"),
    )


def _used(t: Tables) -> DataFrame:
    return t.given("region").select(F.col("r_name").alias("plan_id"), F.lit(1).cast("bigint").alias("used"))


_TREE = """region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey"""


@query("g1_reach_levels", f"""
  SELECT r_name AS plan_id, 1 AS depth, count(*) AS nodes FROM region GROUP BY r_name
  UNION ALL SELECT r_name, 2, count(*) FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name
  UNION ALL SELECT r_name, 3, count(*) FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey GROUP BY r_name
  UNION ALL SELECT r_name, 4, count(*) FROM {_TREE} GROUP BY r_name
  UNION ALL SELECT r_name, 5, count(*) FROM {_TREE} JOIN lineitem ON l_orderkey = o_orderkey GROUP BY r_name""")
def g1_levels(t: Tables):
    levels = G.expand_levels(_first_level(t), _business_edges(t), _used(t), max_nodes=None)
    return levels.visits.groupBy("plan_id", "depth").agg(F.count("*").alias("nodes"))


@query("g7_depth_budget", f"""
  SELECT r_name AS plan_id, 'customer/' || c_custkey AS file, count(*) AS cut FROM {_TREE} GROUP BY r_name, c_custkey""")
def g7(t: Tables):
    levels = G.expand_levels(_first_level(t), _business_edges(t), _used(t), max_depth=3, max_nodes=None)
    cut_off = reduce(DataFrame.unionByName, [d.select("plan_id", "rule_id", "file") for d in levels.doubts])
    return cut_off.where("rule_id = 'SCRIPT_CHAIN_DEPTH_EXCEEDED'").groupBy("plan_id", "file").agg(F.count("*").alias("cut"))


@query("g8_script_budget", f"""
  WITH nested AS (SELECT r_name AS plan_id, n_nationkey, row_number() OVER (PARTITION BY r_name ORDER BY n_nationkey) AS place
                  FROM region JOIN nation ON n_regionkey = r_regionkey),
  spent AS (SELECT plan_id, 1 + count(*) FILTER (place <= 3) AS used FROM nested GROUP BY plan_id)
  SELECT n.plan_id, 'script' AS kind, 'nation/' || n_nationkey AS target, place <= 3 AS admitted FROM nested n
  UNION ALL
  SELECT plan_id, 'file', target, place <= 20 - used FROM (
    SELECT r_name AS plan_id, 'customer/' || c_custkey AS target,
           row_number() OVER (PARTITION BY r_name ORDER BY n_nationkey, c_custkey) AS place
    FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey) JOIN spent USING (plan_id)""")
def g8_scripts(t: Tables):
    """One ledger: nations as scripts of a plan limited to four nodes in their round, then its customers under a budget of 20."""
    nations = t.given("region").join(t.given("nation"), F.col("n_regionkey") == F.col("r_regionkey"))
    columns = [F.col("r_name").alias("plan_id"), F.lit("file").alias("status"), F.lit("region").alias("parent_file")]
    scripts = nations.select(
        *columns, F.array(F.col("n_nationkey").cast("int")).alias("ord"), F.concat(F.lit("nation/"), F.col("n_nationkey").cast("string")).alias("target")
    )
    first, _over = G.node_budget(scripts, _used(t), 4)
    used = G.granted(_used(t), first.where("admitted"))
    customers = nations.join(t.given("customer"), F.col("c_nationkey") == F.col("n_nationkey")).select(
        *columns, F.array(F.col("n_nationkey").cast("int"), F.col("c_custkey").cast("int")).alias("ord"),
        F.concat(F.lit("customer/"), F.col("c_custkey").cast("string")).alias("target"),
    )
    second, _over = G.node_budget(customers, used, 20)
    return reduce(DataFrame.unionByName, [
        d.select("plan_id", F.lit(kind).alias("kind"), "target", "admitted") for kind, d in (("script", first), ("file", second))
    ])


@query("g8_node_budget", """
  SELECT plan_id, target, place <= 93 AS admitted FROM (
    SELECT r_name AS plan_id, 'customer/' || c_custkey AS target,
           row_number() OVER (PARTITION BY r_name ORDER BY n_nationkey, c_custkey) AS place
    FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey)""")
def g8(t: Tables):
    """The customers of a region are one level; a region, its entry and five nations already count."""
    customers = t.given("region").join(t.given("nation"), F.col("n_regionkey") == F.col("r_regionkey")).join(
        t.given("customer"), F.col("c_nationkey") == F.col("n_nationkey")
    ).select(
        F.col("r_name").alias("plan_id"), F.array(F.col("n_nationkey").cast("int"), F.col("c_custkey").cast("int")).alias("ord"),
        F.lit("file").alias("status"), F.concat(F.lit("nation/"), F.col("n_nationkey").cast("string")).alias("parent_file"),
        F.concat(F.lit("customer/"), F.col("c_custkey").cast("string")).alias("target"),
    )
    used = _used(t).withColumn("used", F.lit(7).cast("bigint"))
    marked, _over = G.node_budget(customers, used, 100)
    return marked.select("plan_id", "target", "admitted")


# ---- references -----------------------------------------------------------------------------

_TOKEN = "\"[^\"]*\"|''[^'']*''|[^\\s\"'']\\S*"
define("line_tokens", f"""
  SELECT repo_id, path, line_no, trim(regexp_extract(line, '^[ \\t\\r]*({_TOKEN})', 1), '"''') AS t1,
         trim(regexp_extract(line, '^[ \\t\\r]*(?:{_TOKEN})[ \\t\\r]*({_TOKEN})', 1), '"''') AS t2,
         regexp_matches(line, '^[ \\t\\r]*(?:{_TOKEN})[ \\t\\r]*({_TOKEN})') AS two FROM file_lines""")
define("shell_refs", """
  SELECT repo_id, path, line_no, CASE WHEN two AND lower(t1) IN ('bash', 'sh', 'python', 'node', 'powershell', 'pwsh', 'source', '.') THEN t2 ELSE t1 END AS target,
         CASE WHEN two AND lower(t1) IN ('source', '.') THEN 'shell source indirection' ELSE 'command invokes local script' END AS reason
  FROM line_tokens WHERE (two AND lower(t1) IN ('bash', 'sh', 'python', 'node', 'powershell', 'pwsh', 'source', '.'))
     OR starts_with(t1, './') OR regexp_matches(t1, '[^/]\\.(sh|bash|zsh|ps1|bat|cmd)$')""")


@query("g3_extract_refs_shell", "SELECT repo_id, path, target, reason, count(*) AS n FROM shell_refs GROUP BY ALL")
def g3(t: Tables):
    refs = X.extract_refs(t.files).where("kind = 'shell'")
    return refs.groupBy("repo_id", "path", "target", "reason").agg(F.count("*").alias("n"))


define("node_refs", f"""
  SELECT DISTINCT repo_id, path, target, CASE WHEN how = 0 THEN 'Node require reaches local module' ELSE 'Node import reaches local module' END AS reason
  FROM (SELECT repo_id, path, unnest(regexp_extract_all(text, 'require\\s*\\(\\s*"(\\.{{1,2}}/[^"]+)"\\s*\\)', 1)) AS target, 0 AS how FROM files WHERE lower({EXT}) IN ('.js', '.ts')
        UNION ALL SELECT repo_id, path, unnest(regexp_extract_all(text, 'import\\s+(?:\\w+\\s+from\\s+)?"(\\.{{1,2}}/[^"]+)"', 1)), 1 FROM files WHERE lower({EXT}) IN ('.js', '.ts'))""")


@query("g4_extract_refs_node", "SELECT * FROM node_refs")
def g4(t: Tables):
    return X.extract_refs(t.files).where("kind = 'node'").select("repo_id", "path", "target", "reason")


@query("g5_extract_refs_compose", """
  SELECT repo_id, path, CASE WHEN contains(text, 'build: .') THEN 'Dockerfile' ELSE 'deploy/' || regexp_extract(text, 'dockerfile: (\\S+)', 1) END AS target
  FROM files WHERE path = 'docker-compose.yml' AND contains(text, 'build:')""")
def g5(t: Tables):
    return X.extract_refs(t.files).where("kind = 'compose'").select("repo_id", "path", "target")


_NAMES = ("postinstall", "preinstall", "prepare", "build", "compile", "test", "install")
define("scripts", " UNION ALL ".join(
    f"SELECT repo_id, path, '{n}' AS name, CASE WHEN json_valid(text) AND json_type(text, '$.scripts.{n}') = 'VARCHAR' THEN json_extract_string(text, '$.scripts.{n}') END AS command "
    f"FROM files WHERE {NAME} = 'package.json'" for n in _NAMES
))


@query("g6_package_scripts", """
  SELECT repo_id, path, name, command, regexp_matches(command, '^(bash|sh|python|node) ') AS indirect FROM scripts WHERE command IS NOT NULL""")
def g6(t: Tables):
    return X.package_scripts(t.files).select("repo_id", "path", "name", "command", "indirect")


define("shell_resolved", """
  SELECT r.repo_id, r.path, r.target, r.line_no, coalesce(a.path, b.path) AS resolved,
         CASE WHEN starts_with(r.target, '/') THEN 'outside' WHEN coalesce(a.path, b.path) IS NOT NULL THEN 'file'
              WHEN starts_with(r.target, '../') THEN 'outside' ELSE 'missing' END AS status
  FROM (SELECT *, regexp_replace(target, '^(\\./)+', '') AS clean, CASE WHEN contains(path, '/') THEN regexp_replace(path, '[^/]*$', '') ELSE '' END AS folder FROM shell_refs) r
  LEFT JOIN files a ON a.repo_id = r.repo_id AND a.path = r.clean LEFT JOIN files b ON b.repo_id = r.repo_id AND b.path = r.folder || r.clean""")


@query("j9_resolve_targets", "SELECT repo_id, path, target, resolved, status, count(*) AS n FROM shell_resolved GROUP BY ALL")
def j9(t: Tables):
    refs = X.with_bases(X.extract_refs(t.files)).where("kind = 'shell'")
    good, bad = X.resolve_targets(refs, t.files)
    return good.unionByName(bad).groupBy("repo_id", "path", "target", "resolved", "status").agg(F.count("*").alias("n"))


@query("j10_resolve_module_refs", """
  SELECT r.repo_id, r.path, r.target, f.path AS resolved, CASE WHEN f.path IS NULL THEN 'missing' ELSE 'file' END AS status
  FROM node_refs r LEFT JOIN files f ON f.repo_id = r.repo_id
   AND regexp_replace(f.path, '\\.(js|mjs|cjs|ts|tsx)$', '') = CASE WHEN starts_with(r.target, '../') THEN substr(r.target, 4)
       WHEN contains(r.path, '/') THEN regexp_replace(r.path, '[^/]*$', '') || substr(r.target, 3) ELSE substr(r.target, 3) END""")
def j10(t: Tables):
    refs = X.with_bases(X.extract_refs(t.files))
    good, bad = X.resolve_module_refs(refs, t.files)
    return good.unionByName(bad).select("repo_id", "path", "target", "resolved", "status")


@query("j11_resolve_python_modules", """
  SELECT f.doc_id, 'tools.run' AS target, g.path AS resolved FROM files f
  LEFT JOIN files g ON g.repo_id = f.repo_id AND g.path = 'tools/run.py' WHERE f.path = 'README.md'
  UNION ALL SELECT doc_id, 'lib.gone', NULL FROM files WHERE path = 'README.md'""")
def j11(t: Tables):
    refs = t.files.where("path = 'README.md'").select(
        *SNAP, "doc_id", F.lit("module").alias("kind"), F.explode(F.array(F.lit("tools.run"), F.lit("lib.gone"))).alias("target"),
        F.lit("").alias("base_dir"), F.lit(None).cast("string").alias("fallback_dir"),
    )
    good, bad = X.resolve_python_modules(refs, t.files)
    return good.unionByName(bad).select("doc_id", "target", "resolved")


def _cap(rule: str, regex: str, gate: str) -> str:
    return (
        f"SELECT repo_id, path AS file, '{rule}' AS rule_id, substr(regexp_extract(text, {q(regex)}, 0), 1, 160) AS evidence FROM files "
        f"WHERE {gate} AND regexp_matches(text, {q(regex)})"
    )


_JS = f"lower({EXT}) IN ('.js', '.ts')"
_PY = f"lower({EXT}) = '.py'"
_DOCKER = f"{NAME} IN ('Dockerfile', 'docker-compose.yml')"


@query("r18_capabilities_node", " UNION ALL ".join([
    _cap("JS_CHILD_PROCESS_EXEC", r"(?i)child_process\.(?:exec|spawn)|require\s*\(\s*[\"'](?:node:)?child_process[\"']\s*\)\s*\.\s*(?:exec|spawn)\s*\(|\b\w+\.(?:exec|spawn)\s*\(|\b(?:exec|spawn|execSync|spawnSync)\s*\(", _JS),
    _cap("JS_DYNAMIC_EVAL", r"(?i)\b(?:eval|Function)\s*\(", _JS),
    _cap("JS_NETWORK_ACCESS", r"(?i)\b(?:https|http)\.request\s*\(|\bfetch\s*\(", _JS),
    _cap("JS_ENV_ACCESS", r"(?i)\bprocess\.env\b", _JS),
]))
def r18(t: Tables):
    return X.scan_capabilities(t.files, ("node",)).where("rule_id LIKE 'JS_%'").select("repo_id", "file", "rule_id", "evidence")


@query("r19_capabilities_python", " UNION ALL ".join([
    _cap("PYTHON_SUBPROCESS_EXEC", r"(?i)\bsubprocess\.(?:run|Popen)\s*\(|\bos\.system\s*\(", _PY),
    _cap("PYTHON_DYNAMIC_EXEC", r"(?i)\b(?:eval|exec)\s*\(", _PY),
    _cap("PYTHON_NETWORK_ACCESS", r"(?i)\burllib\.request\.urlopen\s*\(|\brequests\.(?:get|post)\s*\(", _PY),
    _cap("PYTHON_ENV_ACCESS", r"(?i)\bos\.environ\b", _PY),
]))
def r19(t: Tables):
    return X.scan_capabilities(t.files, ("python",)).select("repo_id", "file", "rule_id", "evidence")


_SH = "starts_with(path, 'scripts/')"


@query("r20_capabilities_shell", " UNION ALL ".join([
    _cap("SHELL_SOURCE_INDIRECTION", r"(?im)^\s*(?:source|\.)\s+(\./)?\S+", _SH),
    _cap("SHELL_EVAL_USAGE", r"(?im)^eval\b", _SH),
    _cap("SHELL_DECODE_EXEC", r"(?i)base64\s+-d[^\n]*\|\s*(?:sh|bash)", _SH),
    _cap("SHELL_DOWNLOAD_CAPABILITY", r"(?im)\b(?:curl|wget)\b", _SH),
]))
def r20(t: Tables):
    scripts = t.files.where(F.col("path").startswith("scripts/"))
    return X.scan_capabilities(scripts, ("shell",)).where("rule_id LIKE 'SHELL_%'").select("repo_id", "file", "rule_id", "evidence")


@query("r21_capabilities_docker", " UNION ALL ".join([
    _cap("DOCKER_REACHABLE_RUN_REMOTE_EXEC", r"(?i)RUN\s+(?:curl\b[^\n]*\|\s*bash|wget\b[^\n]*\|\s*sh)", _DOCKER),
    _cap("DOCKER_REACHABLE_ENTRYPOINT_SCRIPT", r"(?im)^(?:ENTRYPOINT|CMD)\s+[^\n]*\.(?:sh|bash|ps1)", _DOCKER),
    _cap("DOCKER_SOCKET_MOUNT", r"(?i)/var/run/docker\.sock", _DOCKER),
    _cap("DOCKER_PRIVILEGED_CONTAINER", r"(?i)privileged:\s*true", _DOCKER),
    _cap("DOCKER_PRIVILEGED_CONTAINER", r"(?i)network_mode:\s*host", _DOCKER),
]))
def r21(t: Tables):
    return X.scan_capabilities(t.files, ("docker",)).select("repo_id", "file", "rule_id", "evidence")


# ---- whole commands -------------------------------------------------------------------------


@query("g2_seed_frontier", """
  SELECT DISTINCT c.repo_id, c.command, f.path FROM commands c JOIN files f ON f.repo_id = c.repo_id
  WHERE NOT regexp_matches(f.path, '^(node_modules|fixtures)/') AND CASE
    WHEN c.command = 'docker compose up' THEN f.path IN ('Dockerfile', 'docker-compose.yml')
    WHEN c.command = 'docker build .' THEN f.path = 'Dockerfile' WHEN starts_with(c.command, 'docker run') THEN f.path IN ('Dockerfile', 'docker-compose.yml')
    WHEN c.command = 'make' THEN f.path = 'Makefile'
    WHEN starts_with(c.command, 'cargo') THEN f.path IN ('Cargo.toml', 'Cargo.lock', 'build.rs', '.cargo/config.toml')
    WHEN starts_with(c.command, 'go ') THEN f.path IN ('go.mod', 'main.go') WHEN starts_with(c.command, 'mvn') THEN f.path = 'pom.xml'
    WHEN c.command = './gradlew build' THEN f.path IN ('settings.gradle', 'buildSrc/build.gradle.kts', 'gradle/wrapper/gradle-wrapper.properties')
    WHEN c.command = 'bundle install' THEN f.path IN ('Gemfile', 'demo.gemspec', 'ext/extconf.rb')
    WHEN c.command = 'bundle exec rake install' THEN f.path IN ('Gemfile', 'demo.gemspec', 'Rakefile') WHEN c.command = 'rake test' THEN f.path = 'Rakefile' ELSE false END""")
def g2(t: Tables):
    _scripts, seeds, _commands = G.seed_frontier(plans(t), facts(t))
    return seeds.join(plans(t).select("plan_id", "command"), "plan_id").select("repo_id", "command", "path").distinct()


@query("g1_reach_commands")
def g1(t: Tables):
    return per_command(t, analysis(t).graph.nodes).select("command_id", "node_id", "type", "label", "language", "depth")


@query("g9_manifest_states", f"""
  SELECT repo_id, path, CASE WHEN json_valid(text) THEN 'validated' ELSE 'broken' END AS state FROM files WHERE {NAME} = 'package.json'""")
def g9_states(t: Tables):
    return X.manifest_states(t.files).select("repo_id", "path", "state")


@query("g9_manifest_doubts", f"""
  SELECT DISTINCT c.repo_id, c.command, f.path AS file, 'Could not parse package.json.' AS detail FROM commands c JOIN files f ON f.repo_id = c.repo_id
  WHERE {NAME.replace("path", "f.path")} = 'package.json' AND NOT json_valid(f.text) AND NOT regexp_matches(f.path, '^(node_modules|fixtures)/')
    AND (c.command IN ('npm install', 'pnpm install', 'yarn install', 'bundle install', 'pip install .', 'npm run build', 'npm test', 'cd app && npm ci; ls')
         OR c.command = 'uv sync || poetry install')""")
def g9_doubts(t: Tables):
    doubts = G.manifest_doubts(G.manifest_readers(plans(t)), facts(t).manifests)
    return doubts.join(plans(t).select("plan_id", "repo_id", "command"), "plan_id").select("repo_id", "command", "file", "detail").distinct()


@query("g9_uncertainties")
def g9(t: Tables):
    return per_command(t, analysis(t).graph.uncertainties).select("command_id", "rule_id", "severity", "file", "reason")


@query("g10_graph_findings")
def g10(t: Tables):
    graph = analysis(t).graph
    return per_command(t, G.graph_findings(graph.capabilities, graph.uncertainties)).select(
        "command_id", "phase", "rule_id", "severity", "file", "evidence"
    )


@query("j14_edge_labels", """
  SELECT n.n_regionkey AS plan_id, c.c_custkey AS from_id, c.c_nationkey AS to_id, n.n_name AS label FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey
  UNION ALL SELECT -1, s_suppkey, s_nationkey, NULL FROM supplier""")
def j14(t: Tables):
    """Customers as edges to labelled nations, suppliers as edges of a plan without nodes."""
    nodes = t.given("nation").select(
        F.col("n_regionkey").alias("plan_id"), F.col("n_nationkey").alias("node_id"), F.col("n_name").alias("label")
    )
    edges = t.given("customer").join(nodes, F.col("c_nationkey") == F.col("node_id")).select(
        "plan_id", F.col("c_custkey").alias("from_id"), F.col("c_nationkey").alias("to_id")
    ).unionByName(
        t.given("supplier").select(F.lit(-1).alias("plan_id"), F.col("s_suppkey").alias("from_id"), F.col("s_nationkey").alias("to_id"))
    )
    return G.edge_labels(edges, nodes).select("plan_id", "from_id", "to_id", "label")


@query("x3_command_aware", """
  SELECT DISTINCT c.repo_id, c.command, f.path AS file, 'JAVA_MAVEN_PLUGIN_EXECUTION' AS rule_id FROM commands c JOIN files f ON f.repo_id = c.repo_id
  WHERE starts_with(c.command, 'mvn -f') AND f.path = 'pom.xml' AND contains(f.text, '<execution>')""")
def x3(t: Tables):
    found = C.command_targets(plans(t), t.files).where("role <> 'argument'")
    chosen = t.files.select(*SNAP, "path", "text").join(found, [*SNAP, "path"])
    return S.scan_command_aware(chosen).join(plans(t).select("plan_id", "repo_id", "command"), "plan_id").select(
        "repo_id", "command", "file", "rule_id"
    )


@query("assess_verdicts")
def verdict_rows(t: Tables):
    return analysis(t).per_command(t.commands).select(
        "command_id", "repo_id", "command", "scope", "decision", "risk_score", "reason", "selector", "selected_rule"
    )


_LINE = "f.path || ':' || sha256(f.text)"
_CRITICAL = (
    f"({NAME} IN {in_list(CRITICAL_BASENAMES)} OR regexp_matches(path, '^(\\.github/workflows/|\\.cursor/rules|scripts/|bin/|tools/|\\.mcp/|\\.cargo/|gradle/|buildSrc/)')"
    " OR regexp_matches(path, '\\.(go|gemspec)$') OR regexp_matches(path, '^docs/.*\\.(md|markdown|html|htm)$'))"
    " AND NOT regexp_matches(path, '^(node_modules|fixtures)/')"
)


@query("a10_plan_fingerprints", f"""
  WITH base AS (SELECT repo_id, 'sha256:' || sha256(string_agg({_LINE}, chr(10) ORDER BY path)) AS fp FROM files f WHERE {_CRITICAL} GROUP BY repo_id)
  SELECT DISTINCT c.repo_id, c.command, CASE WHEN c.command = 'node setup.js' AND s.text IS NOT NULL
    THEN 'sha256:' || sha256(coalesce(b.fp, 'sha256:' || sha256('')) || chr(10) || 'setup.js:' || sha256(s.text)) ELSE coalesce(b.fp, 'sha256:' || sha256('')) END AS fingerprint
  FROM commands c LEFT JOIN base b ON b.repo_id = c.repo_id LEFT JOIN files s ON s.repo_id = c.repo_id AND s.path = 'setup.js'""")
def a10_plans(t: Tables):
    found = plan_fingerprints(t.raw_files, plans(t)).join(plans(t).select("plan_id", "repo_id", "command"), "plan_id")
    return found.select("repo_id", "command", F.col("critical_fingerprint").alias("fingerprint"))


@query("assess_incremental")
def incremental(t: Tables):
    """A first run stores its results; then one repository in three has another README, and a second run scans what that opens."""
    store, at = scratch_path(t.spark, "incremental"), F.lit("2024-01-15 00:00:00").cast("timestamp")
    known = t.files.select(*SNAP).distinct().withColumn("head_commit", F.lit(None).cast("string"))
    assess_incremental(t.raw_files, t.commands, known, store, at, t.origins)
    number = F.regexp_extract("repo_id", r"(\d+)$", 1).cast("long")
    changed = (F.col("path") == "README.md") & (number % 3 == 1)
    files = t.raw_files.withColumn("content", F.when(changed, F.encode(F.concat(F.lit("new "), "path"), "UTF-8")).otherwise(F.col("content")))
    second = assess_incremental(files, t.commands, known, store, at, t.origins)
    return second.per_command(t.commands).select("command_id", "repo_id", "command", "decision", "risk_score", "used_scan_cache")


@query("a18_assemble_report")
def a18(t: Tables):
    rows = analysis(t).reports()
    return rows.select(
        "report.decision", "report.riskScore", "report.command", F.size("report.findings").alias("findings"),
        F.size("report.executionGraph.nodes").alias("nodes"), F.to_json("report").alias("document"),
    )
