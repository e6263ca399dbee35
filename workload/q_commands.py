"""Commands and scalar functions: F1-F4, F10-F21, P7-P13, R17, J17."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskspark.functions import hashing as H
from riskspark.functions import paths as PT
from riskspark.functions import scope as SC
from riskspark.functions import targets as TG
from riskspark.functions import timefmt as TF
from riskspark.functions import validate as V
from riskspark.functions import words as WD
from riskspark.functions.rows import numbered
from riskspark.operators import commands as C
from workload.derive import COMMANDS
from workload.registry import Tables, define, query

KEY = b"riskspark-example-key"

_SPLIT = (
    "list_filter(list_transform(string_split(array_to_string(list_transform(regexp_extract_all(command, '\"[^\"]*\"|[^\"]+'), "
    "lambda p: CASE WHEN starts_with(p, '\"') THEN p ELSE regexp_replace(p, '&&|\\|\\||;', chr(1), 'g') END), ''), chr(1)), "
    "lambda s: trim(s)), lambda s: s <> '')"
)
define("segments", f"""
  SELECT command_id, repo_id, command, unnest(parts) AS segment, generate_subscripts(parts, 1) - 1 AS seg_no, len(parts) AS n
  FROM (SELECT command_id, repo_id, command, {_SPLIT} AS parts FROM commands)""")


@query("f1_split_segments", "SELECT command_id, CAST(seg_no AS INTEGER) AS seg_no, segment FROM segments")
def f1(t: Tables):
    return numbered(t.commands, WD.split_segments(F.col("command")), "seg_no", "segment").select(
        "command_id", "seg_no", "segment"
    )


@query("f2_split_words", """
  SELECT command_id, replace(array_to_string(regexp_extract_all(command, '(?:[^\\s"]|"[^"]*")+'), '|'), '"', '') AS words FROM commands""")
def f2(t: Tables):
    return t.commands.select("command_id", F.array_join(WD.split_words(F.col("command")), "|").alias("words"))


@query("f3_f4_path_parts", """
  SELECT path, regexp_extract(path, '[^/]*$', 0) AS base, regexp_extract(path, '[^/](\\.[^./]+)$', 1) AS ext,
         CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END AS folder,
         CAST(len(string_split(path, '/')) AS INTEGER) AS depth, trim(path) AS normal, count(*) AS n
  FROM manifest GROUP BY path""")
def f3(t: Tables):
    path = F.col("path")
    token = F.concat(F.lit(' "./'), F.replace(path, F.lit("/"), F.lit("\\")), F.lit('" '))
    rows = t.manifest.groupBy("path").agg(F.count("*").alias("n"))
    return rows.select(
        "path", PT.basename(path).alias("base"), PT.suffix(path).alias("ext"), PT.dirname(path).alias("folder"),
        PT.path_depth(path).alias("depth"), PT.strip(PT.normalize_path(token)).alias("normal"), "n",
    )


@query("f10_keyed_hash", f"""
  SELECT c_custkey, 'hmac-sha256:' || sha256(unhex('{bytes(b ^ 0x5C for b in KEY.ljust(64, bytes(1))).hex()}') ||
         unhex(sha256(unhex('{bytes(b ^ 0x36 for b in KEY.ljust(64, bytes(1))).hex()}') || encode(c_name)))) AS pseudonym FROM customer""")
def f10(t: Tables):
    return t.given("customer").select("c_custkey", H.keyed_hash(F.col("c_name"), KEY).alias("pseudonym"))


@query("f11_content_digest", "SELECT doc_id, sha256(text) AS digest FROM documents")
def f11(t: Tables):
    return t.given("documents").select("doc_id", H.content_digest(F.encode("text", "UTF-8")).alias("digest"))


@query("f12_canonical_json", """
  SELECT o_orderkey, '{"key":' || o_orderkey || ',"priority":"' || o_orderpriority || '","status":' ||
         CASE WHEN o_orderstatus = 'P' THEN 'null' ELSE '"' || o_orderstatus || '"' END || '}' AS document FROM orders""")
def f12(t: Tables):
    status = F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus"))
    fields = {"status": status, "key": F.col("o_orderkey"), "priority": F.col("o_orderpriority")}
    return t.given("orders").select("o_orderkey", H.canonical_json(fields).alias("document"))


@query("f13_parse_ttl", """
  SELECT unit, amount, CASE unit WHEN 'h' THEN amount * 3600 WHEN 'd' THEN amount * 86400 END AS seconds, count(*) AS n
  FROM (SELECT CAST(l_quantity AS BIGINT) AS amount, CASE mod(l_linenumber, 3) WHEN 0 THEN 'h' WHEN 1 THEN 'd' ELSE 'w' END AS unit FROM lineitem)
  GROUP BY unit, amount""")
def f13(t: Tables):
    unit = F.expr("CASE mod(l_linenumber, 3) WHEN 0 THEN 'h' WHEN 1 THEN 'd' ELSE 'w' END")
    rows = t.given("lineitem").select(F.col("l_quantity").cast("bigint").alias("amount"), unit.alias("unit"))
    ttl = TF.parse_ttl(F.concat(F.col("amount").cast("string"), F.col("unit")))
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp")
    return rows.groupBy("unit", "amount").agg(F.count("*").alias("n")).select(
        "unit", "amount", F.unix_seconds(epoch + ttl).alias("seconds"), "n"
    )


_STAMP = """SELECT o_orderkey, o_orderdate,
         CASE mod(o_orderkey, 4) WHEN 0 THEN 'Z' WHEN 1 THEN '+02:00' WHEN 2 THEN '' ELSE '.250-05:30' END AS tail FROM orders"""


@query("f14_parse_ts", f"""
  SELECT o_orderkey, CASE tail WHEN 'Z' THEN epoch_us(o_orderdate) WHEN '+02:00' THEN epoch_us(o_orderdate) - 7200000000
         WHEN '.250-05:30' THEN epoch_us(o_orderdate) + 250000 + 19800000000 END AS micros FROM ({_STAMP})""")
def f14(t: Tables):
    rows = t.sql(_STAMP)
    text = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.col("tail"))
    return rows.select("o_orderkey", F.unix_micros(TF.parse_ts(text)).alias("micros"))


_IDS = """SELECT c_custkey, CASE mod(c_custkey, 5) WHEN 0 THEN concat(substr(h, 1, 8), '-', substr(h, 9, 4), '-4', substr(h, 14, 3), '-b', substr(h, 18, 3), '-', substr(h, 21, 12))
         WHEN 1 THEN concat(h, '01234567') WHEN 2 THEN concat('sha256:', h, h) WHEN 3 THEN upper(concat(h, '01234567')) ELSE h END AS value
         FROM (SELECT c_custkey, md5(c_name) AS h FROM customer) c"""


@query("f15_identifier_checks", f"""
  SELECT c_custkey, mod(c_custkey, 5) = 0 AS uuid4, mod(c_custkey, 5) = 1 AS git_commit, mod(c_custkey, 5) = 2 AS fingerprint FROM ({_IDS})""")
def f15(t: Tables):
    v = F.col("value")
    return t.sql(_IDS).select(
        "c_custkey", V.is_uuid4(v).alias("uuid4"), V.is_commit(v).alias("git_commit"), V.is_fingerprint(v).alias("fingerprint")
    )


@query("f17_collision_key", """
  SELECT doc_id, replace(lower(nfc_normalize(text)), 'ß', 'ss') AS collision_key FROM documents""")
def f17(t: Tables):
    return t.given("documents").select("doc_id", PT.collision_key(F.col("text")).alias("collision_key"))


# Scopes in SQL: one ranked rule list over each segment, then the riskiest, then the first.
_W1 = "lower(regexp_extract(unit, '^\\s*(\\S+)', 1))"
_W2 = "lower(regexp_extract(unit, '^\\s*\\S+\\s+(\\S+)', 1))"
_TOOL = f"regexp_extract({_W1}, '[^/]*$', 0)"
_TASK = "lower(regexp_extract(unit, '^\\s*\\S+(?:\\s+-\\S+\\s+(?:\"[^\"]*\"|\\S+))*\\s+([^-\\s]\\S*)\\s*$', 1))"
_RULES = [
    (f"(contains(lower(unit), 'curl ') OR contains(lower(unit), 'wget ')) AND (contains(lower(unit), '| bash') OR contains(lower(unit), '| sh'))", 8, "network_shell", "Remote shell pipeline."),
    (f"contains(lower(unit), 'mcp') AND {_W1} IN ('npx', 'node', 'python')", 4, "mcp_server_start", "MCP server startup."),
    (f"{_W1} IN ('npm', 'pnpm', 'yarn') AND {_W2} IN ('install', 'ci', 'add')", 7, "dependency_install", "Node dependency install."),
    (f"{_W1} = 'pip' AND {_W2} = 'install'", 7, "dependency_install", "Python dependency install."),
    (f"{_W1} = 'poetry' AND {_W2} = 'install'", 7, "dependency_install", "Poetry dependency install."),
    (f"{_W1} = 'uv' AND {_W2} IN ('sync', 'pip')", 7, "dependency_install", "uv dependency install."),
    (f"{_W1} IN ('bundle', 'bundler') AND {_W2} = 'install'", 7, "dependency_install", "Bundler dependency install."),
    (f"{_W1} = 'docker'", 6, "docker", "Docker command."),
    (f"{_W1} IN ('bash', 'sh', 'powershell', 'pwsh', 'python', 'node')", 5, "script_execution", "Local script execution."),
    (f"{_TOOL} = 'mvn' AND {_TASK} = 'test'", 2, "test", "Test command."),
    (f"{_TOOL} IN ('gradle', 'gradlew') AND {_TASK} = 'test'", 2, "test", "Gradle test task command."),
    (f"{_W1} = 'cargo' AND {_W2} = 'test'", 2, "test", "Cargo test command."),
    (f"{_W1} = 'go' AND {_W2} = 'test'", 2, "test", "Go test command."),
    (f"{_W1} = 'rake' AND {_W2} = 'test'", 2, "test", "Rake test task command."),
    (f"{_W1} IN ('npm', 'pnpm', 'yarn') AND {_W2} = 'test'", 2, "test", "Package test script command."),
    (f"{_W1} = 'cargo' AND {_W2} = 'build'", 3, "build", "Cargo build command."),
    (f"{_W1} = 'go' AND {_W2} IN ('build', 'generate')", 3, "build", "Go build or generate command."),
    (f"{_W1} = 'rake' OR regexp_matches(lower(unit), '^bundle exec rake')", 3, "build", "Rake task command."),
    (f"{_W1} IN ('npm', 'pnpm', 'yarn') AND {_W2} IN ('start', 'build', 'run')", 3, "build", "Package script command."),
    (f"{_TOOL} IN ('mvn', 'gradle', 'gradlew')", 3, "build", "Maven or Gradle build command."),
    (f"{_W1} = 'make'", 3, "build", "Build command."),
    (f"{_W1} IN ('ls', 'dir', 'pwd')", 0, "safe_readonly", "Read-only shell command."),
    (f"{_W1} IN ('cat', 'type')", 0, "safe_readonly", "Read-only file command."),
    (f"{_W1} = 'git' AND {_W2} IN ('status', 'diff', 'log', 'show')", 0, "safe_readonly", "Read-only git command."),
]


def _case(column: int, default: str) -> str:
    def show(value):
        return str(value) if isinstance(value, int) else f"'{value}'"

    return "CASE " + " ".join(f"WHEN {r[0]} THEN {show(r[column])}" for r in _RULES) + f" ELSE {default} END"


define("scoped", f"""
  SELECT command_id, repo_id, command, arg_min(scope, place) AS scope,
         CASE WHEN max(n) > 1 THEN 'Composite command; riskiest segment `' || arg_min(unit, place) || '`: ' || arg_min(reason, place)
              ELSE arg_min(reason, place) END AS scope_reason
  FROM (SELECT *, {_case(1, '1')} * -1000 + seg_no AS place, {_case(2, "'unknown_shell'")} AS scope, {_case(3, "'Unknown shell command.'")} AS reason
        FROM (SELECT *, segment AS unit FROM segments))
  GROUP BY command_id, repo_id, command""")


@query("f18_classify_scope", "SELECT command_id, scope, scope_reason FROM scoped")
def f18(t: Tables):
    return t.commands.withColumn("c", SC.classify_scope(F.col("command"))).select(
        "command_id", F.col("c.scope").alias("scope"), F.col("c.reason").alias("scope_reason")
    )


@query("f19_build_tool_invocation", f"""
  SELECT command_id, CASE WHEN {_TOOL} = 'mvn' THEN 'maven' ELSE 'gradle' END AS kind, {_TASK} AS task,
         CASE WHEN {_TOOL} = 'mvn' THEN 'pom.xml' ELSE '' END AS maven_files, {_TOOL} = 'gradlew' AS uses_wrapper
  FROM (SELECT command_id, command AS unit FROM commands) WHERE {_TOOL} IN ('mvn', 'gradle', 'gradlew')""")
def f19(t: Tables):
    inv = SC.build_tool_invocation(WD.joined_words(F.col("command")))
    return t.commands.withColumn("i", inv).where("i.kind IS NOT NULL").select(
        "command_id", "i.kind", "i.task", F.array_join("i.maven_files", ",").alias("maven_files"), "i.uses_wrapper"
    )


@query("f20_rake_task", """
  SELECT command_id, regexp_extract(command, 'rake (\\S+)$', 1) AS task, ends_with(command, ' test') AS is_test
  FROM commands WHERE regexp_matches(command, '^(bundle exec )?rake')""")
def f20(t: Tables):
    task = SC.rake_task(F.lower(WD.joined_words(F.col("command"))))
    return t.commands.withColumn("task", task).where("task IS NOT NULL").select(
        "command_id", "task", SC.is_test_task(F.col("task")).alias("is_test")
    )


# What each planned command invokes, stated per command form: (form, kind, target, reason).
_SHELL, _UNKNOWN, _EXTERNAL = "command invokes local script", "SCRIPT_UNKNOWN_INTERPRETER", "SCRIPT_EXTERNAL_PACKAGE_EXECUTION"
_TARGETS = [
    ("npm run build", "script", "build", ""),
    ("npm test", "script", "test", ""),
    ("bash scripts/install.sh", "path", "scripts/install.sh", _SHELL),
    ("node setup.js", "path", "setup.js", "node command reaches local script"),
    ("python tools/run.py --job {u}", "path", "tools/run.py", "python command invokes local script"),
    ("go test ./...", None, None, None),
    ("cat README.md", "doubt", "cat README.md", _UNKNOWN),
    ("npx mcp-server --root /", "doubt", "Package manager may execute external package or tool: npx mcp-server --root /", _EXTERNAL),
    ("sh -c {q}node lib/util.js && bash scripts/step1.sh{q}", "nested", "node lib/util.js && bash scripts/step1.sh", ""),
    ("bash missing-{u}.sh", "path", "missing-{u}.sh", _SHELL),
    ("node server.js --workspace /", "path", "server.js", "node command reaches local script"),
    ("env MODE=ci bash scripts/step3.sh", "path", "scripts/step3.sh", _SHELL),
]


def _form(text: str) -> str:
    return "'" + text.replace("{q}", '"').replace("'", "''") + "'"


_ROWS = ", ".join(
    f"({COMMANDS.index(form)}, '{kind}', {_form(target)}, '{reason}')" for form, kind, target, reason in _TARGETS if kind
)


@query("f21_invocation_targets", f"""
  SELECT concat('c', event_id) AS command_id, 0 AS item, v.kind AS kind, replace(v.target, '{{u}}', CAST(user_id AS STRING)) AS target, v.reason AS reason
  FROM events e JOIN (VALUES {_ROWS}) v(form, kind, target, reason) ON v.form = mod(e.event_id, {len(COMMANDS)})""")
def f21(t: Tables):
    return numbered(t.commands, TG.invocation_targets(F.col("command")), "item", "x").select("command_id", "item", "x.*")


def _hit(rule: str, severity: str, condition: str) -> str:
    return f"SELECT DISTINCT command_id, '{rule}' AS rule_id, '{severity}' AS severity, '<command>' AS file, 0 AS line, command AS evidence FROM segments WHERE {condition}"


define("command_rows", " UNION ALL ".join([
    _hit("COMMAND_REMOTE_SHELL_PIPE", "CRITICAL", r"regexp_matches(segment, '(?i)\b(curl|wget)\b[^|]{0,800}\|\s*(sudo\s+)?(bash|sh)\b')"),
    _hit("COMMAND_POWERSHELL_ENCODED", "CRITICAL", r"regexp_matches(segment, '(?i)\b(powershell|pwsh)(\.exe)?\b') AND regexp_matches(segment, '(?i)\s-(encodedcommand|enc|e)\b')"),
    _hit("COMMAND_POWERSHELL_REMOTE_EXEC", "CRITICAL", r"regexp_matches(segment, '(?i)\b(powershell|pwsh)\b') AND regexp_matches(segment, '(?i)\b(iwr|irm|curl|wget)\b') AND regexp_matches(segment, '(?i)\b(iex|invoke-expression)\b')"),
    _hit("COMMAND_DOCKER_PRIVILEGED", "HIGH", r"regexp_matches(segment, '(?i)^\s*docker\s+run\b.*\s--privileged(\s|$)')"),
    _hit("COMMAND_DOCKER_HOST_ROOT_MOUNT", "HIGH", r"regexp_matches(segment, '(?i)^\s*docker\s+run\b') AND regexp_matches(segment, '(?i)\s(-v|--volume)(\s+|=)/:\S*(\s|$)')"),
    _hit("COMMAND_DOCKER_SOCKET_MOUNT", "HIGH", r"regexp_matches(segment, '(?i)^\s*docker\s+run\b') AND contains(segment, '/var/run/docker.sock')"),
    _hit("COMMAND_INLINE_INTERPRETER_EXEC", "MEDIUM", r"regexp_matches(segment, '(?i)^\s*(python|python3|node|ruby|perl)\b.*\s(-c|-e|--eval)\b')"),
    _hit("COMMAND_MCP_BROAD_STARTUP", "MEDIUM", r"regexp_matches(segment, '(?i)(--root|--workspace|--allow-fs)(=|\s+)/(\s|$)') AND (regexp_matches(segment, '(?i)^npx\s.*mcp') OR regexp_matches(segment, '(?i)^(node|python|python3)\s+\S*server'))"),
]))


@query("r17_scan_commands", "SELECT * FROM command_rows")
def r17(t: Tables):
    return C.scan_commands(t.commands.select("command_id", "command")).select(
        "command_id", "rule_id", "severity", "file", "line", "evidence"
    )


@query("j17_command_targets", """
  SELECT DISTINCT c.repo_id, c.command, f.path FROM commands c JOIN files f ON f.repo_id = c.repo_id
   AND f.path = CASE WHEN starts_with(c.command, 'mvn -f') THEN 'pom.xml'
                     WHEN regexp_matches(c.command, '^(bash|sh|python|node|powershell|pwsh)\\s') THEN regexp_extract(c.command, '^\\S+\\s+(\\S+)', 1) END""")
def j17(t: Tables):
    plans = C.distinct_plans(t.commands)
    found = C.command_targets(plans, t.files)
    return found.join(plans.select("plan_id", "command"), "plan_id").select("repo_id", "command", "path")


_URLS = """SELECT c_custkey, CASE mod(c_custkey, 8) WHEN 0 THEN concat('https://github.com/owner', CAST(c_custkey AS STRING), '/repo.git')
         WHEN 1 THEN concat('https://GitHub.com/Own-er/r_', CAST(c_custkey AS STRING), '/') WHEN 2 THEN 'https://github.com/a--b/c'
         WHEN 3 THEN concat('https://user@github.com/o/', CAST(c_custkey AS STRING)) WHEN 4 THEN concat('http://github.com/o/', CAST(c_custkey AS STRING))
         WHEN 5 THEN concat('https://github.com/o/', c_name) WHEN 6 THEN 'https://github.com/o/r/tree/main' ELSE 'https://github.com/o/name.' END AS url FROM customer"""


@query("p7_validate_repo_url", f"""
  SELECT c_custkey, CASE mod(c_custkey, 8) WHEN 0 THEN concat('https://github.com/owner', c_custkey, '/repo') WHEN 1 THEN concat('https://github.com/Own-er/r_', c_custkey) END AS canonical_url,
         CASE WHEN mod(c_custkey, 8) > 1 THEN 'MCP_REMOTE_URL_INVALID' END AS error_code FROM ({_URLS})""")
def p7(t: Tables):
    return t.sql(_URLS).withColumn("v", V.validate_repo_url(F.col("url"))).select(
        "c_custkey", "v.canonical_url", "v.error_code"
    )


_REFS = """SELECT o_orderkey, CASE mod(o_orderkey, 9) WHEN 0 THEN upper(concat(md5(CAST(o_orderkey AS STRING)), '0123abcd'))
         WHEN 1 THEN concat('refs/heads/f', CAST(o_orderkey AS STRING)) WHEN 2 THEN o_orderpriority WHEN 3 THEN 'head' WHEN 4 THEN 'a..b'
         WHEN 5 THEN 'x/.y' WHEN 6 THEN 'v1.lock' WHEN 7 THEN '-opt' ELSE concat('v1.', CAST(o_orderkey AS STRING)) END AS ref FROM orders"""


@query("p8_validate_ref", f"""
  SELECT o_orderkey, CASE WHEN mod(o_orderkey, 9) = 0 THEN lower(ref) WHEN mod(o_orderkey, 9) IN (1, 8) OR (mod(o_orderkey, 9) = 2 AND NOT contains(ref, ' ')) THEN ref END AS ref,
         CASE WHEN NOT (mod(o_orderkey, 9) IN (0, 1, 8) OR (mod(o_orderkey, 9) = 2 AND NOT contains(ref, ' '))) THEN 'MCP_REMOTE_REF_INVALID' END AS error_code FROM ({_REFS})""")
def p8(t: Tables):
    return t.sql(_REFS).withColumn("v", V.validate_ref(F.col("ref"))).select("o_orderkey", "v.ref", "v.error_code")


@query("p9_validate_clone_url", """
  SELECT page_id, CASE WHEN starts_with(url, 'https:') THEN url END AS url, CASE WHEN NOT starts_with(url, 'https:') THEN 'UNSUPPORTED_CLONE_URL' END AS error_code FROM pages""")
def p9(t: Tables):
    return t.given("pages").withColumn("v", V.validate_clone_url(F.concat(F.lit(" "), "url"))).select(
        "page_id", "v.url", "v.error_code"
    )


_PLACES = """SELECT page_id, CASE mod(page_id, 6) WHEN 0 THEN url WHEN 1 THEN concat('C:/reports/', CAST(page_id AS STRING))
         WHEN 2 THEN concat('git@host:', CAST(page_id AS STRING)) WHEN 3 THEN 'git clone x' WHEN 4 THEN concat('//share/', CAST(page_id AS STRING))
         ELSE concat('reports/', CAST(page_id AS STRING), '.json') END AS place FROM pages"""


@query("p10_classify_location", f"""
  SELECT page_id, CASE WHEN mod(page_id, 6) IN (1, 5) THEN 'local' ELSE 'remote' END AS location FROM ({_PLACES})""")
def p10(t: Tables):
    return t.sql(_PLACES).select("page_id", V.classify_location(F.col("place")).alias("location"))


@query("p11_validate_tree_path", """
  SELECT path, CASE WHEN starts_with(path, '../') OR contains(path, '/aux/') OR ends_with(path, ' ') THEN 'MCP_REMOTE_TREE_UNSAFE' END AS error_code, count(*) AS n
  FROM manifest GROUP BY path""")
def p11(t: Tables):
    rows = t.manifest.groupBy("path").agg(F.count("*").alias("n"))
    return rows.select("path", V.validate_tree_path(F.col("path")).alias("error_code"), "n")


@query("p12_entry_kind", """
  SELECT kind, count(*) AS n FROM (SELECT CASE WHEN mode = '160000' THEN 'submodule' WHEN mode = '120000' THEN 'symlink'
    WHEN starts_with(head, 'version https://git-lfs') THEN 'lfs_pointer' ELSE 'regular' END AS kind FROM manifest) GROUP BY kind""")
def p12(t: Tables):
    kind = V.entry_kind(F.col("mode"), F.col("object_type"), F.col("head"))
    return t.manifest.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query("p13_bounded_field", """
  SELECT doc_id, octet_length(encode(text)) BETWEEN 1 AND 4096 AND NOT regexp_matches(text, '[\\x00-\\x1f\\x7f-\\x{9f}]') AS bounded FROM documents""")
def p13(t: Tables):
    return t.given("documents").select("doc_id", V.bounded_field(F.col("text"), 4096).alias("bounded"))
