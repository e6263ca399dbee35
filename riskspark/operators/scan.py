"""The rule scan.

The catalogue compiles into one projection per file: an array with one guarded entry per rule,
exploded and filtered. Each text is read once, on the task that loaded it; only the findings
(number, line, evidence) leave that projection, and report texts are joined to them afterwards
from a table of fixed size.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark.catalogue import rules as R
from riskspark.catalogue.files import COMPOSE_NAMES
from riskspark.functions.paths import basename, strip, suffix
from riskspark.functions.regex import jre
from riskspark.functions.rows import exploded
from riskspark.functions.text import (
    line_number,
    mask_gradle,
    mask_strings,
    redact,
    split_lines,
    strip_comment,
    truncate_evidence,
)
from riskspark.functions.toml import toml_strings

KEYS = ["repo_id", "snapshot_id", "path"]
HIT = "struct<no:int,ord:int,line:int,evidence:string>"
# Rows a user catalogue has: kind is literal, any_of, regex or pair.
USER_RULE_SCHEMA = (
    "rule_id string, severity string, kind string, needles array<string>, path_pattern string, title string, "
    "why_it_matters string, recommendation string"
)


class _File:
    """Columns every rule reads."""

    def __init__(self) -> None:
        self.path, self.text, self.low = F.col("path"), F.col("text"), F.col("lowered")
        self.name = basename(self.path)

    def line(self, needle: Column | str) -> Column:
        needle = F.lit(needle) if isinstance(needle, str) else needle
        return line_number(self.text, needle, self.low)

    def has(self, needle: str) -> Column:
        return F.contains(self.low, F.lit(needle))


def _any(conditions) -> Column:
    return reduce(or_, conditions)


def rule_applies(family: str, path: Column) -> Column:
    """P4. Paths a rule family reads."""
    name = basename(path)
    if family == "package_json":
        return name == "package.json"
    if family == "shell":
        return (
            path.rlike(r"^(?:scripts|bin|tools)/|^\.github/workflows/")
            | path.isin("Makefile", "Dockerfile")
            | path.endswith(".sh")
            | path.endswith(".ps1")
        )
    if family == "workflows":
        return path.startswith(".github/workflows/")
    if family == "mcp":
        return name.isin(".mcp.json", "mcp.json") | path.startswith(".mcp/")
    if family == "python_setup":
        return name == "setup.py"
    if family == "agent":
        return (
            name.isin("README.md", "AGENTS.md", "CLAUDE.md")
            | path.startswith(".cursor/rules")
            | (path == ".github/copilot-instructions.md")
        )
    if family == "readme":
        return name.isin(*R.DOC_NAMES) | (
            F.lower(suffix(path)).isin(*R.DOC_SUFFIXES) & path.rlike("^(?:docs|documentation)/")
        )
    if family == "docker":
        return (name == "Dockerfile") | name.isin(*COMPOSE_NAMES)
    if family == "rust_go":
        return (
            name.isin("Cargo.toml", "Cargo.lock", "build.rs", "go.mod")
            | (path == ".cargo/config.toml")
            | (suffix(path) == ".go")
        )
    if family == "ruby":
        return name.isin("Gemfile", "Gemfile.lock", "gems.locked", "Rakefile", "extconf.rb") | (
            suffix(path) == ".gemspec"
        )
    if family == "java":
        return name.isin("pom.xml", "gradle-wrapper.properties", *R.GRADLE_FILES, *R.GRADLE_INIT_FILES)
    if family == "secrets":
        return F.lit(True)
    raise KeyError(family)


def _entry(no: int, line: Column, evidence: Column, order: Column | None = None) -> Column:
    return F.struct(
        F.lit(no).cast("int").alias("no"),
        (F.lit(0) if order is None else order).cast("int").alias("ord"),
        line.cast("int").alias("line"),
        evidence.cast("string").alias("evidence"),
    )


def _when(condition: Column, no: int, line: Column, evidence: Column) -> Column:
    return F.array(F.when(condition, _entry(no, line, evidence)))


def _none() -> Column:
    return F.array().cast(f"array<{HIT}>")


def _pattern_hit(f: _File, gate: Column, no: int, pattern: str) -> Column:
    found = F.regexp_extract(f.text, pattern, 0)
    return _when(gate & f.text.rlike(pattern), no, f.line(found), truncate_evidence(found))


# ---- families -------------------------------------------------------------------------------


def _literals(f: _File, family: str, table) -> list[Column]:
    gate = rule_applies(family, f.path)
    hits = []
    for rule, needles in table:
        chain = None
        for needle in needles:
            entry = _entry(R.rule_number(rule), f.line(needle), F.lit(needle))
            chain = F.when(gate & f.has(needle), entry) if chain is None else chain.when(f.has(needle) & gate, entry)
        hits.append(F.array(chain))
    return hits


def _agent(f: _File) -> list[Column]:
    return _literals(f, "agent", R.AGENT_NEEDLES)


def _docker(f: _File) -> list[Column]:
    return _literals(f, "docker", R.DOCKER_NEEDLES)


def _workflows(f: _File) -> list[Column]:
    gate = rule_applies("workflows", f.path)
    hits = [_when(gate & f.has(n), R.rule_number(rule), f.line(n), F.lit(n)) for rule, n in R.WORKFLOW_NEEDLES]
    unpinned = gate & f.text.rlike(jre(R.UNPINNED_ACTION, "i"))
    return hits + [_when(unpinned, R.rule_number("GHA_UNPINNED_ACTION"), f.line("uses:"), F.lit("uses:"))]


def _mcp(f: _File) -> list[Column]:
    gate = rule_applies("mcp", f.path)
    return [
        _when(gate & _any(f.has(n) for n in needles), R.rule_number(rule), f.line(word), F.lit(word))
        for rule, needles, word in R.MCP_NEEDLES
    ]


def _shell(f: _File) -> list[Column]:
    gate = rule_applies("shell", f.path)
    return [_pattern_hit(f, gate, R.rule_number(rule), jre(p, "i")) for rule, p in R.SHELL_PATTERNS]


def _python_setup(f: _File) -> list[Column]:
    gate, no, chain = rule_applies("python_setup", f.path), R.rule_number("PYTHON_SETUP_REMOTE_FETCH"), None
    for raw in R.SETUP_FETCH_PATTERNS:
        pattern = jre(raw, "i")
        found = F.regexp_extract(f.text, pattern, 0)
        condition, entry = gate & f.text.rlike(pattern), _entry(no, f.line(found), truncate_evidence(found))
        chain = F.when(condition, entry) if chain is None else chain.when(condition, entry)
    return [F.array(chain)]


def _secrets(f: _File) -> list[Column]:
    """Inferred rules: the first match that is not a placeholder, never shown in clear."""
    placeholder = jre(R.SECRET_PLACEHOLDER, "i")
    hits = []
    for rule, raw in R.SECRET_PATTERNS:
        pattern = jre(raw)
        first = F.try_element_at(
            F.filter(F.regexp_extract_all(f.text, F.lit(f"({pattern})"), 1), lambda m: ~m.rlike(placeholder)), F.lit(1)
        )
        hits.append(
            _when(f.text.rlike(pattern) & first.isNotNull(), R.rule_number(rule), f.line(first), redact(first))
        )
    assignment = jre(R.SECRET_ASSIGNMENT, "im")
    value = F.try_element_at(
        F.filter(F.regexp_extract_all(f.text, F.lit(assignment), 1), lambda m: ~m.rlike(placeholder)), F.lit(1)
    )
    env = (f.name == ".env") & value.isNotNull()
    return hits + [_when(env, R.rule_number("SECRET_ENV_FILE"), f.line(value), redact(value))]


def _package_json(f: _File) -> list[Column]:
    """R5. Lifecycle scripts in document order; only string values count."""
    scripts = F.map_entries(F.from_json(f.text, "scripts MAP<STRING,VARIANT>").getField("scripts"))
    wanted = F.filter(
        scripts,
        lambda e: e.getField("key").isin(*R.LIFECYCLE_SCRIPTS)
        & (F.schema_of_variant(e.getField("value")) == "STRING"),
    )
    named = F.transform(
        wanted,
        lambda e, i: F.struct(
            i.alias("i"),
            e.getField("key").alias("name"),
            e.getField("value").cast("string").alias("value"),
            F.lower(e.getField("value").cast("string")).alias("low"),
        ),
    )

    def number(e: Column) -> Column:
        low, name = e.getField("low"), e.getField("name")
        remote = (F.contains(low, F.lit("curl")) & F.contains(low, F.lit("| bash"))) | (
            F.contains(low, F.lit("wget")) & F.contains(low, F.lit("| sh"))
        )
        high = _any(F.contains(low, F.lit(t)) for t in R.HIGH_RISK_SCRIPT_TEXT)
        chain = F.when(remote, F.lit(R.rule_number("NODE_LIFECYCLE_REMOTE_EXEC")))
        for script, rule in (
            ("postinstall", "NODE_POSTINSTALL_SCRIPT"),
            ("preinstall", "NODE_PREINSTALL_SCRIPT"),
            ("prepare", "NODE_PREPARE_SCRIPT"),
            (None, "NODE_LIFECYCLE_SCRIPT"),
        ):
            value = F.when(high, R.rule_number(rule, "HIGH")).otherwise(R.rule_number(rule, "MEDIUM"))
            chain = chain.otherwise(value) if script is None else chain.when(name == script, value)
        return chain

    hits = F.transform(
        named,
        lambda e: F.struct(
            number(e).cast("int").alias("no"),
            e.getField("i").alias("ord"),
            f.line(e.getField("name")).alias("line"),
            F.concat(e.getField("name"), F.lit(": "), e.getField("value")).alias("evidence"),
        ),
    )
    return [F.when(rule_applies("package_json", f.path), F.coalesce(hits, _none())).otherwise(_none())]


def _cargo(f: _File, strings: Column, config: Column) -> Column:
    """Findings of the names and values of a Cargo manifest or configuration."""

    def named(*path: str | Column) -> Column:
        parts = F.array(*[F.lit(p) if isinstance(p, str) else p for p in path])
        found = F.filter(strings, lambda s: s.getField("value").isNotNull() & (s.getField("path") == parts))
        return F.get(found, F.lit(0)).getField("value")

    below = lambda root: F.filter(strings, lambda s: F.get(s.getField("path"), F.lit(0)) == root)
    manifest = F.transform(
        F.filter(F.array(named("package", "build")), lambda b: b.isNotNull()),
        lambda b: _entry(
            R.rule_number("RUST_BUILD_SCRIPT"), f.line("build"), F.concat(F.lit('package.build = "'), b, F.lit('"'))
        ),
    )
    sources = F.filter(F.array_distinct(F.transform(below("source"), lambda s: F.get(s.getField("path"), F.lit(1)))), lambda n: n.isNotNull())
    replaced = F.transform(
        F.filter(
            F.transform(
                sources,
                lambda n: F.struct(
                    n.alias("name"),
                    F.coalesce(*[F.concat(F.lit(f"{key}="), named("source", n, key)) for key in R.CARGO_SOURCE_KEYS]).alias("found"),
                ),
            ),
            lambda s: s.getField("found").isNotNull(),
        ),
        lambda s, i: _entry(
            R.rule_number("RUST_CARGO_SOURCE_REPLACEMENT"), f.line(s.getField("found")),
            F.concat(F.lit("source."), s.getField("name"), F.lit(": "), s.getField("found")), i,
        ),
    )
    aliases = F.transform(
        F.filter(below("alias"), lambda s: s.getField("value").isNotNull() & (F.size(s.getField("path")) == 2)),
        lambda s, i: _entry(
            R.rule_number("RUST_CARGO_ALIAS"), f.line(F.get(s.getField("path"), F.lit(1))),
            F.concat(F.get(s.getField("path"), F.lit(1)), F.lit(": "), s.getField("value")), i,
        ),
    )
    return F.when(config, F.concat(replaced, aliases)).otherwise(manifest)


def _rust(f: _File) -> list[Column]:
    config = f.path == ".cargo/config.toml"
    strings = F.when(config | (f.name == "Cargo.toml"), toml_strings(f.text, R.CARGO_TABLES))
    script = _when(f.name == "build.rs", R.rule_number("RUST_BUILD_SCRIPT"), F.lit(1), F.lit("Rust build script file"))
    lock_line = F.try_element_at(
        F.filter(
            split_lines(f.text),
            lambda line: F.contains(line, F.lit("source =")) & F.contains(line, F.lit("git+")),
        ),
        F.lit(1),
    )
    lock = _when(
        (f.name == "Cargo.lock") & lock_line.isNotNull(), R.rule_number("RUST_CARGO_GIT_SOURCE"),
        f.line("git+"), truncate_evidence(strip(lock_line)),
    )
    # A malformed text has no strings and no findings.
    named = F.get(F.transform(F.array(strings), lambda s: F.coalesce(_cargo(f, s, config), _none())), F.lit(0))
    return [script, lock, named]


def module_replacements(text: Column) -> Column:
    """Go replace directives as ``array<struct<module, target>>``: single lines, then blocks."""

    def pairs(source: Column, pattern: str) -> Column:
        return F.transform(
            F.arrays_zip(
                F.regexp_extract_all(source, F.lit(pattern), 1).alias("m"),
                F.regexp_extract_all(source, F.lit(pattern), 2).alias("t"),
            ),
            lambda p: F.struct(strip(p.getField("m")).alias("module"), strip(p.getField("t")).alias("target")),
        )

    blocks = F.array_join(F.regexp_extract_all(text, F.lit(jre(R.GO_REPLACE_BLOCK, "ms")), 1), "\n")
    return F.concat(pairs(text, jre(R.GO_REPLACE_LINE, "m")), pairs(blocks, jre(R.GO_REPLACE_ENTRY, "m")))


def _go(f: _File) -> list[Column]:
    source = suffix(f.path) == ".go"
    replaced = F.transform(
        module_replacements(f.text),
        lambda p, i: F.struct(
            F.when(p.getField("target").rlike(R.GO_LOCAL_TARGET), R.rule_number("GO_LOCAL_MODULE_REPLACE"))
            .otherwise(R.rule_number("GO_MODULE_REPLACE")).cast("int").alias("no"),
            i.alias("ord"),
            f.line("replace").alias("line"),
            F.concat(p.getField("module"), F.lit(" => "), p.getField("target")).alias("evidence"),
        ),
    )
    directives = F.transform(
        F.transform(F.regexp_extract_all(f.text, F.lit(jre(R.GO_GENERATE, "m")), 0), strip),
        lambda m, i: _entry(R.rule_number("GO_GENERATE_DIRECTIVE"), f.line(m), truncate_evidence(m), i),
    )
    return [
        F.when(f.name == "go.mod", replaced).otherwise(_none()),
        F.when(source & f.has("go:generate"), directives).otherwise(_none()),
        _when(
            source & f.text.rlike(jre(R.GO_TESTMAIN, "m")), R.rule_number("GO_TESTMAIN"), f.line("TestMain"),
            F.lit("func TestMain("),
        ),
        _when(
            source & f.text.rlike(jre(R.GO_CGO, "m")), R.rule_number("GO_CGO_USAGE"), f.line('import "C"'),
            F.lit('import "C"'),
        ),
    ]


def active_line_array(text: Column) -> Column:
    """Numbered lines that hold more than a comment, comments removed."""
    numbered = F.transform(
        split_lines(text), lambda line, i: F.struct((i + 1).alias("no"), strip_comment(line).alias("code"))
    )
    return F.filter(numbered, lambda x: strip(x.getField("code")) != "")


def _ruby(f: _File) -> list[Column]:
    lines = active_line_array(f.text)

    def first(condition) -> Column:
        return F.try_element_at(F.filter(lines, condition), F.lit(1))

    def matching(pattern: str, block: str | None = None):
        def condition(x: Column) -> Column:
            code = x.getField("code")
            hit = mask_strings(code).rlike(jre(pattern))
            return hit if block is None else hit | mask_strings(code, keep_delimiters=True).rlike(jre(block))

        return condition

    def hit(gate: Column, rule: str, line: Column) -> Column:
        return _when(
            gate & line.isNotNull(), R.rule_number(rule), line.getField("no"),
            truncate_evidence(strip(line.getField("code"))),
        )

    gemfile, lock = f.name == "Gemfile", f.name.isin("Gemfile.lock", "gems.locked")
    spec, rake, native = suffix(f.path) == ".gemspec", f.name == "Rakefile", f.name == "extconf.rb"
    makefile = first(lambda x: F.contains(x.getField("code"), F.lit("create_makefile")))
    git, path = "RUBY_BUNDLER_GIT_SOURCE", "RUBY_BUNDLER_LOCAL_PATH_SOURCE"
    return [
        hit(gemfile, git, first(matching(R.RUBY_GIT, R.RUBY_GIT_BLOCK))),
        hit(gemfile, path, first(matching(R.RUBY_PATH, R.RUBY_PATH_BLOCK))),
        hit(lock, git, first(lambda x: strip(x.getField("code")) == "GIT")),
        hit(lock, path, first(lambda x: strip(x.getField("code")) == "PATH")),
        hit(spec, "RUBY_GEMSPEC_EXTENSION", first(matching(R.RUBY_EXTENSION))),
        hit(spec, "RUBY_INSTALL_HOOK", first(matching(R.RUBY_HOOK))),
        _when(
            native, R.rule_number("RUBY_NATIVE_EXTENSION"), F.coalesce(makefile.getField("no"), F.lit(1)),
            F.coalesce(truncate_evidence(strip(makefile.getField("code"))), F.lit("extconf.rb")),
        ),
        hit(rake, "RUBY_RAKE_COMMAND_EXEC", first(matching(R.RUBY_RAKE, R.RUBY_RAKE_BARE))),
    ]


# The corrupt-record field must be last: the reader fills it by position.
_PLUGINS = (
    "ARRAY<STRUCT<plugin: ARRAY<STRUCT<groupId: STRING, artifactId: STRING, "
    "executions: ARRAY<STRUCT<execution: ARRAY<STRUCT<id: STRING, goals: ARRAY<STRUCT<goal: ARRAY<STRING>>>>>>>>>>>"
)
POM_SCHEMA = (
    f"build ARRAY<STRUCT<plugins: {_PLUGINS}>>, "
    f"profiles ARRAY<STRUCT<profile: ARRAY<STRUCT<build: ARRAY<STRUCT<plugins: {_PLUGINS}>>>>>>, _corrupt STRING"
)


_NO_BUILDS = f"array<struct<plugins: {_PLUGINS}>>"


def _flat(values: Column) -> Column:
    return F.flatten(F.filter(values, lambda v: v.isNotNull()))


def _member(values: Column, field: str) -> Column:
    """Concatenate an array field over an array of structs, skipping absent ones."""
    return _flat(F.transform(values, lambda v: v.getField(field)))


def executed_plugin(text: Column) -> Column:
    """First Maven plugin with an execution, as ``struct<artifact, evidence>``; null when none.

    Malformed XML fills the corrupt field and yields nothing.
    """
    pom = F.from_xml(
        text, POM_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt", "ignoreNamespace": "true"}
    )
    nothing = F.array().cast(_NO_BUILDS)
    builds = F.concat(
        F.coalesce(pom.getField("build"), nothing),
        F.coalesce(_member(_member(pom.getField("profiles"), "profile"), "build"), nothing),
    )
    plugins = _member(_member(builds, "plugins"), "plugin")
    executed = F.filter(
        plugins,
        lambda p: F.size(F.try_element_at(p.getField("executions"), F.lit(1)).getField("execution")) > 0,
    )

    def describe(p: Column) -> Column:
        def text_or(field: str, default: str) -> Column:
            value = strip(p.getField(field))
            return F.when(value != "", value).otherwise(F.lit(default))

        goals = F.filter(
            F.transform(
                _member(_member(_member(p.getField("executions"), "execution"), "goals"), "goal"), strip
            ),
            lambda g: g != "",
        )
        name = F.concat(
            text_or("groupId", R.MAVEN_DEFAULT_GROUP), F.lit(":"), text_or("artifactId", R.MAVEN_UNKNOWN_ARTIFACT)
        )
        return F.struct(
            text_or("artifactId", R.MAVEN_UNKNOWN_ARTIFACT).alias("artifact"),
            F.when(F.size(goals) > 0, F.concat(name, F.lit(" goals="), F.array_join(goals, ","))).otherwise(name).alias(
                "evidence"
            ),
        )

    return F.when(pom.getField("_corrupt").isNull(), F.try_element_at(F.transform(executed, describe), F.lit(1)))


def plugin_repository(code: Column) -> Column:
    """Does masked Gradle code hold ``pluginManagement { repositories { <repository> } }``?

    Block tokens are folded left to right; the state holds the current depth and the depths at
    which the two enclosing blocks opened. Only blocks that close count.
    """
    tokens = F.regexp_extract_all(code, F.lit(f"({jre(R.GRADLE_BLOCKS)})"), 1)
    start = F.struct(
        F.lit(0).alias("depth"), F.lit(-1).alias("outer"), F.lit(-1).alias("inner"),
        F.lit(False).alias("hit"), F.lit(False).alias("pending"), F.lit(False).alias("found"),
    )

    def step(state: Column, token: Column) -> Column:
        depth, outer, inner = state.getField("depth"), state.getField("outer"), state.getField("inner")
        hit, pending, found = state.getField("hit"), state.getField("pending"), state.getField("found")
        opens, closes = token.endswith("{"), token == "}"
        after = F.when(opens, depth + 1).when(closes, depth - 1).otherwise(depth)
        enters_outer = token.startswith("pluginManagement") & (outer < 0)
        enters_inner = token.startswith("repositories") & (outer >= 0) & (inner < 0)
        repository = (inner >= 0) & ~token.startswith("repositories") & ~token.isin("{", "}")
        closes_inner, closes_outer = closes & (inner == after), closes & (outer == after)
        pending_now = pending | (closes_inner & hit)
        return F.struct(
            after.alias("depth"),
            F.when(enters_outer, depth).when(closes_outer, F.lit(-1)).otherwise(outer).alias("outer"),
            F.when(enters_inner, depth).when(closes_inner, F.lit(-1)).otherwise(inner).alias("inner"),
            F.when(closes_inner, F.lit(False)).otherwise(hit | repository).alias("hit"),
            F.when(closes_outer, F.lit(False)).otherwise(pending_now).alias("pending"),
            (found | (closes_outer & pending_now)).alias("found"),
        )

    return F.aggregate(tokens, start, step, lambda state: state.getField("found"))


def wrapper_integrity(text: Column) -> Column:
    """Reasons a Gradle wrapper needs review, joined; null when it is sound or names no URL."""
    lines = F.filter(
        F.transform(split_lines(text), strip), lambda line: ~line.rlike("^[#!]") & F.contains(line, F.lit("="))
    )

    def last(key: str) -> Column:
        matching = F.filter(lines, lambda line: strip(F.substring_index(line, "=", 1)) == key)
        return strip(F.regexp_replace(F.try_element_at(matching, F.lit(-1)), "^[^=]*=", ""))

    url, checksum = last("distributionUrl"), F.coalesce(last("distributionSha256Sum"), F.lit(""))
    insecure = ~F.lower(url).rlike(r"^https\\?://")
    unpinned = ~checksum.rlike(r"^[0-9a-fA-F]{64}\z")
    reasons = F.concat_ws(
        "; ",
        F.when(insecure, F.lit("distributionUrl is not HTTPS")),
        F.when(unpinned, F.lit("distributionSha256Sum is missing or invalid")),
    )
    return F.when((url != "") & (reasons != ""), reasons)


def _java(f: _File, role: Column | None = None) -> list[Column]:
    """``role`` marks files a command selects: maven, settings or init."""
    selected = (lambda name: F.lit(False)) if role is None else (lambda name: F.coalesce(role == name, F.lit(False)))
    pom = (f.name == "pom.xml") | selected("maven")
    gradle = ~pom & (f.name.isin(*R.GRADLE_FILES) | selected("settings"))
    settings = gradle & (f.name.isin(*R.GRADLE_SETTINGS_FILES) | selected("settings"))
    init = ~pom & ~gradle & (f.name.isin(*R.GRADLE_INIT_FILES) | selected("init"))
    wrapper = ~pom & ~gradle & ~init & (f.name == "gradle-wrapper.properties")
    plugin, code, reasons = executed_plugin(f.text), mask_gradle(f.text), wrapper_integrity(f.text)
    build_src = f.path.rlike("(?:^|/)buildSrc(?:/|$)")
    return [
        F.array(
            F.when(
                pom,
                F.element_at(
                    F.transform(
                        F.array(plugin),
                        lambda p: F.when(
                            p.isNotNull(),
                            _entry(
                                R.rule_number("JAVA_MAVEN_PLUGIN_EXECUTION"), f.line(p.getField("artifact")),
                                truncate_evidence(p.getField("evidence")),
                            ),
                        ),
                    ),
                    1,
                ),
            )
        ),
        F.when(
            gradle,
            F.flatten(
                F.transform(
                    F.array(code),
                    lambda c: F.array(
                        F.when(
                            settings & plugin_repository(c),
                            _entry(
                                R.rule_number("JAVA_GRADLE_PLUGIN_REPOSITORY"), f.line("pluginManagement"),
                                F.lit("pluginManagement repositories"),
                            ),
                        ),
                        F.when(
                            build_src | c.rlike(jre(R.GRADLE_INCLUDED_BUILD, "m")),
                            _entry(
                                R.rule_number("JAVA_GRADLE_BUILD_LOGIC"),
                                F.when(build_src, F.lit(1)).otherwise(f.line("includeBuild")),
                                F.when(build_src, F.lit("buildSrc build logic")).otherwise(F.lit("includeBuild(...)")),
                            ),
                        ),
                    ),
                )
            ),
        ).otherwise(_none()),
        _when(init, R.rule_number("JAVA_GRADLE_INIT_SCRIPT"), F.lit(1), truncate_evidence(f.path)),
        _when(
            wrapper & reasons.isNotNull(), R.rule_number("JAVA_GRADLE_WRAPPER_INTEGRITY"), f.line("distributionUrl"),
            reasons,
        ),
    ]


def _phrases(f: _File) -> list[Column]:
    """R15. First pair of phrases whose first occurrences are close together."""
    gate, no, chain = rule_applies("readme", f.path), R.rule_number("README_DEFEAT_SECURITY_WARNING"), None
    for first, second in R.WARNING_PHRASES:
        a, b = F.instr(f.low, first), F.instr(f.low, second)
        near = gate & (a > 0) & (b > 0) & (F.abs(a - b) <= R.PHRASE_DISTANCE)
        entry = _entry(no, f.line(first), F.lit(f"security warning bypass phrase: {first} ... {second}"))
        chain = F.when(near, entry) if chain is None else chain.when(near, entry)
    return [F.array(chain)]


_BUILDERS = {
    "package_json": _package_json,
    "shell": _shell,
    "secrets": _secrets,
    "workflows": _workflows,
    "mcp": _mcp,
    "python_setup": _python_setup,
    "agent": _agent,
    "phrases": _phrases,
    "docker": _docker,
    "rust": _rust,
    "go": _go,
    "ruby": _ruby,
    "java": _java,
}
ALL = tuple(_BUILDERS)


_COMPILED: dict[tuple, Column] = {}


def hits(families=ALL) -> Column:
    """Array of findings of the current row; needs columns path, text and lowered.

    The expression refers to columns by name only, so it is built once per application.
    """
    key = (SparkContext._active_spark_context.applicationId, tuple(families))
    if key not in _COMPILED:
        f = _File()
        _COMPILED[key] = F.concat(*[part for family in families for part in _BUILDERS[family](f)])
    return _COMPILED[key]


def with_lowered(files: DataFrame) -> DataFrame:
    return files.where(F.col("text").isNotNull()).withColumn("lowered", F.lower("text"))


def explode_hits(files: DataFrame, keys: list[str], array: Column) -> DataFrame:
    """One row per hit."""
    return exploded(files, array, "hit").select(*keys, "hit.*")


def describe(raw: DataFrame) -> DataFrame:
    """Join report texts to raw hits; the rule table has a fixed, small number of rows."""
    dim = R.file_rule_dim(raw.sparkSession)
    return raw.join(F.broadcast(dim), raw.no == dim.rule_no).select(
        "repo_id",
        "snapshot_id",
        "rule_ord",
        F.col("ord").alias("match_ord"),
        "rule_id",
        "severity",
        "title",
        F.col("path").alias("file"),
        "line",
        "evidence",
        "why_it_matters",
        "recommendation",
    )


def scan(files: DataFrame, families=ALL) -> DataFrame:
    return describe(explode_hits(with_lowered(files), KEYS, hits(families)))


def scan_literals(files: DataFrame) -> DataFrame:
    """R1."""
    return scan(files, ("agent", "docker"))


def scan_workflows(files: DataFrame) -> DataFrame:
    """R2."""
    return scan(files, ("workflows",))


def scan_any_of(files: DataFrame) -> DataFrame:
    """R3."""
    return scan(files, ("mcp",))


def scan_regex(files: DataFrame) -> DataFrame:
    """R4."""
    return scan(files, ("shell", "python_setup"))


def scan_json_scripts(files: DataFrame) -> DataFrame:
    """R5."""
    return scan(files, ("package_json",))


def scan_config_sections(files: DataFrame) -> DataFrame:
    """R6."""
    return scan(files, ("rust",))


def scan_module_replacements(files: DataFrame) -> DataFrame:
    """R7."""
    return scan(files.where(basename(F.col("path")) == "go.mod"), ("go",))


def scan_source_directives(files: DataFrame) -> DataFrame:
    """R8."""
    return scan(files.where(suffix(F.col("path")) == ".go"), ("go",))


def scan_masked_lines(files: DataFrame) -> DataFrame:
    """R9."""
    return scan(files, ("ruby",))


def scan_xml_plugins(files: DataFrame) -> DataFrame:
    """R10."""
    return scan(files.where(basename(F.col("path")) == "pom.xml"), ("java",))


def scan_properties(files: DataFrame) -> DataFrame:
    """R11."""
    return scan(files.where(basename(F.col("path")) == "gradle-wrapper.properties"), ("java",))


def scan_blocks(files: DataFrame) -> DataFrame:
    """R12."""
    return scan(files.where(basename(F.col("path")).isin(*R.GRADLE_FILES, *R.GRADLE_INIT_FILES)), ("java",))


def scan_phrase_pairs(files: DataFrame) -> DataFrame:
    """R15."""
    return scan(files, ("phrases",))


def scan_secrets(files: DataFrame) -> DataFrame:
    """R16."""
    return scan(files, ("secrets",))


def scan_command_aware(selected: DataFrame) -> DataFrame:
    """X3. Java rules for files a command selects; ``selected`` adds plan_id and role to files."""
    array = F.concat(*_java(_File(), F.col("role")))
    raw = explode_hits(with_lowered(selected), ["plan_id", *KEYS], array)
    dim = R.file_rule_dim(raw.sparkSession)
    return raw.join(F.broadcast(dim), raw.no == dim.rule_no).select(
        "plan_id", "rule_ord", F.col("ord").alias("match_ord"), "rule_id", "severity", "title",
        F.col("path").alias("file"), "line", "evidence", "why_it_matters", "recommendation",
    )


def scan_user_rules(files: DataFrame, catalogue: DataFrame) -> DataFrame:
    """X2. Rules given as rows (``USER_RULE_SCHEMA``), compiled like the built-in ones.

    A rule catalogue is code: every rule becomes an expression, however many there are. Needle lists that grow
    with data go to ``scan_needles``.
    """
    rules = catalogue.orderBy("rule_id", "kind").collect()
    f = _File()
    entries = []
    for i, rule in enumerate(rules):
        gate = F.lit(True) if rule.path_pattern is None else f.path.rlike(jre(rule.path_pattern))
        needles = [n.lower() for n in rule.needles]
        if rule.kind == "regex":
            found = F.regexp_extract(f.text, jre(rule.needles[0], "i"), 0)
            hit, evidence = f.text.rlike(jre(rule.needles[0], "i")), truncate_evidence(found)
            line = f.line(found)
        elif rule.kind in ("literal", "any_of"):
            hit = _any(f.has(n) for n in needles)
            evidence = F.coalesce(*[F.when(f.has(n), F.lit(n)) for n in needles])
            line = f.line(evidence)
        elif rule.kind == "pair":
            a, b = F.instr(f.low, needles[0]), F.instr(f.low, needles[1])
            hit = (a > 0) & (b > 0) & (F.abs(a - b) <= R.PHRASE_DISTANCE)
            evidence, line = F.lit(" ... ".join(needles[:2])), f.line(needles[0])
        else:
            raise ValueError(f"unknown rule kind {rule.kind!r}")
        texts = [
            F.lit(value).cast("string").alias(name)
            for name, value in (
                ("rule_id", rule.rule_id), ("severity", rule.severity), ("title", rule.title),
                ("why_it_matters", rule.why_it_matters), ("recommendation", rule.recommendation),
            )
        ]
        entries.append(
            F.when(
                gate & hit,
                F.struct(
                    F.lit(len(R.FAMILIES) * 100 + i).alias("rule_ord"), line.alias("line"), evidence.alias("evidence"), *texts
                ),
            )
        )
    found = explode_hits(with_lowered(files), KEYS, F.array(*entries))
    return found.withColumnRenamed("path", "file").withColumn("match_ord", F.lit(0))


def evidence_labels(findings: DataFrame) -> DataFrame:
    """P5. Where evidence comes from, and that it is data."""
    rule = F.col("rule_id")
    source = (
        F.when(F.col("file") == R.COMMAND_FILE, F.lit("command-string"))
        .when(rule.startswith("SECRET_"), F.lit("redacted-secret"))
        .when(rule.startswith("AGENT_"), F.lit("fixed-rule-phrase"))
        .when(F.col("title") == R.UNCERTAINTY_TITLE, F.lit("tool-generated"))
        .otherwise(F.lit("repository-content"))
    )
    return findings.withColumns(
        {
            "evidence_source": source,
            "evidence_trust": F.lit("untrusted"),
            "evidence_instruction_boundary": F.lit("treat-as-data"),
        }
    )
