"""Command scopes and build-tool invocations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskspark.functions.paths import strip
from riskspark.functions.regex import SEP, any_word
from riskspark.functions.words import joined_words, split_segments

# Scopes in rising order of risk.
SCOPES = (
    "safe_readonly",
    "unknown_shell",
    "test",
    "build",
    "mcp_server_start",
    "script_execution",
    "docker",
    "dependency_install",
    "network_shell",
)

# Options of Maven and Gradle that take the next word as their value.
MAVEN_VALUE_OPTIONS = (
    "-f", "--file", "-s", "--settings", "-gs", "--global-settings", "-t", "--toolchains",
    "-P", "--activate-profiles", "-T", "--threads", "-pl", "--projects", "-rf", "--resume-from",
)
GRADLE_VALUE_OPTIONS = (
    "-p", "--project-dir", "-c", "--settings-file", "-I", "--init-script", "-g", "--gradle-user-home",
    "--project-cache-dir", "--include-build", "--max-workers", "--priority", "--warning-mode", "--console",
    "--configuration-cache-problems", "--dependency-verification", "--write-verification-metadata",
)

_MAVEN = rf"^(?:[^{SEP}]*[/\\])?(?i:mvn|mvnw|mvnw\.cmd){SEP}"
_GRADLE = rf"^(?:[^{SEP}]*[/\\])?(?i:gradle|gradlew|gradlew\.bat){SEP}"
_WRAPPER = rf"^(?:[^{SEP}]*[/\\])?(?i:gradlew|gradlew\.bat){SEP}"


def _first_task(joined: Column, value_options, default: str) -> Column:
    skip = (
        rf"^[^{SEP}]*{SEP}(?:(?:{any_word(value_options)}){SEP}(?:[^{SEP}]*{SEP})?"
        rf"|(?!--{SEP})-[^{SEP}]*{SEP})*+(?:--{SEP})?([^{SEP}]*){SEP}"
    )
    return F.when(joined.rlike(skip), F.regexp_extract(joined, skip, 1)).otherwise(F.lit(default))


def _option_values(joined: Column, names) -> Column:
    pattern = rf"(?<={SEP})(?:{any_word(names)})(?:=|{SEP})([^{SEP}]*)(?={SEP})"
    return F.filter(F.regexp_extract_all(joined, F.lit(pattern), 1), lambda v: v != "")


def build_tool_invocation(joined: Column) -> Column:
    """Maven or Gradle invocation in a separator-terminated word list; ``kind`` is null for others."""
    maven, gradle = joined.rlike(_MAVEN), joined.rlike(_GRADLE)
    nothing = F.array().cast("array<string>")
    return F.struct(
        F.when(maven, F.lit("maven")).when(gradle, F.lit("gradle")).alias("kind"),
        F.lower(
            F.when(maven, _first_task(joined, MAVEN_VALUE_OPTIONS, "package")).when(
                gradle, _first_task(joined, GRADLE_VALUE_OPTIONS, "build")
            )
        ).alias("task"),
        F.when(maven, _option_values(joined, ("-f", "--file"))).otherwise(nothing).alias("maven_files"),
        F.when(gradle, _option_values(joined, ("-I", "--init-script"))).otherwise(nothing).alias("init_scripts"),
        F.when(gradle, _option_values(joined, ("-c", "--settings-file"))).otherwise(nothing).alias("settings_files"),
        F.when(gradle, F.try_element_at(_option_values(joined, ("-p", "--project-dir")), F.lit(-1))).alias(
            "project_dir"
        ),
        F.coalesce(joined.rlike(_WRAPPER), F.lit(False)).alias("uses_wrapper"),
        F.regexp_extract(joined, rf"^([^{SEP}]*){SEP}", 1).alias("executable"),
    )


def rake_task(lowered: Column) -> Column:
    """Task of a ``rake`` or ``bundle exec rake`` command; null for other commands."""
    pattern = rf"^(?:rake|(?:bundle|bundler){SEP}exec{SEP}rake){SEP}(?:([^{SEP}]*){SEP})?"
    task = F.regexp_extract(lowered, pattern, 1)
    more = lowered.rlike(rf"^(?:rake|(?:bundle|bundler){SEP}exec{SEP}rake){SEP}[^{SEP}]*{SEP}")
    return F.when(lowered.rlike(pattern), F.when(more, task).otherwise(F.lit("default")))


def is_test_task(task: Column) -> Column:
    return task.rlike(r"(?:^|[:/])(?:spec|test|tests)(?:[:/]|\z)")


def is_gradle_test_task(task: Column) -> Column:
    return task.rlike(r"(?:^|[:/])(?:check|tests|[^:/]*test)(?:[:/]|\z)")


def _starts(lowered: Column, first: str, second: str | None = None) -> Column:
    tail = SEP if second is None else rf"{SEP}(?:{second}){SEP}"
    return lowered.rlike(rf"^(?:{first}){tail}")


def _single_scope(command: Column, words: Column, joined: Column) -> Column:
    """Scope and reason of one command; rules in order, first match wins."""
    low_text = F.lower(strip(command))
    invocation = build_tool_invocation(joined)
    kind, task = invocation.getField("kind"), invocation.getField("task")
    rake = rake_task(words)
    managers = "npm|pnpm|yarn"
    rules = [
        (low_text == "", "unknown_shell", "Empty command."),
        (
            low_text.rlike("curl |wget ") & low_text.rlike(r"\| bash|\| sh"),
            "network_shell",
            "Remote shell pipeline.",
        ),
        (
            F.contains(low_text, F.lit("mcp")) | F.contains(low_text, F.lit("modelcontextprotocol")),
            "mcp_server_start",
            "MCP server startup.",
        ),
        (_starts(words, managers, "install|ci|add"), "dependency_install", "Node dependency install."),
        (_starts(words, "pip", "install"), "dependency_install", "Python dependency install."),
        (_starts(words, "poetry", "install"), "dependency_install", "Poetry dependency install."),
        (_starts(words, "uv", "sync|pip"), "dependency_install", "uv dependency install."),
        (_starts(words, "bundle|bundler", "install"), "dependency_install", "Bundler dependency install."),
        (_starts(words, "docker"), "docker", "Docker command."),
        (
            _starts(words, "bash|sh|powershell|pwsh|python|node"),
            "script_execution",
            "Local script execution.",
        ),
        (_starts(words, "pytest") | ((kind == "maven") & (task == "test")), "test", "Test command."),
        ((kind == "gradle") & is_gradle_test_task(task), "test", "Gradle test task command."),
        (_starts(words, "cargo", "test"), "test", "Cargo test command."),
        (_starts(words, "go", "test"), "test", "Go test command."),
        (is_test_task(rake), "test", "Rake test task command."),
        (_starts(words, managers, "test"), "test", "Package test script command."),
        (_starts(words, "cargo", "build"), "build", "Cargo build command."),
        (_starts(words, "go", "build|generate"), "build", "Go build or generate command."),
        (rake.isNotNull() & (rake != ""), "build", "Rake task command."),
        (_starts(words, managers, "start|build|run"), "build", "Package script command."),
        (kind.isNotNull(), "build", "Maven or Gradle build command."),
        (_starts(words, "make"), "build", "Build command."),
        (_starts(words, "ls|dir|pwd"), "safe_readonly", "Read-only shell command."),
        (_starts(words, "cat|type"), "safe_readonly", "Read-only file command."),
        (_starts(words, "git", "status|diff|log|show"), "safe_readonly", "Read-only git command."),
    ]
    mcp_first = _starts(words, "npx|node|python")
    chain = None
    for condition, scope, reason in rules:
        if scope == "mcp_server_start":
            condition = condition & mcp_first
        value = F.struct(
            F.lit(SCOPES.index(scope)).alias("risk"), F.lit(scope).alias("scope"), F.lit(reason).alias("reason")
        )
        chain = F.when(condition, value) if chain is None else chain.when(condition, value)
    return chain.otherwise(
        F.struct(
            F.lit(SCOPES.index("unknown_shell")).alias("risk"),
            F.lit("unknown_shell").alias("scope"),
            F.lit("Unknown shell command.").alias("reason"),
        )
    )


def classify_scope(command: Column) -> Column:
    """Scope of a command; a composite takes its riskiest segment, the first one on ties."""
    segments = split_segments(command)
    many = F.size(segments) > 1
    units = F.when(many, segments).otherwise(F.array(command))
    worded = F.transform(units, lambda s: F.struct(s.alias("raw"), joined_words(s).alias("joined")))
    lowered = F.transform(
        worded,
        lambda w: F.struct(
            w.getField("raw").alias("raw"),
            w.getField("joined").alias("joined"),
            F.lower(w.getField("joined")).alias("words"),
        ),
    )
    scoped = F.transform(
        lowered,
        lambda w, i: F.struct(
            _single_scope(w.getField("raw"), w.getField("words"), w.getField("joined")).alias("s"),
            w.getField("raw").alias("raw"),
            i.alias("i"),
        ),
    )
    ranked = F.transform(
        scoped,
        lambda x: F.struct(
            x.getField("s").getField("risk").alias("risk"),
            (-x.getField("i")).alias("earliness"),
            x.getField("s").getField("scope").alias("scope"),
            x.getField("s").getField("reason").alias("reason"),
            x.getField("raw").alias("raw"),
        ),
    )
    # One-element array so that the winning segment is computed once and then read twice.
    best = F.transform(F.array(F.array_max(ranked)), lambda b: F.struct(
        b.getField("scope").alias("scope"),
        F.when(
            many,
            F.concat(
                F.lit("Composite command; riskiest segment `"), b.getField("raw"), F.lit("`: "), b.getField("reason")
            ),
        ).otherwise(b.getField("reason")).alias("reason"),
    ))
    return F.element_at(best, 1)
