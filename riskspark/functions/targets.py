"""What a command would run (F21): local paths, nested commands, scripts, modules, doubts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskspark.functions.paths import normalize_path, strip, strip_quotes, suffix
from riskspark.functions.regex import SEP
from riskspark.functions.words import lex_joined, lex_words

# Fixed values.
SHELL_EXTENSIONS = (".sh", ".bash", ".zsh", ".ps1", ".bat", ".cmd")
SCRIPT_EXTENSIONS = SHELL_EXTENSIONS + (".py", ".js", ".mjs", ".cjs", ".ts", ".tsx")
LINE_INTERPRETERS = ("bash", "sh", "python", "node", "powershell", "pwsh")
NODE_VALUE_FLAGS = ("--require", "-r", "--loader", "--import")
NODE_INLINE_FLAGS = ("-e", "--eval", "-p", "--print", "--check")

PATH, NESTED, SCRIPT, MODULE, DOUBT = "path", "nested", "script", "module", "doubt"
TARGET_TYPE = "array<struct<kind:string,target:string,reason:string>>"

_W = rf"[^{SEP}]*{SEP}"
_ENV = (
    rf"^(?:(?i:env){SEP}(?:(?:-i|-|--ignore-environment|--null|-0){SEP}|(?:-u|--unset){SEP}(?:{_W})?"
    rf"|-u[^{SEP}]+{SEP}|(?U:(?=_*[^_\W])\w+)=[^{SEP}]*{SEP})*+(?:--{SEP})?)++"
)
_PY = rf"^{_W}(?:-[WX]{SEP}{_W}|-(?![WXmc]{SEP}){_W})*+"
_NODE_VALUE = "(?:" + "|".join(NODE_VALUE_FLAGS) + ")"
_NODE_SKIP = (
    "-(?!" + "|".join(f"{flag[1:]}{SEP}" for flag in NODE_VALUE_FLAGS + NODE_INLINE_FLAGS) + f"|-require=){_W}"
)
_NODE_FLAGS = rf"(?:{_NODE_VALUE}{SEP}{_W}|--require={_W}|{_NODE_SKIP})*+"
_POWERSHELL = r"(?i:powershell|powershell\.exe|pwsh|pwsh\.exe)"


def is_windows_absolute(token: Column) -> Column:
    return strip_quotes(strip(token)).rlike(r"^[A-Za-z]:[\\/]")


def is_local_path(token: Column) -> Column:
    path = normalize_path(token)
    return (
        ~is_windows_absolute(token)
        & (path != "")
        & ~F.contains(path, F.lit("://"))
        & ~path.rlike("^[/~]")
        & (F.contains(path, F.lit("/")) | F.lower(suffix(path)).isin(*SCRIPT_EXTENSIONS))
    )


def _item(kind: str, target: Column, reason: str | Column) -> Column:
    reason = F.lit(reason) if isinstance(reason, str) else reason
    return F.struct(F.lit(kind).alias("kind"), target.alias("target"), reason.alias("reason"))


def _one(kind: str, target: Column, reason: str | Column) -> Column:
    return F.array(_item(kind, target, reason))


def _doubt(rule: str, detail: str | Column) -> Column:
    return _one(DOUBT, F.lit(detail) if isinstance(detail, str) else detail, rule)


def _parse_doubt(text: str | Column) -> Column:
    return _doubt("SCRIPT_PARSE_UNCERTAIN", text)


def _path(token: Column, reason: str) -> Column:
    return _one(PATH, normalize_path(token), reason)


def _get(joined: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(joined, pattern, group)


def _parsed(joined: Column) -> Column:
    nothing = F.array().cast(TARGET_TYPE)
    shown = F.translate(F.regexp_replace(joined, rf"{SEP}\z", ""), SEP, " ")
    first = _get(joined, rf"^([^{SEP}]*){SEP}")
    second = _get(joined, rf"^{_W}([^{SEP}]*){SEP}")
    third = _get(joined, rf"^{_W}{_W}([^{SEP}]*){SEP}")
    exe = F.lower(first)

    shell_inner = rf"^{_W}(?:(?!-c{SEP}){_W})*+-c{SEP}([^{SEP}]+){SEP}"
    shell_target = rf"^{_W}(?:(?!--{SEP})-{_W})*+(?:--{SEP})?([^{SEP}]+){SEP}"
    shell = (
        F.when(joined.rlike(shell_inner), _one(NESTED, _get(joined, shell_inner), ""))
        .when(joined.rlike(shell_target), _path(_get(joined, shell_target), "command invokes local script"))
        .otherwise(nothing)
    )

    python = (
        F.when(joined.rlike(rf"{_PY}-m{SEP}[^{SEP}]"), _one(MODULE, _get(joined, rf"{_PY}-m{SEP}([^{SEP}]+){SEP}"), ""))
        .when(joined.rlike(rf"{_PY}-m{SEP}\z"), _parse_doubt("Python -m flag is missing a module name."))
        .when(joined.rlike(rf"{_PY}-c{SEP}\z"), _parse_doubt("Python flag -c is missing inline code."))
        .when(
            joined.rlike(rf"{_PY}-[WX]{SEP}\z"),
            _parse_doubt(
                F.concat(F.lit("Python flag "), _get(joined, rf"{_PY}(-[WX]){SEP}\z"), F.lit(" is missing a value."))
            ),
        )
        .when(
            joined.rlike(rf"{_PY}[^-{SEP}]"),
            _path(_get(joined, rf"{_PY}([^-{SEP}][^{SEP}]*){SEP}"), "python command invokes local script"),
        )
        .otherwise(nothing)
    )

    flags = _get(joined, rf"^{_W}({_NODE_FLAGS})")
    preloads = F.regexp_extract_all(
        flags, F.lit(rf"\G(?:{_NODE_SKIP})*+(?:{_NODE_VALUE}{SEP}|--require=)([^{SEP}]*){SEP}"), 1
    )
    script = F.regexp_extract_all(joined, F.lit(rf"^{_W}{_NODE_FLAGS}([^-{SEP}][^{SEP}]*){SEP}"), 1)
    dangling = rf"^{_W}{_NODE_FLAGS}({_NODE_VALUE}){SEP}\z"
    node = F.concat(
        F.transform(
            F.concat(preloads, script),
            lambda t: _item(PATH, normalize_path(t), "node command reaches local script"),
        ),
        F.when(
            joined.rlike(dangling),
            _parse_doubt(F.concat(F.lit("Node flag "), _get(joined, dangling), F.lit(" is missing a value."))),
        ).otherwise(nothing),
    )

    ps_head = rf"^{_POWERSHELL}{SEP}(?:(?!(?i:-file|-f|-command|-c){SEP}){_W})*+"
    ps_file, ps_run = rf"{ps_head}(?i:-file|-f){SEP}", rf"{ps_head}(?i:-command|-c){SEP}"
    file_arg, run_arg = _get(joined, rf"{ps_file}([^{SEP}]*){SEP}"), _get(joined, rf"{ps_run}([^{SEP}]*){SEP}")
    windows_reason = "windows shell command reaches local script"
    cmd_head = rf"^(?i:cmd|cmd\.exe){SEP}(?:(?!(?i:/c|-c){SEP}){_W})*+(?i:/c|-c){SEP}"
    rest = F.regexp_replace(_get(joined, rf"(?s){cmd_head}(.*)\z"), rf"{SEP}\z", "")
    windows = (
        F.when(joined.rlike(rf"{ps_file}\z"), _parse_doubt("PowerShell -File flag is missing a target."))
        .when(
            joined.rlike(ps_file),
            F.when(is_windows_absolute(file_arg), _doubt("SCRIPT_TARGET_OUTSIDE_REPO", normalize_path(file_arg)))
            .otherwise(_path(file_arg, windows_reason)),
        )
        .when(joined.rlike(rf"{ps_run}\z"), _parse_doubt("PowerShell -Command flag is missing a command."))
        .when(
            joined.rlike(ps_run),
            F.when(is_windows_absolute(run_arg), _doubt("SCRIPT_TARGET_OUTSIDE_REPO", normalize_path(run_arg)))
            .when(is_local_path(run_arg), _path(run_arg, windows_reason))
            .otherwise(_one(NESTED, run_arg, "")),
        )
        .when(joined.rlike(rf"{cmd_head}\z"), _parse_doubt("cmd /c is missing a command."))
        .when(
            joined.rlike(cmd_head),
            F.when(
                ~F.contains(rest, F.lit(SEP)) & is_windows_absolute(rest),
                _doubt("SCRIPT_TARGET_OUTSIDE_REPO", normalize_path(rest)),
            ).otherwise(_one(NESTED, F.translate(rest, SEP, " "), "")),
        )
    )

    run_script = rf"^(?i:npm|pnpm|yarn|bun){SEP}(?i:run){SEP}([^{SEP}]*){SEP}"
    short_script = rf"^(?i:npm|pnpm|yarn){SEP}((?i:test|start|build)){SEP}"
    external = rf"^(?i:npx{SEP}|pnpm{SEP}exec{SEP}|yarn{SEP}dlx{SEP})"
    tool = F.when(exe.isin("pnpm", "yarn") & (third != ""), third).otherwise(second)
    task_doubt = "SCRIPT_TASK_RUNNER_UNRESOLVED"
    return (
        F.when(joined == "", nothing)
        .when(exe.isin("bash", "sh"), shell)
        .when(exe.isin("python", "python3"), python)
        .when(exe == "node", node)
        .when(joined.rlike(rf"{ps_file}|{ps_run}|{cmd_head}"), windows)
        .when(joined.rlike(run_script), _one(SCRIPT, _get(joined, run_script), ""))
        .when(joined.rlike(short_script), _one(SCRIPT, _get(joined, short_script), ""))
        .when(
            joined.rlike(external),
            F.when(is_local_path(tool), _path(tool, "package manager executes local tool")).otherwise(
                _doubt(
                    "SCRIPT_EXTERNAL_PACKAGE_EXECUTION",
                    F.concat(F.lit("Package manager may execute external package or tool: "), shown),
                )
            ),
        )
        .when(joined.rlike(rf"^(?i:deno{SEP}run){SEP}[^{SEP}]"), _path(third, "deno run reaches local script"))
        .when(
            joined.rlike(rf"^(?i:deno{SEP}task){SEP}[^{SEP}]"),
            _doubt(task_doubt, F.concat(F.lit("Deno task was not statically resolved: "), shown)),
        )
        .when((exe == "bun") & is_local_path(second), _path(second, "bun command reaches local script"))
        .when(
            exe.isin("just", "task"),
            _doubt(task_doubt, F.concat(F.lit("Task runner command was not statically resolved: "), shown)),
        )
        .when(exe.isin("source", ".") & (second != ""), _path(second, "shell source indirection"))
        .when(is_local_path(first), _path(first, "command invokes local script"))
        .otherwise(nothing)
    )


def invocation_targets(command: Column) -> Column:
    """Targets of one command, in order, as ``array<struct<kind, target, reason>>``.

    For a ``doubt`` the reason is the rule identifier and the target its detail. A command with
    neither targets nor doubts may still be doubtful: dynamic text, or an unknown interpreter
    given something that looks like a path.
    """
    # One-element arrays keep each stage computed once per row.
    joined = F.array(F.regexp_replace(lex_joined(command), _ENV, ""))
    parsed = F.transform(joined, _parsed)
    words = lex_words(command, drop_empty=False)
    argument = F.try_element_at(words, F.lit(2))
    dynamic = F.contains(command, F.lit("$(")) | F.contains(command, F.lit("`")) | F.contains(command, F.lit("${"))
    pathlike = (
        argument.isNotNull()
        & ~F.contains(argument, F.lit("://"))
        & (argument.rlike(r"[/\\]") | (suffix(argument) != ""))
    )
    fallback = (
        F.when(dynamic, _doubt("SCRIPT_DYNAMIC_COMMAND_CONSTRUCTION", command))
        .when(F.coalesce(pathlike, F.lit(False)), _doubt("SCRIPT_UNKNOWN_INTERPRETER", command))
        .otherwise(F.array().cast(TARGET_TYPE))
    )
    return F.element_at(F.transform(parsed, lambda p: F.when(F.size(p) > 0, p).otherwise(fallback)), 1)


def local_reference(line: Column) -> Column:
    """Local script a single script line starts, as ``struct<target, reason>``, or null."""
    words = F.array(lex_words(line, drop_empty=False))
    picked = F.transform(words, lambda w: _line_reference(w))
    return F.element_at(picked, 1)


def _line_reference(words: Column) -> Column:
    first, second = F.try_element_at(words, F.lit(1)), F.try_element_at(words, F.lit(2))
    low = F.lower(first)

    def found(target: Column, reason: str) -> Column:
        return F.struct(target.alias("target"), F.lit(reason).alias("reason"))

    return (
        F.when(low.isin(*LINE_INTERPRETERS) & second.isNotNull(), found(second, "command invokes local script"))
        .when(low.isin("source", ".") & second.isNotNull(), found(second, "shell source indirection"))
        .when(
            first.startswith("./") | suffix(first).isin(*SHELL_EXTENSIONS),
            found(first, "command invokes local script"),
        )
    )
