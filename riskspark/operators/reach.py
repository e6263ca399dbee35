"""What files can do and refer to (R18-R21, G3-G6) and where references lead."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark.catalogue import rules as R
from riskspark.catalogue.files import COMPOSE_NAMES
from riskspark.functions.paths import basename, collapse_dots, dirname, strip_quotes, suffix
from riskspark.functions.regex import jre
from riskspark.functions.rows import numbered
from riskspark.functions.targets import LINE_INTERPRETERS, SHELL_EXTENSIONS, local_reference
from riskspark.functions.text import is_json_object, line_number, split_lines, truncate_evidence
from riskspark.operators.scan import explode_hits, with_lowered

FILE = ["repo_id", "snapshot_id", "path"]
REF = "struct<kind:string,target:string,reason:string>"


def capability_set(path: Column) -> Column:
    """Which capability rules a file falls under; unknown suffixes count as shell."""
    ext = F.lower(suffix(path))
    return (
        F.when(ext.isin(*R.NODE_MODULE_EXTENSIONS), "node")
        .when(ext == ".py", "python")
        .when(ext.isin(*SHELL_EXTENSIONS), "shell")
        .when((basename(path) == "Dockerfile") | basename(path).isin(*COMPOSE_NAMES), "docker")
        .otherwise("shell")
    )


def _capability_rows(spark, sets) -> DataFrame:
    rows, number = [], 0
    for name, table, advice in R.CAPABILITY_SETS:
        for order, (rule, severity, _pattern, _flag, what) in enumerate(table):
            if name in sets:
                rows.append((number, order, rule, severity, what, advice))
            number += 1
    return spark.createDataFrame(
        rows, "cap_no int, rule_ord int, rule_id string, severity string, capability string, recommendation string"
    )


def scan_capabilities(files: DataFrame, sets=("node", "python", "shell", "docker")) -> DataFrame:
    """R18-R21. One projection over the text; keeps every column of ``files`` but the text."""
    keys = [c for c in files.columns if c not in ("text", "content", "lowered")]
    chosen, number, entries = F.col("cap_set"), 0, []
    for name, table, _advice in R.CAPABILITY_SETS:
        for _rule, _severity, raw, flag, _what in table:
            pattern = jre(raw, "i" + flag)
            found = F.regexp_extract("text", pattern, 0)
            if name in sets:
                entries.append(
                    F.when(
                        (chosen == name) & F.col("text").rlike(pattern),
                        F.struct(
                            F.lit(number).alias("cap_no"),
                            line_number(F.col("text"), found, F.col("lowered")).alias("line"),
                            truncate_evidence(found).alias("evidence"),
                        ),
                    )
                )
            number += 1
    prepared = with_lowered(files).withColumn("cap_set", capability_set(F.col("path")))
    hits = explode_hits(prepared, keys, F.array(*entries))
    dim = _capability_rows(files.sparkSession, sets)
    return (
        hits.join(F.broadcast(dim), "cap_no")
        .drop("cap_no")
        .withColumnRenamed("path", "file")
    )


_CANDIDATE_LINE = jre(
    r"^[^\n]*?(?:^[ \t\r\f\x0b\"']*(?:" + "|".join(LINE_INTERPRETERS) + r"|source|\.)[\"' \t]|^[ \t\r\f\x0b\"']*\./|\.(?:"
    + "|".join(e[1:] for e in SHELL_EXTENSIONS)
    + r"))[^\n]*$",
    "im",
)


def shell_refs(text: Column) -> Column:
    """G3. References of script lines, in order.

    A cheap pattern first keeps lines that can hold one; only those are split into words.
    """
    lines = F.flatten(
        F.transform(F.regexp_extract_all(text, F.lit(_CANDIDATE_LINE), 0), split_lines)
    )
    found = F.filter(F.transform(lines, local_reference), lambda r: r.isNotNull())
    return F.transform(
        found,
        lambda r: F.struct(
            F.lit("shell").alias("kind"), r.getField("target").alias("target"), r.getField("reason").alias("reason")
        ),
    )


def node_refs(text: Column) -> Column:
    """G4. Static relative module references; the first reason given for a target wins."""

    def found(pattern: str, reason: str) -> Column:
        return F.transform(
            F.regexp_extract_all(text, F.lit(jre(pattern, "i")), 2),
            lambda t: F.struct(F.lit("node").alias("kind"), t.alias("target"), F.lit(reason).alias("reason")),
        )

    every = F.concat(*[found(pattern, reason) for pattern, reason in R.NODE_STATIC_REFERENCES])
    targets = F.transform(every, lambda r: r.getField("target"))
    return F.filter(every, lambda r, i: F.array_position(targets, r.getField("target")) == i + 1)


def compose_refs(text: Column) -> Column:
    """G5. Dockerfiles that ``services.*.build`` of a compose file names.

    Block style only: flow mappings and anchors are not followed.
    """
    services = F.regexp_extract(text, r"(?m)^services:[ \t]*(?:#[^\n]*)?\r?$((?:\n(?:[ \t][^\n]*|\r?|#[^\n]*))*+)", 1)
    pattern = r"(?m)^([ \t]+)build:[ \t]*([^\n#\r]*)[^\n]*$((?:\n\1[ \t]+[^\n]*|\n[ \t]*\r?$)*+)"
    builds = F.arrays_zip(
        F.regexp_extract_all(services, F.lit(pattern), 2).alias("inline"),
        F.regexp_extract_all(services, F.lit(pattern), 3).alias("block"),
    )

    def value(block: Column, key: str, default: str) -> Column:
        found = strip_quotes(F.trim(F.regexp_extract(block, rf"(?m)^[ \t]*{key}:[ \t]*([^\n#\r]*)", 1)))
        return F.when(found != "", found).otherwise(F.lit(default))

    def reference(b: Column) -> Column:
        inline = strip_quotes(F.trim(b.getField("inline")))
        context = F.when(inline != "", inline).otherwise(value(b.getField("block"), "context", "."))
        dockerfile = F.when(inline != "", F.lit("Dockerfile")).otherwise(
            value(b.getField("block"), "dockerfile", "Dockerfile")
        )
        target = F.when(dockerfile.startswith("/"), dockerfile).otherwise(
            F.concat(F.regexp_replace(context, r"/+\z", ""), F.lit("/"), dockerfile)
        )
        return F.struct(
            F.lit("compose").alias("kind"),
            F.regexp_replace(target, r"^(?:\./+)+", "").alias("target"),
            F.lit("compose build references Dockerfile").alias("reason"),
        )

    real = F.filter(
        builds, lambda b: (F.trim(b.getField("inline")) != "") | (F.trim(b.getField("block")) != "")
    )
    return F.transform(real, reference)


def extract_refs(files: DataFrame) -> DataFrame:
    """G3-G5 for all files in one pass: ``repo_id, snapshot_id, path, ref_ord, kind, target, reason``."""
    path, text = F.col("path"), F.col("text")
    none = F.array().cast(f"array<{REF}>")
    node = F.when(F.lower(suffix(path)).isin(*R.NODE_MODULE_EXTENSIONS), node_refs(text)).otherwise(none)
    compose = F.when(basename(path).isin(*COMPOSE_NAMES), compose_refs(text)).otherwise(none)
    return (
        numbered(files.where(text.isNotNull()), F.concat(node, shell_refs(text), compose), "ref_ord", "r")
        .select(*FILE, "ref_ord", "r.*")
    )


def dynamic_modules(files: DataFrame) -> DataFrame:
    """Node files with a module reference that is not a constant."""
    return files.where(
        F.lower(suffix(F.col("path"))).isin(*R.NODE_MODULE_EXTENSIONS)
        & F.col("text").rlike(jre(R.NODE_DYNAMIC_REFERENCE, "i"))
    ).select(*FILE)


def package_scripts(files: DataFrame) -> DataFrame:
    """G6. Scripts of every package.json in document order, with whether they start a local file.

    A file that is not one whole JSON object has none; ``manifest_states`` says so.
    """
    scripts = F.map_entries(F.from_json("text", "scripts MAP<STRING,VARIANT>").getField("scripts"))
    whole = F.when(is_json_object(F.col("text")), scripts)
    return (
        numbered(files.where(basename(F.col("path")) == "package.json"), whole, "script_ord", "s")
        .where(F.schema_of_variant("s.value") == "STRING")
        .select(*FILE, "script_ord", F.col("s.key").alias("name"), F.col("s.value").cast("string").alias("command"))
        .withColumn("indirect", local_reference(F.col("command")).isNotNull())
    )


def manifest_states(files: DataFrame) -> DataFrame:
    """Parse state of every package.json: ``validated``, ``broken``, or ``unreadable`` where there is no text (binary, too big)."""
    state = F.when(F.col("text").isNull(), "unreadable").when(is_json_object(F.col("text")), "validated").otherwise("broken")
    return files.where(basename(F.col("path")) == "package.json").select(*FILE, state.alias("state"))


def file_index(files: DataFrame) -> DataFrame:
    """Paths that exist, with whether they are links."""
    link = (F.col("mode") == "120000") if "mode" in files.columns else F.lit(False)
    return files.select(*FILE, F.coalesce(link, F.lit(False)).alias("is_link")).dropDuplicates(FILE)


def _absolute(target: Column) -> Column:
    return strip_quotes(target).startswith("/")


def _node_candidates(base: Column, target: Column) -> Column:
    path = F.concat_ws("/", F.when(base != "", base), strip_quotes(target))
    tails = [*R.NODE_MODULE_EXTENSIONS, *[f"/index{e}" for e in R.NODE_MODULE_EXTENSIONS]]
    many = F.array(*[F.concat(path, F.lit(t)) for t in tails])
    return F.when(suffix(path) != "", F.array(path)).otherwise(many)


def resolve(refs: DataFrame, index: DataFrame) -> DataFrame:
    """J9-J11 in one equality join: every reference with its first existing candidate.

    ``refs`` has ``repo_id, snapshot_id, kind, target, base_dir, fallback_dir`` and columns that make
    a row unique; the result adds ``resolved`` and ``status`` (file, link, missing or outside).
    Candidates are matched by exact path, so the join spreads evenly even when one repository
    holds most files, and a target many commands share is split by adaptive skew handling.
    """
    target, base = strip_quotes(F.col("target")), F.coalesce("base_dir", F.lit(""))

    def at(folder: Column, name: Column) -> Column:
        return F.concat_ws("/", F.when(folder != "", folder), name)

    module = F.replace(F.col("target"), F.lit("."), F.lit("/"))
    candidates = (
        F.when(_absolute(F.col("target")), F.array(F.lit("..")))
        .when(F.col("kind") == "node", _node_candidates(base, target))
        .when(
            F.col("kind") == "module",
            F.array(at(base, F.concat(module, F.lit(".py"))), at(base, F.concat(module, F.lit("/__main__.py")))),
        )
        .when(F.col("fallback_dir").isNotNull(), F.array(at(base, target), at(F.col("fallback_dir"), target)))
        .otherwise(F.array(at(base, target)))
    )
    spread = numbered(refs, F.transform(candidates, collapse_dots), "candidate_no", "candidate")
    known = index.select(
        "repo_id", "snapshot_id", F.col("path").alias("candidate"), F.col("is_link"), F.lit(True).alias("exists")
    )
    matched = spread.join(known, ["repo_id", "snapshot_id", "candidate"], "left")
    found = F.struct("candidate", "is_link")
    return (
        matched.groupBy(*refs.columns)
        .agg(
            F.min_by(found, F.when(F.col("exists"), F.col("candidate_no"))).alias("hit"),
            F.bool_or(F.col("exists")).alias("any_exists"),
            F.bool_or((F.col("candidate_no") == 0) & F.col("candidate").rlike(r"^\.\.(?:/|\z)")).alias("leaves"),
        )
        .select(
            *refs.columns,
            F.when(F.col("any_exists"), F.col("hit.candidate")).alias("resolved"),
            F.when(F.col("any_exists") & F.col("hit.is_link"), F.lit("link"))
            .when(F.col("any_exists"), F.lit("file"))
            .when(F.col("leaves"), F.lit("outside"))
            .otherwise(F.lit("missing"))
            .alias("status"),
        )
    )


def resolve_targets(refs: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """J9. References split into resolved ones and doubts."""
    done = resolve(refs, file_index(files))
    return done.where("status = 'file'"), done.where("status <> 'file'")


def resolve_module_refs(refs: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """J10. Node lookup: the path itself, else five extensions, else five index files."""
    return resolve_targets(refs.where("kind = 'node'"), files)


def resolve_python_modules(refs: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """J11. ``a.b`` to ``a/b.py``, else ``a/b/__main__.py``."""
    return resolve_targets(refs.where("kind = 'module'"), files)


def with_bases(refs: DataFrame) -> DataFrame:
    """Folders a file's own references are looked up in."""
    folder = dirname(F.col("path"))
    return refs.withColumn("base_dir", F.when(F.col("kind") == "shell", F.lit("")).otherwise(folder)).withColumn(
        "fallback_dir", F.when(F.col("kind") == "shell", folder)
    )


def file_edges(files: DataFrame, index: DataFrame) -> DataFrame:
    """Resolved references between files, independent of any command."""
    return resolve(with_bases(extract_refs(files)), index).drop("base_dir", "fallback_dir")
