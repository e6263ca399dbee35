"""File selection, decoding, fingerprints and snapshot limits."""

from __future__ import annotations

import hashlib
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark.catalogue import files as C
from riskspark.functions import validate as V
from riskspark.functions.hashing import content_digest
from riskspark.functions.rows import exploded
from riskspark.functions.paths import basename, collision_key, dirname, suffix

SNAPSHOT = ["repo_id", "snapshot_id"]


def _any(conditions) -> Column:
    return reduce(or_, conditions)


def is_critical(path: Column) -> Column:
    slashed = F.translate(path, "\\", "/")
    document = _any(slashed.startswith(p) for p in C.DOCUMENT_PREFIXES) & _any(
        F.lower(slashed).endswith(s) for s in C.DOCUMENT_SUFFIXES
    )
    return (
        basename(slashed).isin(*C.CRITICAL_BASENAMES)
        | slashed.isin(*C.ROOT_DOCUMENTS)
        | document
        | _any(slashed.endswith(s) for s in C.CRITICAL_SUFFIXES)
        | _any(slashed.startswith(p) for p in C.CRITICAL_PREFIXES)
    )


def in_skipped_dir(path: Column, dirs=C.SKIP_DIRS) -> Column:
    folder = F.split(dirname(path), "/")
    return F.arrays_overlap(folder, F.array(*[F.lit(d) for d in dirs]))


def critical_files(files: DataFrame) -> DataFrame:
    """P1. Reads only the path, so the filter runs before any content is touched."""
    return files.where(is_critical(F.col("path")))


def exclude_skipped_dirs(files: DataFrame, dirs=C.SKIP_DIRS) -> DataFrame:
    """P2."""
    return files.where(~in_skipped_dir(F.col("path"), dirs))


def exclude_marked_dirs(files: DataFrame, marker: str = C.FIXTURE_MARKER, index: DataFrame | None = None) -> DataFrame:
    """P3. Drop subtrees whose directory holds ``marker``; one at the root does not count.

    ``index``: the full listing the markers are looked for in, where ``files`` is a part of it. Excluded paths are
    found by an equality join over (snapshot, ancestor directory) that carries no content.
    """
    marked = (
        (files if index is None else index)
        .where((basename(F.col("path")) == marker) & (dirname(F.col("path")) != ""))
        .select(*SNAPSHOT, dirname(F.col("path")).alias("marked_dir"))
        .distinct()
    )
    parents = F.split(dirname(F.col("path")), "/")
    prefixes = F.transform(
        F.sequence(F.lit(1), F.size(parents)), lambda n: F.array_join(F.slice(parents, F.lit(1), n), "/")
    )

    def same(left: str, right: str, keys: list[str]) -> Column:
        return reduce(lambda x, y: x & y, [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys])

    inside = exploded(files.select(*SNAPSHOT, "path"), prefixes, "marked_dir").alias("i")
    excluded = inside.join(marked.alias("m"), same("i", "m", [*SNAPSHOT, "marked_dir"]), "left_semi")
    excluded = excluded.select(*SNAPSHOT, "path").distinct().alias("x")
    return files.alias("f").join(excluded, same("f", "x", [*SNAPSHOT, "path"]), "left_anti")


def bounded_text(files: DataFrame, max_bytes: int = C.MAX_TEXT_BYTES) -> DataFrame:
    """S2. Decode content to text, or say why not; oversized content is never decoded."""
    content = F.col("content")
    head = F.substring(content, 1, C.NUL_PROBE_BYTES)
    reason = (
        F.when(F.col("size_bytes") > max_bytes, F.lit("oversized"))
        .when(F.contains(head, F.lit(bytearray(b"\x00"))), F.lit("binary"))
    )
    return files.withColumn("skip_reason", reason).withColumn(
        "text", F.when(F.col("skip_reason").isNull(), F.make_valid_utf8(content.cast("string")))
    )


def language_of(path: Column) -> Column:
    """P15."""
    ext, name = F.lower(suffix(path)), basename(path)
    return (
        F.when(ext.isin(".js", ".mjs", ".cjs", ".ts", ".tsx"), "nodejs")
        .when(ext == ".go", "go")
        .when(name.isin("Cargo.toml", "Cargo.lock", "build.rs") | (path == ".cargo/config.toml"), "rust")
        .when(name.isin("Gemfile", "Gemfile.lock", "gems.locked", "Rakefile", "extconf.rb"), "ruby")
        .when(suffix(path) == ".gemspec", "ruby")
        .when((name == "pom.xml") | name.endswith(".gradle") | name.endswith(".gradle.kts"), "java-kotlin")
        .when(name.isin("gradlew", "gradlew.bat", "gradle-wrapper.properties"), "java-kotlin")
        .when(ext == ".py", "python")
        .when(ext.isin(".sh", ".bash", ".zsh", ".ps1", ".bat", ".cmd"), "shell")
        .when((name == "Dockerfile") | name.isin(*C.COMPOSE_NAMES), "docker")
    )


def order_files(files: DataFrame) -> DataFrame:
    """K1. Global path order: a range partition and a sort per range."""
    return files.orderBy(*SNAPSHOT, "path")


def union_files(*frames: DataFrame) -> DataFrame:
    """U2. Set union of file listings."""
    return reduce(DataFrame.unionByName, frames).dropDuplicates()


def _running_digests(rows):
    """SHA-256 of the lines of each snapshot, which arrive together and in order; one hash at a time is held.

    The lines of a snapshot in a batch are joined and hashed in one step.
    """
    names = [*SNAPSHOT, "fingerprint"]
    key, digest, first = None, None, True
    for batch in rows:
        out, n = [], batch.num_rows
        if not n:
            continue
        # Where the snapshot changes between two rows: numbers of both columns, null being one more value.
        numbers = [pc.dictionary_encode(c, null_encoding="encode").indices.to_numpy(zero_copy_only=False) for c in batch.columns[:2]]
        changes = np.flatnonzero((numbers[0][1:] != numbers[0][:-1]) | (numbers[1][1:] != numbers[1][:-1])) + 1
        bounds = [0, *changes.tolist(), n]
        for begin, end in zip(bounds[:-1], bounds[1:], strict=True):
            found = [batch.column(i)[begin].as_py() for i in range(2)]
            if digest is None or found != key:
                if digest is not None:
                    out.append((*key, f"sha256:{digest.hexdigest()}"))
                key, digest, first = found, hashlib.sha256(), True
            lines = batch.column(2).slice(begin, end - begin).drop_null().to_pylist()
            if lines:
                digest.update((("" if first else "\n") + "\n".join(lines)).encode())
                first = False
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out, strict=True)], names=names)
    if digest is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v], pa.string()) for v in (*key, f"sha256:{digest.hexdigest()}")], names=names)


def digest_lines(files: DataFrame) -> DataFrame:
    """Snapshot, path and ``path:digest`` of every file: contents are hashed where they are read."""
    return files.select(
        *[F.col(k).cast("string") for k in SNAPSHOT], "path",
        F.concat(F.col("path"), F.lit(":"), content_digest(F.col("content"))).alias("line"),
    )


def fingerprint_of(lines: DataFrame) -> DataFrame:
    """SHA-256 over the ordered lines of each snapshot. They come to one task in order and update one running hash, so a
    snapshot of any size takes constant memory."""
    ordered = lines.repartition(*SNAPSHOT).sortWithinPartitions(*SNAPSHOT, "path", "line").select(*SNAPSHOT, "line")
    schema = ", ".join(f"{c} string" for c in (*SNAPSHOT, "fingerprint"))
    return ordered.mapInArrow(_running_digests, schema)


def fingerprint(files: DataFrame, max_files: int | None = None) -> DataFrame:
    """A10. SHA-256 over the ordered ``path:digest`` lines of each snapshot.

    With ``max_files``, larger snapshots are reported with ``limit-exceeded`` instead.
    """
    lines = digest_lines(files)
    over = None
    if max_files is not None:
        sizes = lines.groupBy(*SNAPSHOT).agg(F.count("*").alias("files")).where(F.col("files") > max_files)
        over, lines = sizes.select(*SNAPSHOT), lines.join(sizes, SNAPSHOT, "left_anti")
    done = fingerprint_of(lines).withColumn("error_code", F.lit(None).cast("string"))
    if over is None:
        return done
    refused = over.withColumn("fingerprint", F.lit(None).cast("string")).withColumn("error_code", F.lit("limit-exceeded"))
    return done.unionByName(refused)


def snapshot_usage(manifest: DataFrame) -> DataFrame:
    """A13. Bytes, files, depth and skipped entries per snapshot."""
    head = F.col("head") if "head" in manifest.columns else None
    kind = V.entry_kind(F.col("mode"), F.col("object_type"), head)
    regular = kind.isin("regular", "lfs_pointer")
    return manifest.groupBy(*SNAPSHOT).agg(
        F.sum(F.when(regular, F.col("size_bytes")).otherwise(F.lit(0))).cast("bigint").alias("materialized_bytes"),
        F.count_if(regular).alias("materialized_files"),
        F.max(F.size(F.split("path", "/"))).cast("int").alias("max_path_depth"),
        F.count_if(kind == "symlink").alias("skipped_symlinks"),
        F.count_if(kind == "submodule").alias("skipped_submodules"),
        F.count_if(kind == "lfs_pointer").alias("skipped_lfs_pointers"),
    )


def path_collisions(manifest: DataFrame) -> DataFrame:
    """A14. Paths of one snapshot that normalise to the same key."""
    return (
        manifest.select(*SNAPSHOT, "path", collision_key(F.col("path")).alias("collision_key"))
        .groupBy(*SNAPSHOT, "collision_key")
        .agg(F.count("*").alias("paths"), F.min("path").alias("first_path"), F.max("path").alias("last_path"))
        .where("paths > 1")
    )


def limit_breaches(
    manifest: DataFrame,
    max_files: int = C.SNAPSHOT_MAX_FILES,
    max_bytes: int = C.SNAPSHOT_MAX_BYTES,
    max_file_bytes: int = C.SNAPSHOT_MAX_FILE_BYTES,
) -> DataFrame:
    """A15. One row per snapshot and limit it exceeds."""
    kind = V.entry_kind(F.col("mode"), F.col("object_type"))
    size = F.when(kind == "regular", F.col("size_bytes")).otherwise(F.lit(0))
    totals = manifest.groupBy(*SNAPSHOT).agg(
        F.count("*").alias("files"), F.sum(size).cast("bigint").alias("bytes"), F.max(size).cast("bigint").alias("largest")
    )
    limits = F.array(
        F.struct(F.lit("files").alias("name"), F.col("files").alias("value"), F.lit(max_files).cast("bigint").alias("max")),
        F.struct(F.lit("total_bytes").alias("name"), F.col("bytes").alias("value"), F.lit(max_bytes).cast("bigint").alias("max")),
        F.struct(
            F.lit("file_bytes").alias("name"), F.col("largest").alias("value"), F.lit(max_file_bytes).cast("bigint").alias("max")
        ),
    )
    return (
        exploded(totals, limits, "l")
        .select(*SNAPSHOT, F.col("l.name").alias("limit_name"), F.col("l.value").alias("value"), F.col("l.max").alias("maximum"))
        .where("value > maximum")
    )
