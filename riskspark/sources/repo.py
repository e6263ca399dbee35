"""Repository files, tree listings, cases and batches."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark import schemas
from riskspark.catalogue.files import MAX_TEXT_BYTES
from riskspark.functions.rows import exploded
from riskspark.session import cut


_LISTED = "path string, is_dir boolean, is_link boolean, size_bytes bigint"
_BATCH_BYTES = 16 * 1024 * 1024


def _list_dirs(root: str):
    """Entries directly below each directory of a batch."""

    def listing(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for folder in frame["path"]:
                with os.scandir(os.path.join(root, folder)) as entries:
                    for entry in entries:
                        link = entry.is_symlink()
                        is_dir = not link and entry.is_dir(follow_symlinks=False)
                        size = 0 if is_dir else entry.stat(follow_symlinks=False).st_size
                        rows.append((f"{folder}/{entry.name}" if folder else entry.name, is_dir, link, size))
            yield pd.DataFrame(rows, columns=["path", "is_dir", "is_link", "size_bytes"])

    return listing


def _load(root: str, max_bytes: int):
    """Content of each file of a batch, in batches of bounded size."""

    def loading(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows, held = [], 0
            for path, link, size in frame[["path", "is_link", "size_bytes"]].itertuples(index=False):
                content = None
                if not link and size <= max_bytes:
                    with open(os.path.join(root, path), "rb") as handle:
                        content = handle.read(max_bytes + 1)
                repo, _, inner = path.partition("/")
                rows.append((repo, inner, "120000" if link else "100644", size, content))
                held += size if content is not None else 0
                if held > _BATCH_BYTES:
                    yield pd.DataFrame(rows, columns=["repo_id", "path", "mode", "size_bytes", "content"])
                    rows, held = [], 0
            yield pd.DataFrame(rows, columns=["repo_id", "path", "mode", "size_bytes", "content"])

    return loading


def read_repo_files(
    spark: SparkSession, root: str, snapshot_id: str = "current", max_bytes: int = MAX_TEXT_BYTES
) -> DataFrame:
    """S1. Every file below ``<root>/<repo_id>/`` of a mounted file system, one row each.

    Spark's file sources leave out names that start with a dot, and those are often the critical
    ones here. Directories are therefore listed by tasks, one level at a time, and spread again
    before each level, so neither the driver nor one task walks a large repository alone. Links
    and oversized files keep a row without content.
    """
    root = root.removeprefix("file://").rstrip("/")
    frontier = spark.createDataFrame([("",)], "path string")
    found = []
    while True:
        listed = cut(frontier.mapInPandas(_list_dirs(root), _LISTED))
        folders = listed.where("is_dir").select("path")
        found.append(listed.where("NOT is_dir"))
        if folders.isEmpty():
            break
        frontier = folders.repartition(F.xxhash64("path"))
    files = reduce(DataFrame.unionByName, found).where(F.contains("path", F.lit("/")))
    loaded = files.repartition(F.xxhash64("path")).mapInPandas(
        _load(root, max_bytes), "repo_id string, path string, mode string, size_bytes bigint, content binary"
    )
    return loaded.select("repo_id", F.lit(snapshot_id).alias("snapshot_id"), "path", "mode", "size_bytes", "content")


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """S3. Regression cases kept as JSON lines."""
    return spark.read.schema(schemas.CASES).json(path)


def read_batch(spark: SparkSession, path: str) -> DataFrame:
    """S4. Batch entries from a list or from an object with ``repos``."""
    names = [field.split()[0] for field in schemas.BATCH_ENTRY.split(", ")]
    nested = ",".join(f"{n}:string" for n in names)
    raw = spark.read.schema(f"{schemas.BATCH_ENTRY}, repos array<struct<{nested}>>").option("multiLine", True).json(path)
    entries = F.coalesce("repos", F.array(F.struct(*names)))
    return exploded(raw, entries, "e").select("e.*").where("name IS NOT NULL")


def write_reports(reports: DataFrame, path: str) -> None:
    """S9. One JSON document per line."""
    reports.select(F.to_json("report", {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


_ENTRY_HEAD = r"^\d{6} (?:blob|commit|tree) (?:[0-9a-f]{40}|[0-9a-f]{64}) +(?:\d+|-)\z"


def parse_manifest(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """S11. Listing lines ``mode type id size TAB path`` to rows and a quarantine.

    One pattern is matched a line, on what stands before the first tab; the parts are cut out at fixed places.
    """
    keys = [c for c in lines.columns if c != "value"]
    tab = F.instr("value", "\t")
    head, path = F.substring_index("value", "\t", 1), F.substr("value", tab + 1)
    parts = F.split(head, " ")
    sound = (tab > 0) & (path != "") & head.rlike(_ENTRY_HEAD)
    good = lines.where(sound).select(
        *keys,
        F.get(parts, F.lit(0)).alias("mode"),
        F.get(parts, F.lit(1)).alias("object_type"),
        F.get(parts, F.lit(2)).alias("object_id"),
        F.substring_index(head, " ", -1).try_cast("bigint").alias("size_bytes"),
        F.make_valid_utf8(path).alias("path"),
    )
    bad = lines.where(~sound & (F.col("value") != "")).select(
        *keys, F.col("value").alias("entry"), F.lit("MCP_REMOTE_TREE_UNSAFE").alias("error_code")
    )
    return good, bad


def read_snapshot_manifest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """S11. NUL-separated tree listings; the snapshot is the listing's file name."""
    lines = (
        spark.read.option("lineSep", "\0").text(path)
        .select(
            F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1).alias("repo_id"),
            F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]+)", 1).alias("snapshot_id"),
            "value",
        )
    )
    return parse_manifest(lines)
