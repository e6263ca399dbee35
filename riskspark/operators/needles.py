"""Literal search with a table of needles of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark.functions.rows import exploded

ANCHOR_WORDS = 3
_WORD = r"(?U)[\p{L}\p{N}_]+"


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_WORD), 0)


def scan_needles(files: DataFrame, needles: DataFrame) -> DataFrame:
    """Files that contain a needle, case-insensitively: ``repo_id, snapshot_id, path, needle_id``.

    Words inside a needle must appear in the file next to each other, so a needle is anchored on
    three consecutive words away from its edges and files are joined on such word triples. The
    needle is then searched in the files its anchor occurs in: triples are joined without the
    text, which is joined back once per candidate. Needles too short for an anchor are refused: they are rules, see scan_user_rules.
    """
    lowered = needles.select("needle_id", F.lower("needle").alias("needle"))
    inner = F.slice(_words(F.col("needle")), 2, ANCHOR_WORDS)
    anchored = lowered.withColumn("words", _words(F.col("needle"))).withColumn(
        "anchor", F.when(F.size("words") >= ANCHOR_WORDS + 2, F.xxhash64(F.array_join(inner, " ")))
    ).drop("words")
    checked = anchored.select(
        "needle_id",
        "needle",
        F.coalesce("anchor", F.raise_error(F.lit("needle too short for an anchor")).cast("bigint")).alias("anchor"),
    )
    words = F.col("words")
    last = F.greatest(F.size(words) - (ANCHOR_WORDS - 1), F.lit(0))
    triples = F.when(
        last > 0,
        F.array_distinct(
            F.transform(
                F.sequence(F.lit(1), last),
                lambda i: F.xxhash64(F.array_join(F.slice(words, i, F.lit(ANCHOR_WORDS)), " ")),
            )
        ),
    )
    keys = ["repo_id", "snapshot_id", "path"]
    text = files.where(F.col("text").isNotNull()).withColumn("low", F.lower("text"))
    worded = text.withColumn("words", _words(F.col("low")))
    pairs = (
        exploded(worded, triples, "anchor")
        .select(*keys, "anchor")
        .join(checked.select("anchor", "needle_id"), "anchor")
        .select(*keys, "needle_id")
        .distinct()
    )
    candidates = pairs.join(lowered, "needle_id").join(text.select(*keys, "low"), keys)
    return candidates.where(F.contains("low", F.col("needle"))).select(*keys, "needle_id")
