"""Files as numbered lines (W7-W9). Windows run per file, which the read cap bounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskspark.functions.paths import strip
from riskspark.functions.rows import numbered
from riskspark.functions.text import split_lines, strip_comment

FILE = ["repo_id", "snapshot_id", "path"]


def active_lines(files: DataFrame) -> DataFrame:
    """W7. Numbered lines that hold more than a comment."""
    lines = numbered(files, split_lines(F.col("text")), "i", "raw")
    return (
        lines.select(*FILE, (F.col("i") + 1).alias("line_no"), strip_comment(F.col("raw")).alias("line"))
        .where(strip(F.col("line")) != "")
    )


def section_of_line(files: DataFrame, header: str = r"^\s*\[([^\[\]]+)\]\s*$") -> DataFrame:
    """W8. Each line with the last section header at or above it."""
    lines = numbered(files, split_lines(F.col("text")), "i", "line")
    name = F.when(F.col("line").rlike(header), F.regexp_extract("line", header, 1))
    down = Window.partitionBy(*FILE).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return (
        lines.select(*FILE, (F.col("i") + 1).alias("line_no"), "line")
        .withColumn("header", name)
        .withColumn("section", F.last("header", ignorenulls=True).over(down))
        .drop("header")
    )


def block_depth(files: DataFrame) -> DataFrame:
    """W9. Every brace with the nesting depth it leaves behind."""
    braces = numbered(files, F.regexp_extract_all("text", F.lit("[{}]"), 0), "pos", "brace").select(*FILE, "pos", "brace")
    step = F.when(F.col("brace") == "{", 1).otherwise(-1)
    run = Window.partitionBy(*FILE).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return braces.withColumn("depth", F.sum(step).over(run).cast("int"))
