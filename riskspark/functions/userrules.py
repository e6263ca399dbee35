"""User rules in Python (X1): a table function, and the same rule in bulk."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf

# A rule takes (path, text) and yields (rule_id, severity, line, evidence).
UserRule = Callable[[str, str], Iterable[tuple[str, str, int, str]]]
ROW = "rule_id string, severity string, line int, evidence string"


def as_table_function(rule: UserRule):
    """Rule as a Python table function for lateral joins in SQL."""

    class _Rule:
        def eval(self, path: str, text: str):
            if text is not None:
                yield from rule(path, text)

    return udtf(_Rule, returnType=ROW)


def register(spark: SparkSession, name: str, rule: UserRule) -> None:
    spark.udtf.register(name, as_table_function(rule))


def scan_with(files: DataFrame, rule: UserRule) -> DataFrame:
    """Rule over all files in Arrow batches; each task keeps its own files."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [
                (repo, snapshot, path, *hit)
                for repo, snapshot, path, text in frame.itertuples(index=False)
                if text is not None
                for hit in rule(path, text)
            ]
            yield pd.DataFrame(rows, columns=["repo_id", "snapshot_id", "file", "rule_id", "severity", "line", "evidence"])

    return files.select("repo_id", "snapshot_id", "path", "text").mapInPandas(
        batches, f"repo_id string, snapshot_id string, file string, {ROW}"
    )
