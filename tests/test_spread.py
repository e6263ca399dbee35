"""Work that must not stay in a few tasks, and levels that must not be stored twice."""

from pyspark.sql import functions as F

from riskspark.operators import graph
from workload.registry import Tables


def test_files_of_one_row_group_are_spread(spark, tmp_path):
    """Every scan of texts reads this table, so its files bound the tasks of all of them."""
    rows = spark.range(400).select(
        F.when(F.col("id") % 9 > 0, F.col("id")).alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 50).alias("text"), F.lit("en").alias("lang")
    )
    rows.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    files = Tables(spark, str(tmp_path)).files
    assert len(files.inputFiles()) >= spark.sparkContext.defaultParallelism
    assert files.count() == 400


def test_a_level_without_budget_is_stored_once(spark, monkeypatch):
    edges = [("r", "s", f"a{i}", j, "shell", f"a{i + 1}", "holds", f"a{i + 1}", "file") for i in range(2) for j in range(2)]
    edges = spark.createDataFrame(
        edges, "repo_id string, snapshot_id string, path string, ref_ord int, kind string, target string, reason string, resolved string, status string"
    )
    level = spark.createDataFrame(
        [("p", "r", "s", [0], [], None, "shell", "a0", "starts", "a0", "file")],
        "plan_id string, repo_id string, snapshot_id string, ord array<int>, parent_ord array<int>, parent_file string, kind string,"
        " target string, reason string, resolved string, status string",
    )
    used = spark.createDataFrame([("p", 1)], "plan_id string, used bigint")
    whole, stored = graph.cut, []
    monkeypatch.setattr(graph, "cut", lambda df: stored.append(df.columns) or whole(df))
    levels = graph.expand_levels(level, edges, used, max_nodes=None)
    # a1 is met by two references and followed once, from the first of them.
    assert sorted((r.depth, r.ord) for r in levels.visits.collect()) == [(1, [0]), (2, [0, 0]), (2, [0, 1]), (3, [0, 0, 0]), (3, [0, 0, 1])]
    assert sum("parent_file" in columns for columns in stored) == 4
