"""What a level loop keeps on disk: no shuffles of finished levels, no least paths of files that lead nowhere, edges stored once."""

import time

import pytest

from riskspark.operators import graph
from riskspark.session import cut_columns
from workload import all_queries
from workload.registry import Tables

EDGES = "repo_id string, snapshot_id string, path string, ref_ord int, kind string, target string, reason string, resolved string, status string"
LEVEL = (
    "plan_id string, repo_id string, snapshot_id string, ord array<int>, parent_ord array<int>, parent_file string, kind string,"
    " target string, reason string, resolved string, status string"
)


def edge(path, ref, target, resolved=None, repo="r", kind="shell", status="file"):
    return (repo, "s", path, ref, kind, target, "holds", resolved or target, status)


def start(plan, file, at, repo="r"):
    return (plan, repo, "s", [at], [], None, "shell", file, "starts", file, "file")


@pytest.fixture
def tables(spark):
    """Two repositories with a loop, a name of both, references met twice, a missing one, one without a position, and leaves."""
    edges = spark.createDataFrame([
        edge("a", 0, "b"), edge("a", 1, "./c", "c"), edge("a", 1, "leaf"), edge("b", 0, "a"), edge("b", 1, "c"), edge("b", None, "leaf2"),
        edge("c", 0, "gone", status="missing"), edge("c", 2, "d"), edge("d", 0, "leaf"), edge("a", 3, "e", kind="compose"),
        edge("leaf", 0, "x", repo="q"), edge("x", 0, "y", repo="q"), (None, "s", "a", 0, "shell", "z", "holds", "z", "file"),
    ], EDGES)
    level = spark.createDataFrame([
        start("p", "a", 0), start("p", "a", 1), start("p2", "b", 0), start("p3", "leaf", 0, "q"), start("p4", "leaf", 0), start(None, "a", 0),
        start("p5", "a", 0, None),
    ], LEVEL)
    return level, edges, spark.createDataFrame([(p, 1) for p in ("p", "p2", "p3", "p4", "p5")], "plan_id string, used bigint")


def found(levels):
    key = lambda r: str(tuple(r))
    columns = ["plan_id", "depth", "ord", "parent_ord", "parent_file", "kind", "target", "reason", "resolved", "status", "repo_id"]
    doubts = [tuple(r) for d in levels.doubts for r in d.collect()]
    return sorted(map(tuple, levels.visits.select(*columns).collect()), key=key), sorted(doubts, key=str), sorted(map(tuple, levels.used.collect()), key=str)


def test_wide_levels_give_the_same_in_slices(tables, monkeypatch):
    few = found(graph.expand_levels(*tables, max_nodes=None))
    visits = {(r[0], r[1], tuple(r[2]), tuple(r[3]), r[4], r[6], r[8]) for r in few[0] if r[0] in ("p", "p3")}
    assert visits == {
        ("p", 1, (0,), (), None, "a", "a"), ("p", 1, (1,), (), None, "a", "a"),
        ("p", 2, (0, 0), (0,), "a", "b", "b"), ("p", 2, (0, 1), (0,), "a", "./c", "c"), ("p", 2, (0, 1), (0,), "a", "leaf", "leaf"),
        ("p", 3, (0, 0, 0), (0, 0), "b", "a", "a"), ("p", 3, (0, 0, 1), (0, 0), "b", "c", "c"),
        ("p", 3, (0, 0, None), (0, 0), "b", "leaf2", "leaf2"), ("p", 3, (0, 1, 2), (0, 1), "c", "d", "d"),
        ("p", 4, (0, 1, 2, 0), (0, 1, 2), "d", "leaf", "leaf"),
        ("p3", 1, (0,), (), None, "leaf", "leaf"), ("p3", 2, (0, 0), (0,), "leaf", "x", "x"), ("p3", 3, (0, 0, 0), (0, 0), "x", "y", "y"),
    }
    assert [d[:3] for d in few[1] if d[0] == "p"] == [("p", [0, 1, 0], "SCRIPT_TARGET_MISSING")]
    monkeypatch.setattr(graph, "BROADCAST_ROW_LIMIT", 0)
    assert found(graph.expand_levels(*tables, max_nodes=None)) == few
    monkeypatch.setattr(graph, "SLICE_ROWS", 2)
    assert found(graph.expand_levels(*tables, max_nodes=None)) == few


def test_files_that_lead_nowhere_are_not_stored_again(tables, monkeypatch):
    whole, stored = graph.cut, []
    monkeypatch.setattr(graph, "BROADCAST_ROW_LIMIT", 0, raising=False)

    def cut(*parts):
        done = whole(*parts)
        if {"plan_id", "path", "ord"} <= set(done.columns):
            stored.append(done)
        return done

    monkeypatch.setattr(graph, "cut", cut)
    graph.expand_levels(*tables, max_nodes=None)
    assert {r.path for f in stored for r in f.where("repo_id = 'r'").collect()} == {"a", "b", "c", "d"}


def test_shuffles_of_finished_levels_are_gone(spark, tables, monkeypatch):
    jvm = spark.sparkContext._jvm
    shuffles = jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses()

    def settled(most):
        end = time.time() + 10
        while shuffles.size() > most and time.time() < end:
            time.sleep(0.2)
        return shuffles.size()

    monkeypatch.setattr(graph, "BROADCAST_ROW_LIMIT", 0, raising=False)
    jvm.System.gc()
    before = settled(0)
    graph.expand_levels(*tables, max_nodes=None)
    # A level takes some six shuffles; those of the last may still be known.
    assert settled(before + 6) <= before + 6


def test_parts_make_one_table(spark):
    rows = spark.createDataFrame([(1, [1, None]), (2, None), (None, [])], "id int, at array<int>")
    kept = cut_columns(rows.where("id = 1"), rows.where("id IS NULL"), rows.where("id = 2"), rows.where("id = 3"))
    assert sorted(map(tuple, kept.collect()), key=str) == [(1, [1, None]), (2, None), (None, [])]
    assert kept.schema == rows.schema


def test_edges_of_the_tables_are_stored_without_what_is_always_the_same(spark, tmp_path):
    for name, row in {
        "nation": "1L AS n_nationkey, 0L AS n_regionkey", "customer": "7L AS c_custkey, 1L AS c_nationkey",
        "orders": "5L AS o_orderkey, 7L AS o_custkey", "lineitem": "5L AS l_orderkey, 2 AS l_linenumber, 3L AS l_partkey, 4L AS l_suppkey",
    }.items():
        spark.sql(f"SELECT {row}").write.parquet(f"{tmp_path}/{name}.parquet")
    all_queries()  # loads the modules in the order their SQL is defined in
    from workload import q_graph

    edges = q_graph._business_edges(Tables(spark, str(tmp_path)))
    assert {(r.path, r.ref_ord, r.target, r.resolved, r.status) for r in edges.collect()} == {
        ("region/0", 1, "nation/1", "nation/1", "file"), ("nation/1", 7, "customer/7", "customer/7", "file"),
        ("customer/7", 5, "order/5", "order/5", "file"), ("order/5", 2, "line/5/2/3/4", "line/5/2/3/4", "file"),
    }
    assert spark.read.parquet(*edges.inputFiles()).columns == ["path", "ref_ord", "target"]
