"""Named queries, the SQL that checks them, and the tables both read."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.session import scratch_path
from workload import derive

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
RAW: dict[str, str] = {}

_GIVEN = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


_STORED: dict[tuple[str, str, str], tuple[str, object]] = {}


def dealt(frame: DataFrame, *keys: str) -> DataFrame:
    """The rows over all cores: read from few row groups, they and all that is read from them later would stay in as few tasks."""
    least = 2 * frame.sparkSession.sparkContext.defaultParallelism
    return frame if frame.rdd.getNumPartitions() >= least else frame.repartition(least, *keys)


class Tables:
    """Given and derived tables of one data folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def given(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def sql(self, text: str) -> DataFrame:
        """Run shared SQL with the given tables bound to this folder."""
        prefix = "t" + re.sub(r"\W", "_", self.folder)

        def bind(match: re.Match) -> str:
            view = f"{prefix}_{match.group(2)}"
            self.given(match.group(2)).createOrReplaceTempView(view)
            return f"{match.group(1)}{view}"

        return self.spark.sql(re.sub(rf"\b(FROM |JOIN )({'|'.join(_GIVEN)})\b", bind, text))

    def stored(self, name: str, build) -> DataFrame:
        """Derived table written once per session to the shared folder and read from there."""
        key = (self.spark.sparkContext.applicationId, self.folder, name)
        if key not in _STORED:
            frame, path = build(), scratch_path(self.spark, name)
            frame.write.parquet(path)
            _STORED[key] = (path, frame.schema)
        path, schema = _STORED[key]
        return self.spark.read.schema(schema).parquet(path)

    @cached_property
    def files(self) -> DataFrame:
        return self.stored(
            "files",
            lambda: dealt(
                self.sql(derive.files_sql()).withColumn("size_bytes", F.octet_length("text").cast("bigint")), "doc_id", "text"
            ),
        )

    @cached_property
    def raw_files(self) -> DataFrame:
        """Files as stored: bytes instead of text."""
        return self.files.withColumn("content", F.encode("text", "UTF-8")).drop("text")

    @cached_property
    def commands(self) -> DataFrame:
        return self.stored("commands", lambda: self.sql(derive.commands_sql()))

    @cached_property
    def origins(self) -> DataFrame:
        return self.sql(derive.origins_sql())

    @cached_property
    def approvals(self) -> DataFrame:
        provenance = F.struct(
            F.lit("trust-cache-array-v2").alias("schema"),
            F.when(F.col("event_id") % 3 == 0, "legacy-migration").otherwise("cli-trust-approve").alias("source"),
            F.lit("v0.3.3-trust-read-foundation").alias("migration_version"),
            F.when(F.col("event_id") % 3 != 0, F.col("approved_at")).alias("created_at"),
            F.when(F.col("event_id") % 3 == 0, F.col("approved_at")).alias("migrated_at"),
            F.lit(None).cast("string").alias("approval_reason"),
            F.lit(None).cast("string").alias("mutation_audit_event_id"),
        )
        return (
            self.sql(derive.approvals_sql())
            .withColumn("approved_at", F.col("approved_at").cast("timestamp"))
            .withColumn("expires_at", F.expr("approved_at + make_dt_interval(0, CAST(life_hours AS INT))"))
            .withColumn("provenance", provenance)
            .withColumn("store_ord", F.col("event_id"))
        )

    @cached_property
    def results(self) -> DataFrame:
        return self.sql(derive.results_sql()).withColumn("created_at", F.col("created_at").cast("timestamp"))

    @cached_property
    def audit(self) -> DataFrame:
        return self.sql(derive.audit_sql()).withColumn("ts", F.col("ts").cast("timestamp"))

    @cached_property
    def manifest(self) -> DataFrame:
        return self.sql(derive.manifest_sql())


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is its check, with derived tables as common table expressions."""

    def wrap(build: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: build(Tables(spark, folder))
        if sql is not None:
            RAW[name] = sql
            ORACLES[name] = bind_derived(sql)
        return build

    return wrap


_DERIVED = {
    "files": derive.files_sql,
    "commands": derive.commands_sql,
    "origins": derive.origins_sql,
    "approvals": lambda: f"SELECT *, approved_at + to_hours(life_hours) AS expires_at FROM ({derive.approvals_sql()}) a",
    "results": derive.results_sql,
    "audit": derive.audit_sql,
    "manifest": derive.manifest_sql,
}
_EXTRA: dict[str, str] = {}


def define(name: str, sql: str) -> None:
    """A further common table expression the checks can use."""
    _EXTRA[name] = sql


def bind_derived(sql: str) -> str:
    """Prefix the common table expressions ``sql`` refers to, directly or not."""
    parts: list[tuple[str, str]] = []

    def need(text: str) -> None:
        for name in [*_DERIVED, *_EXTRA]:
            if re.search(rf"\b{name}\b", text) and name not in [p[0] for p in parts]:
                body = _EXTRA[name] if name in _EXTRA else _DERIVED[name]()
                need_names = re.sub(r"'[^']*'", "''", body)
                if name in _EXTRA:
                    need(need_names)
                if name not in [p[0] for p in parts]:
                    parts.append((name, body))

    need(re.sub(r"'[^']*'", "''", sql))
    if not parts:
        return sql
    clauses = ",\n".join(f"{name} AS ({body})" for name, body in parts)
    recursive = "RECURSIVE " if "RECURSIVE" in sql else ""
    sql = re.sub(r"^\s*WITH (RECURSIVE )?", "", sql) if re.match(r"^\s*WITH ", sql) else sql
    joiner = ",\n" if sql is not None and re.match(r"^\s*[a-z_0-9]+(\([^)]*\))? AS \(", sql) else "\n"
    return f"WITH {recursive}{clauses}{joiner}{sql}"
