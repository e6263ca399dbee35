"""Run queries against their SQL checks: ``python -m workload.check [name-part ...]``."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

from riskspark.session import build_session
from workload import all_queries

SF = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.01")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def session(**extra: str):
    return build_session(
        "riskspark-check",
        master=f"local[{os.environ.get('CHECK_CPUS', '8')}]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "12g",
            "spark.driver.host": "127.0.0.1",
            **extra,
        },
    )


def _plain(value):
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float):
        if math.isnan(value):
            return None
        return round(value, 6) if value != int(value) else int(value)
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return value


def rows_of(frame) -> tuple[list[str], list[tuple]]:
    names = sorted(frame.columns)
    rows = [tuple(_plain(v) for v in row) for row in frame[names].astype(object).where(frame[names].notna(), None).itertuples(index=False)]
    return names, sorted(rows, key=repr)


def main(parts: list[str]) -> int:
    queries, oracles = all_queries()
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for table in TABLES.split():
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    failures = 0
    for name, build in queries.items():
        if parts and not any(p in name for p in parts):
            continue
        begun = time.time()
        try:
            names, got = rows_of(build(spark, SF).toPandas())
        except Exception as error:
            failures += 1
            print(f"ERROR {name}: {str(error).splitlines()[0][:300]}", flush=True)
            continue
        took = time.time() - begun
        if name not in oracles:
            print(f"rows  {name}: {len(got)} rows, {took:.1f}s", flush=True)
            continue
        try:
            wanted_names, wanted = rows_of(con.execute(oracles[name]).df())
        except Exception as error:
            failures += 1
            print(f"SQL   {name}: {str(error)[:400]}", flush=True)
            continue
        ok = names == wanted_names and got == wanted
        failures += not ok
        print(f"{'ok   ' if ok else 'DIFF '} {name}: {len(got)} rows, {took:.1f}s", flush=True)
        if not ok:
            print("   columns", names, wanted_names, len(got), len(wanted))
            extra = [r for r in got if r not in set(wanted)][:3] if len(got) < 50000 else []
            missing = [r for r in wanted if r not in set(got)][:3] if len(got) < 50000 else []
            print("   only spark ", str(extra)[:700])
            print("   only sql   ", str(missing)[:700])
    print("failures:", failures)
    return failures


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
