"""Compare registered queries with their SQL twins.

    python tests/oracle_check.py [sf folder] [query name ...]
"""

from __future__ import annotations

import datetime
import math
import os
import sys
import time
import traceback

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet')")
    return con


def _cell(v):
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, float):
        return "NULL" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return str(v)


def canonical(columns, rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def compare(spark, con, sf, query, sql) -> tuple[bool, str]:
    df = query(spark, sf)
    start = time.time()
    mine = canonical(df.columns, [tuple(x) for x in df.collect()])
    spent = f"{time.time() - start:.1f}s spark"
    if sql is None:
        return False, f"{len(mine)} rows, but no twin to hold them against, {spent}"
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    theirs = canonical(names, rel.fetchall())
    if sorted(df.columns) != sorted(names):
        return False, f"columns {sorted(df.columns)} != {sorted(names)}"
    if len(mine) != len(theirs):
        return False, f"rows {len(mine)} != {len(theirs)}"
    diff = [(a, b) for a, b in zip(mine, theirs) if a != b]
    if diff:
        return False, f"{len(diff)}/{len(mine)} rows differ {sorted(names)}: {diff[:2]}"
    return True, f"{len(mine)} rows, {spent}"


def session(cores: int = 8):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("crosstide")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main(argv: list[str]) -> int:
    import __spark_entry__ as entry

    sf = argv[0] if argv else "/root/testdata/sf0.01"
    wanted = argv[1:]
    spark, con = session(), connect(sf)
    twins = entry.oracle_sql()
    failed = []
    for name, query in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            ok, note = compare(spark, con, sf, query, twins.get(name))
        except Exception as error:  # report and go on to the next query
            ok, note = False, f"{type(error).__name__}: {str(error)[:700]}"
            if os.environ.get("TRACE"):
                traceback.print_exc()
        if not ok:
            failed.append(name)
        print(f"{'ok  ' if ok else 'FAIL'} {name:34s} {time.time() - start:6.2f}s {note[:900]}", flush=True)
    print("failed:", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
