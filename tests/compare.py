"""Run registered queries against DuckDB on the driver tables and compare rows."""

from __future__ import annotations

import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _norm(value):
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(_norm(v) for v in value)
    return value


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, sf_dir: str, name: str, query, sql: str) -> tuple[bool, str]:
    df = query(spark, sf_dir)
    ours = rows_of(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(sql)
    columns = [d[0] for d in res.description]
    theirs = rows_of(columns, res.fetchall())
    if sorted(df.columns) != sorted(columns):
        return False, f"columns {sorted(df.columns)} vs {sorted(columns)}"
    if ours == theirs:
        return True, f"{len(ours)} rows"
    only = [r for r in ours if r not in set(theirs)][:3]
    missing = [r for r in theirs if r not in set(ours)][:3]
    return False, f"{len(ours)} vs {len(theirs)} rows, columns {sorted(columns)}\n   spark:  {only}\n   duckdb: {missing}"


def main(names: list[str], sf: str = "sf0.01") -> int:
    from __spark_entry__ import oracle_sql, queries
    from sessionloom.session import build_session

    spark = build_session("local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"/root/testdata/{sf}"
    con, sqls, bad = connect(sf_dir), oracle_sql(), 0
    for name, query in queries().items():
        if names and name not in names:
            continue
        start = time.time()
        if name not in sqls:
            print(f"rows {name}: {query(spark, sf_dir).count()} ({time.time() - start:.1f}s)", flush=True)
            continue
        try:
            ok, detail = compare(spark, con, sf_dir, name, query, sqls[name])
        except Exception as error:  # noqa: BLE001
            ok, detail = False, str(error)[:1500]
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name}: {detail} ({time.time() - start:.1f}s)", flush=True)
    return bad


if __name__ == "__main__":
    args = [a for a in sys.argv[1:] if not a.startswith("sf")]
    sys.exit(main(args, next((a for a in sys.argv[1:] if a.startswith("sf")), "sf0.01")))
