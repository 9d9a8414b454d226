"""Run registered queries beside their SQL twins and compare whole results."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return repr(v + 0.0)
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted([tuple(_cell(r[i]) for i in order) for r in rows], key=str)


def compare(spark_df, con, sql):
    """Empty string when equal, else what differs."""
    got_cols, got = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cur = con.execute(sql)
    kinds = {d[0]: str(d[1]) for d in cur.description}
    want_cols, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    spark_kinds = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR"}
    odd = {n: (t, kinds[n]) for n, t in spark_df.dtypes if spark_kinds.get(t) != kinds[n]}
    note = f"types {odd}; " if odd else ""
    if len(got) != len(want):
        return note + f"rows {len(got)} != {len(want)}"
    diff = [(g, w) for g, w in zip(got, want) if g != w]
    return note + (f"{len(diff)} rows differ, first {diff[0]}" if diff else "")


if __name__ == "__main__":
    from hirelake.session import build_session
    import __spark_entry__ as driver

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = sys.argv[2:]
    spark = build_session(master="local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g", "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls = duck(sf), driver.oracle_sql()
    for name, query in driver.queries().items():
        if only and name not in only:
            continue
        start = time.time()
        try:
            if name in sqls:
                out = compare(query(spark, sf), con, sqls[name])
                n = con.execute(f"SELECT count(*) FROM ({sqls[name]})").fetchone()[0]
                print(f"{'ok  ' if not out else 'FAIL'} {name} n={n} {time.time() - start:.1f}s {out[:600]}", flush=True)
            else:
                print(f"rows {name} {query(spark, sf).count()} {time.time() - start:.1f}s", flush=True)
        except Exception as e:  # noqa: BLE001
            print(f"ERR  {name} {time.time() - start:.1f}s {str(e)[:900]}", flush=True)
