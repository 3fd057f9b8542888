"""Run queries against their SQL twins in DuckDB and compare the values.

    python tests/oracle_compare.py [--sf /root/testdata/sf0.01] [--time] [prefix ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(value):
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return f"{value + 0.0:.6f}" if value != 0 else "0.000000"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(_plain(v) for v in value) + "]"
    return f"{type(value).__name__}:{value}"


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def compare(df, con, sql):
    """An empty string when both agree, else the first difference."""
    got_names, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    want_names, want = rows_of(names, cursor.fetchall())
    if got_names != want_names:
        return f"columns {got_names} != {want_names}"
    if len(got) != len(want):
        return f"{len(got)} rows, expected {len(want)}; first got {got[:2]} expected {want[:2]}"
    for g, w in zip(got, want):
        if g != w:
            return f"{dict(zip(got_names, g))} != {dict(zip(want_names, w))}"
    return "" if got else "no rows"


def main(argv):
    sf_dir = "/root/testdata/sf0.001"
    if "--sf" in argv:
        at = argv.index("--sf")
        sf_dir = argv[at + 1]
        del argv[at : at + 2]
    import __spark_entry__ as entry
    from tallywatch.session import local_session

    spark = local_session("oracle", "8")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracle = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, func in queries.items():
        if argv and not any(name.startswith(p) for p in argv):
            continue
        start = time.time()
        try:
            df = func(spark, sf_dir)
            if name in oracle:
                message = compare(df, con, oracle[name])
            else:
                n = len(df.collect())
                message = "" if n else "no rows"
        except Exception as error:  # noqa: BLE001 - report and go on
            message = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += bool(message)
        print(f"{'ok ' if not message else 'BAD'} {time.time() - start:6.2f}s {'sql ' if name in oracle else 'rows'} {name} {message}", flush=True)
    print(f"{bad} bad of {len(queries)}")
    spark.stop()
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
