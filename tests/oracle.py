"""Run registered queries against their DuckDB oracle.

    python -m tests.oracle [--sf 0.01] [name ...]
"""

from __future__ import annotations

import argparse
import datetime
import math
import sys
import time
from collections import Counter
from decimal import Decimal

import duckdb
import numpy as np

DATA = "/root/testdata"


def connect(sf: str):
    from catalog.base import TABLES
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/sf{sf}/{t}.parquet'")
    return con


def plain(v):
    if v is None:
        return None
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (float, np.floating)):
        return None if math.isnan(v) else round(float(v), 6)
    if isinstance(v, Decimal):
        return round(float(v), 6)
    if isinstance(v, (int, np.integer)):
        return int(v)
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(plain(x) for x in v)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(plain(r[i]) for i in order) for r in rows)


KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


def compare(spark, con, name: str, sf: str):
    """(problem or None, rows, seconds)"""
    import __spark_entry__ as E
    start = time.time()
    df = E.queries()[name](spark, f"{DATA}/sf{sf}")
    cols, got = rows_of(df.columns, df.collect())
    took = time.time() - start
    sql = E.oracle_sql().get(name)
    total = sum(got.values())
    if sql is None:
        return None, total, took
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    kinds = {d[0]: str(d[1]) for d in res.description}
    wcols, want = rows_of(names, res.fetchall())
    if cols != wcols:
        return f"columns {cols} != {wcols}", total, took
    odd = [f"{f.name} {f.dataType.simpleString()} vs {kinds[f.name]}" for f in df.schema.fields
           if KINDS.get(f.dataType.simpleString()) != kinds[f.name].upper()]
    if got != want:
        a, b = list((got - want).elements()), list((want - got).elements())
        return (f"{len(a)} only in spark, {len(b)} only in oracle, of {total}\n   S {str(sorted(a, key=str)[:2])[:700]}\n"
                f"   O {str(sorted(b, key=str)[:2])[:700]}"), total, took
    return (f"types differ: {odd}" if odd else None), total, took


def session():
    from pyspark.sql import SparkSession
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    import __spark_entry__ as E
    spark, con, bad = session(), connect(args.sf), 0
    for name in E.queries():
        if args.names and not any(name.startswith(n) for n in args.names):
            continue
        try:
            problem, n, took = compare(spark, con, name, args.sf)
        except Exception as e:  # report and go on with the next query
            problem, n, took = f"{type(e).__name__} {str(e)[:900]}", 0, 0.0
        bad += problem is not None
        kind = "" if name in E.oracle_sql() else " (no oracle)"
        print(f"{'FAIL' if problem else 'ok  '} {name}{kind} rows={n} {took:.2f}s {problem or ''}", flush=True)
    print("failures", bad)
    sys.exit(bool(bad))


if __name__ == "__main__":
    main()
