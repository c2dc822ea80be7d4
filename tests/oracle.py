"""Compare registered queries with their SQL form in DuckDB.

Run as a script: python tests/oracle.py [sf] [name prefix ...]
"""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
import traceback

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (float, decimal.Decimal)):
        f = float(v)
        return None if math.isnan(f) else round(f, 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return sorted(names), sorted(out, key=repr)


def compare(spark, con, sf_dir, query, sql):
    """(columns, spark rows, sql rows) sorted alike; sql None means rows only."""
    df = query(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return got, None
    res = con.execute(sql)
    want = rows_of([c[0] for c in res.description], res.fetchall())
    return got, want


def session():
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main(argv):
    sys.path.insert(0, __file__.rsplit("/", 2)[0])
    from newsflow import catalog

    sf = argv[0] if argv else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con = session(), connect(sf_dir)
    oracles = catalog.all_oracles()
    bad = 0
    for name, q in catalog.all_queries().items():
        if argv[1:] and not any(name.startswith(p) for p in argv[1:]):
            continue
        t = time.time()
        try:
            got, want = compare(spark, con, sf_dir, q, oracles.get(name))
        except Exception as e:  # report every failure of the run
            bad += 1
            print(f"ERROR {name}: {str(e)[:1500]}")
            if "-v" in argv:
                traceback.print_exc()
            continue
        dt = time.time() - t
        if want is None:
            print(f"rows  {name}: {len(got[1])} ({dt:.1f}s)")
        elif got == want:
            print(f"ok    {name}: {len(got[1])} ({dt:.1f}s)")
        else:
            bad += 1
            print(f"DIFF  {name}: {got[0]} vs {want[0]}; {len(got[1])} vs {len(want[1])} rows ({dt:.1f}s)")
            g, w = set(map(repr, got[1])), set(map(repr, want[1]))
            print("   only spark:", [x[:400] for x in sorted(g - w)[:4]])
            print("   only sql:  ", [x[:400] for x in sorted(w - g)[:4]])
    print("failures:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
