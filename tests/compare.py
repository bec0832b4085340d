"""Run registered queries against their DuckDB SQL: python -m tests.compare [sf] NAME..."""

import math
import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession


def session(cores: str = "8") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def oracle(sql: str, sf_dir: str):
    con = duckdb.connect()
    for f in sorted(os.listdir(sf_dir)):
        name = f.removesuffix(".parquet")
        path = f"{sf_dir}/{f}" if os.path.isfile(f"{sf_dir}/{f}") else f"{sf_dir}/{f}/*.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    r = con.execute(sql)
    return rows([d[0] for d in r.description], r.fetchall())


def compare(spark, name, query, sql, sf_dir):
    df = query(spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    return got, oracle(sql, sf_dir)


if __name__ == "__main__":
    import __spark_entry__ as e

    sf = sys.argv[1]
    names = sys.argv[2:] or list(e.queries())
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    for n in names:
        t = time.time()
        try:
            if n in e.oracle_sql():
                got, want = compare(spark, n, e.queries()[n], e.oracle_sql()[n], sf)
                ok = got == want
                print(n, "OK" if ok else "DIFF", len(got[1]), len(want[1]), f"{time.time() - t:.1f}s", flush=True)
                if not ok:
                    print("  cols", got[0], want[0])
                    g, w = set(map(repr, got[1])), set(map(repr, want[1]))
                    print("  only spark", sorted(g - w)[:3], "\n  only sql", sorted(w - g)[:3])
            else:
                print(n, "rows", e.queries()[n](spark, sf).count(), f"{time.time() - t:.1f}s", flush=True)
        except Exception as x:
            print(n, "ERROR", str(x)[:600], flush=True)
