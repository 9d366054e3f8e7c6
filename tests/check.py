"""Run registered queries against their SQL: python tests/check.py [name-prefix ...]."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def session(cpus: str = "8") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("marketframe")
        .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true").config("spark.sql.codegen.cache.maxEntries", "2000").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _norm(v):
    if isinstance(v, bool) or v is None or isinstance(v, (str, bytes)):
        return repr(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(float(v))
    if isinstance(v, (int, decimal.Decimal)):
        return repr(float(v))
    if isinstance(v, dt.datetime):
        return v.isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, dict):
        return str(sorted((k, _norm(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return str([_norm(x) for x in v])
    return repr(v)


def rows(names, data):
    idx = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_norm(r[i]) for i in idx) for r in data)


def compare(spark, con, run, sql, sf_dir) -> str:
    t = time.time()
    df = run(spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - t
    if not sql:
        return f"rows {len(got)} ({took:.1f}s)"
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = rows(names, cur.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"FAIL columns {sorted(df.columns)} != {sorted(names)}"
    if got != want:
        bad = [(g, w) for g, w in zip(got, want) if g != w]
        return f"FAIL {len(got)} vs {len(want)} rows, {len(bad)} differ, first:\n   got  {bad[0][0] if bad else ''}\n   want {bad[0][1] if bad else ''}"
    return f"ok {len(got)} ({took:.1f}s)"


def main(prefixes):
    import __spark_entry__ as entry
    sf_dir = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.01")
    spark, con = session(), duck(sf_dir)
    sql = entry.oracle_sql()
    failed = 0
    for name, run in entry.queries().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        try:
            res = compare(spark, con, run, sql.get(name), sf_dir)
        except Exception as e:
            res = f"FAIL {type(e).__name__}: {str(e)[:1500]}"
        failed += res.startswith("FAIL")
        print(f"{name}: {res}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main(sys.argv[1:])
