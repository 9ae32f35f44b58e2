"""Compare each Spark query with its DuckDB oracle (count, columns, values).

Run as a script for a per-key report::

    python tests/oracle_compare.py /root/testdata/sf0.01 [key ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

VIEWS = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
         "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for v in VIEWS:
        con.execute(f"CREATE VIEW {v} AS SELECT * FROM read_parquet('{sf_dir}/{v}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return _norm(v.asDict())
    return v


def spark_rows(df):
    cols = sorted(df.columns)
    rows = [tuple(_norm(r[c]) for c in cols) for r in df.select(*cols).collect()]
    return cols, rows


def duck_rows(con, sql):
    rel = con.sql(sql)
    cols = list(rel.columns)
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    rows = [tuple(_norm(r[i]) for i in order) for r in rel.fetchall()]
    return [cols[i] for i in order], rows, dict(zip(rel.columns, [str(t) for t in rel.types]))


def compare(spark, con, key, sf_dir):
    from runfold.plans import ORACLE, QUERIES
    df = QUERIES[key](spark, sf_dir)
    sc, sr = spark_rows(df)
    if key not in ORACLE:
        return {"key": key, "ok": None, "rows": len(sr)}
    dc, dr, dtypes = duck_rows(con, ORACLE[key])
    res = {"key": key, "rows": len(sr), "oracle_rows": len(dr), "cols_ok": sc == dc}
    key_fn = lambda t: tuple((x is None, str(x)) for x in t)
    res["values_ok"] = sorted(sr, key=key_fn) == sorted(dr, key=key_fn)
    res["ok"] = res["cols_ok"] and res["values_ok"] and len(sr) == len(dr)
    if not res["ok"]:
        res["spark_cols"], res["duck_cols"] = sc, dc
        s1, d1 = set(sr), set(dr)
        res["only_spark"] = sorted(s1 - d1, key=key_fn)[:3]
        res["only_duck"] = sorted(d1 - s1, key=key_fn)[:3]
    sdt = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    res["types"] = {c: (sdt.get(c), dtypes.get(c)) for c in sc}
    return res


def main(argv):
    from runfold.session import get_spark
    sf = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    keys = argv[2:]
    from pyspark.sql import SparkSession
    SparkSession.builder.config("spark.ui.showConsoleProgress", "false").config("spark.ui.enabled", "false")
    spark = get_spark("local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf)
    from runfold.plans import QUERIES
    for k in keys or sorted(QUERIES):
        try:
            r = compare(spark, con, k, sf)
        except Exception as e:  # noqa: BLE001
            r = {"key": k, "ok": False, "error": str(e)[:600]}
        print(r, flush=True)


if __name__ == "__main__":
    main(sys.argv)
