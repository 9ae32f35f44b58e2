"""Compare the subpackage's queries with their DuckDB SQL.

Run as a script: ``python -m tests.llm.compare /root/testdata/sf0.01 [key ...]``.
"""

from __future__ import annotations

import sys
import time

from tests.oracle_compare import duck, duck_rows, spark_rows


def compare(spark, con, key, sf_dir):
    import __spark_entry__ as e
    sc, sr = spark_rows(e.queries()[key](spark, sf_dir))
    sql = e.oracle_sql().get(key)
    if sql is None:
        return {"key": key, "ok": None, "rows": len(sr)}
    dc, dr, _ = duck_rows(con, sql)
    order = lambda t: tuple((x is None, str(x)) for x in t)
    out = {"key": key, "rows": len(sr), "oracle_rows": len(dr),
           "ok": sc == dc and sorted(sr, key=order) == sorted(dr, key=order)}
    if not out["ok"]:
        a, b = set(sr), set(dr)
        out |= {"spark_cols": sc, "duck_cols": dc, "n_diff": len(a ^ b), "only_spark": sorted(a - b, key=order)[:3],
                "only_duck": sorted(b - a, key=order)[:3]}
    return out


def main(argv):
    from runfold.session import get_spark
    spark = get_spark("local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(argv[1])
    for k in argv[2:]:
        t = time.time()
        print(compare(spark, con, k, argv[1]), round(time.time() - t, 1), flush=True)


if __name__ == "__main__":
    main(sys.argv)
