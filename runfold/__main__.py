"""Run one registered key: ``python -m runfold KEY SF_DIR [--explain] [--rows N]``.

Prints the first rows (or the formatted physical plan) of the key's result.
On a cluster, submit with ``spark-submit`` and the session comes from the
submit configuration.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from runfold.plans import QUERIES
from runfold.session import configure


def main() -> None:
    ap = argparse.ArgumentParser(prog="python -m runfold")
    ap.add_argument("key", choices=sorted(QUERIES))
    ap.add_argument("sf_dir")
    ap.add_argument("--explain", action="store_true", help="print the formatted physical plan")
    ap.add_argument("--rows", type=int, default=20, help="rows to show")
    a = ap.parse_args()
    spark = configure(SparkSession.builder.appName(f"runfold-{a.key}").getOrCreate())
    df = QUERIES[a.key](spark, a.sf_dir)
    if a.explain:
        df.explain("formatted")
    else:
        df.show(a.rows, truncate=80)


if __name__ == "__main__":
    main()
