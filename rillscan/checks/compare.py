"""Run registered queries against their SQL: ``python -m rillscan.checks.compare DIR [names]``."""

import decimal
import math
import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def _value(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float, decimal.Decimal)):
        return format(float(v), ".10g")
    return str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_value(row[i]) for i in order) for row in rows)


def compare(spark, sf_dir, query, sql) -> str:
    """Empty when both give the same rows, else what differs."""
    df = query(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    with duckdb.connect() as con:
        for name in TABLES:
            path = f"{sf_dir}/{name}.parquet"
            if os.path.exists(path):
                con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
        out = con.execute(sql)
        names = [d[0] for d in out.description]
        want = rows_of(names, out.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if got == want:
        return ""
    extra, missing = sorted(set(got) - set(want)), sorted(set(want) - set(got))
    return f"{len(got)} rows and {len(want)}; extra {extra[:3]}; missing {missing[:3]}"


def main(sf_dir, *names):
    from ..plans.queries import QUERIES
    from .oracle import sql
    spark = (SparkSession.builder.master("local[8]").config("spark.ui.enabled", False)
             .config("spark.sql.shuffle.partitions", 8).config("spark.driver.memory", "12g")
             .getOrCreate())
    spark.sparkContext.setLogLevel("OFF")
    wanted, bad = sql(), 0
    for name in names or QUERIES:
        start = time.time()
        try:
            said = (compare(spark, sf_dir, QUERIES[name], wanted[name])
                    if name in wanted else "(no SQL)")
        except Exception as error:  # noqa: BLE001 - one failure must not hide the others
            said = f"{type(error).__name__}: {str(error)[:700]}"
        bad += bool(said and said != "(no SQL)")
        print(f"{name:22} {time.time() - start:6.1f}s {said or 'ok'}", flush=True)
    print(f"{bad} differ")
    return bad


if __name__ == "__main__":
    sys.exit(bool(main(*sys.argv[1:])))
