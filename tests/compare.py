"""Run registered queries against their SQL in DuckDB: ``python tests/compare.py [folder] [name ...]``."""

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> list[tuple]:
    cols = sorted(df.columns)
    rows = df[cols].astype(object).where(df[cols].notna(), None).values.tolist()
    return sorted((tuple(float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in r) for r in rows), key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))


def difference(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    """None when both hold the same rows, else a short description."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} / {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} / {len(want)}"
    bad = [(g, w) for g, w in zip(canonical(got), canonical(want)) if g != w]
    return f"{len(bad)} of {len(got)} rows differ, e.g. {bad[:2]}" if bad else None


def main():
    import __spark_entry__ as entry
    from pyspark.sql import SparkSession

    args = sys.argv[1:]
    folder = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in args if not a.startswith("/")]
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = duck(folder), 0
    for name, fn in entry.queries().items():
        if names and not any(n in name for n in names):
            continue
        t = time.time()
        try:
            got = fn(spark, folder).toPandas()
            took, sql = time.time() - t, entry.oracle_sql().get(name)
            t = time.time()
            note = "no sql" if sql is None else difference(got, con.execute(sql).df())
            print(f"{'ok ' if note in (None, 'no sql') else 'BAD'} {name:24s} rows {len(got):7d} spark {took:6.2f}s duck {time.time() - t:5.2f}s {note or ''}", flush=True)
            bad += note not in (None, "no sql")
        except Exception as exc:  # noqa: BLE001
            bad += 1
            print(f"ERR {name}: {str(exc)[:1500]}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
