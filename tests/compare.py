"""Runs queries on Spark and their SQL on DuckDB and compares rows (columns by name, order-free)."""
import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def duck(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if hasattr(v, "as_tuple"):
        return round(float(v), 6)
    return v


def rows(columns, data) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_cell(r[i]) for i in order) for r in data)


def compare(spark, con, sf: str, name: str, query, sql: str | None):
    """(ok, message)"""
    df = query(spark, sf)
    got = rows(df.columns, df.collect())
    if sql is None:
        return sum(got.values()) > 0, f"{sum(got.values())} rows, no SQL"
    rel = con.execute(sql)
    columns = [d[0] for d in rel.description]
    want = rows(columns, rel.fetchall())
    if sorted(columns) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} / {sorted(columns)}"
    lost, extra = want - got, got - want
    if lost or extra:
        return False, (f"{sum(got.values())} rows / {sum(want.values())}; missing {sum(lost.values())} {list(lost)[:2]}; "
                       f"extra {sum(extra.values())} {list(extra)[:2]}")
    return True, f"{sum(got.values())} rows"


def main(sf: str, names: list[str]):
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    from pyspark.sql import SparkSession
    import __spark_entry__ as entry
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.driver.memory", "12g")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("OFF")
    con, queries, sql = duck(sf), entry.queries(), entry.oracle_sql()
    for name in names or queries:
        t = time.time()
        try:
            ok, message = compare(spark, con, sf, name, queries[name], sql.get(name))
        except Exception as e:  # noqa: BLE001
            ok, message = False, f"{type(e).__name__}: {str(e)[:400]}"
        print(f"\n## {'ok  ' if ok else 'FAIL'} {name} {time.time() - t:.1f}s {message}", flush=True)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
