"""Compares registered queries with their SQL on DuckDB: python tests/compare.py [dir] [name...]."""

import sys
import time
import os

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rounded(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(rounded, v))
    if isinstance(v, dict):
        return tuple((k, rounded(x)) for k, x in v.items())
    return v


def compare(spark, name, sf_dir):
    """None, or what differs."""
    import duckdb
    import __spark_entry__ as entry

    got = entry.queries()[name](spark, sf_dir)
    columns = sorted(got.columns)
    rows = sorted((tuple(rounded(v) for v in r) for r in got.select(*columns).collect()), key=repr)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return None if rows else "no rows"
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    if sorted(names) != columns:
        return f"columns {columns} and {sorted(names)}"
    at = [names.index(c) for c in columns]
    want = sorted((tuple(rounded(r[k]) for k in at) for r in found.fetchall()), key=repr)
    if rows != want:
        odd = [(a, b) for a, b in zip(rows, want) if a != b]
        return f"{len(rows)} and {len(want)} rows; first {odd[:2]}"
    return None


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "6g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    import __spark_entry__ as entry

    for name in sys.argv[2:] or entry.queries():
        began = time.time()
        try:
            said = compare(spark, name, sf_dir)
        except Exception as e:  # noqa: BLE001
            said = f"{type(e).__name__}: {str(e)[:600]}"
        print(f"{'ok  ' if said is None else 'FAIL'} {name} {time.time() - began:.1f}s{' (rows only)' * (name not in entry.oracle_sql())} {said or ''}", flush=True)
