"""Compares registered queries with their SQL in DuckDB, as row multisets.

    python tests/oracle.py /root/testdata/sf0.01 [NAME...]
"""

from __future__ import annotations

import math
import sys
from collections import Counter
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        p = Path(sf_dir, f"{t}.parquet")
        if p.exists():
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def _cell(x):
    if isinstance(x, float) and math.isfinite(x):
        return int(x) if x.is_integer() else round(x, 9)
    if isinstance(x, (list, tuple)):
        return tuple(map(_cell, x))
    return int(x) if type(x).__name__ == "Decimal" and x == int(x) else x


def rows_of(names, rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_cell(r[i]) for i in order) for r in rows)


def difference(spark, con, query, sql: str, sf_dir: str) -> str:
    """An empty text if both give the same rows under the same names."""
    df = query(spark, sf_dir)
    ours = rows_of(df.columns, df.collect())
    rel = con.sql(sql)
    theirs = rows_of(rel.columns, rel.fetchall())
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {sorted(df.columns)} and {sorted(rel.columns)}"
    if ours != theirs:
        return f"{sum(ours.values())} and {sum(theirs.values())} rows; only ours {list((ours - theirs).items())[:3]}; only SQL {list((theirs - ours).items())[:3]}"
    return ""


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import time

    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    session = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    session.sparkContext.setLogLevel("OFF")
    folder, names = sys.argv[1], sys.argv[2:]
    queries, sql = entry.queries(), entry.oracle_sql()
    link = connect(folder)
    for name in names or sql:
        began = time.time()
        try:
            said = difference(session, link, queries[name], sql[name], folder)
        except Exception as error:  # noqa: BLE001
            said = f"{type(error).__name__}: {str(error)[:700]}"
        print(name, f"{time.time() - began:.1f}s", said or "ok", flush=True)
