"""Run registered queries against their SQL and compare: ``python tests/oracle_check.py DIR [query ...]``."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if isinstance(value, float) and value == value and not math.isinf(value):
        return round(value, 6) + 0.0
    if isinstance(value, float):
        return str(value)
    if hasattr(value, "as_integer_ratio") and not isinstance(value, (int, bool)):
        return float(value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def difference(spark_df, con, sql: str) -> str | None:
    """None when equal, else what differs first."""
    mine = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    theirs = rows_of(names, cursor.fetchall())
    if sorted(spark_df.columns) != sorted(names):
        return f"columns {sorted(spark_df.columns)} and {sorted(names)}"
    if len(mine) != len(theirs):
        return f"{len(mine)} rows and {len(theirs)}"
    for a, b in zip(mine, theirs):
        if a != b:
            return f"{str([x for x, y in zip(a, b) if x != y])[:600]} and {str([y for x, y in zip(a, b) if x != y])[:600]}"
    return None


if __name__ == "__main__":
    from pairloom.session import build_session
    from pairloom.workload.oracles import ORACLES
    from pairloom.workload.queries import QUERIES

    session = build_session(
        master="local[8]", shuffle_partitions=8,
        **{"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"},
    )
    session.sparkContext.setLogLevel("ERROR")
    sf_dir = sys.argv[1]
    con = connect(sf_dir)
    for name in sys.argv[2:] or list(QUERIES):
        start = time.time()
        try:
            found = difference(QUERIES[name](session, sf_dir), con, ORACLES[name]) if name in ORACLES else "no SQL"
        except Exception as error:  # report and go on to the next query
            found = f"{type(error).__name__}: {str(error)[:600]}"
        print(f"{name:32s} {time.time() - start:6.2f}s {'equal' if found is None else found}", flush=True)
