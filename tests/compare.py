"""Run registered queries against their SQL twins: python tests/compare.py DIR [name ...]."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _canonical(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]

    def cell(value):
        if value is None or value is pd.NaT or (isinstance(value, float) and value != value):
            return "NULL"
        if isinstance(value, (pd.Timestamp,)):
            return str(value)
        if isinstance(value, float) or hasattr(value, "dtype") and value.dtype.kind == "f":
            return repr(float(value))
        return str(value)

    return sorted(tuple(cell(v) for v in row) for row in frame.astype(object).itertuples(index=False))


def compare(spark, con, name: str, run, oracle: str, sf_dir: str) -> tuple[bool, str]:
    started = time.time()
    got = run(spark, sf_dir).toPandas()
    took = time.time() - started
    started = time.time()
    want = con.execute(oracle).df()
    oracle_took = time.time() - started
    if sorted(got.columns) != sorted(want.columns):
        return False, f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    a, b = _canonical(got), _canonical(want)
    note = f"rows {len(a)} vs {len(b)}  spark {took:.2f}s  duckdb {oracle_took:.2f}s"
    if a != b:
        only_a, only_b = sorted(set(a) - set(b))[:2], sorted(set(b) - set(a))[:2]
        note += f"\n   only spark {len(set(a) - set(b))}: {str(only_a)[:600]}\n   only oracle {len(set(b) - set(a))}: {str(only_b)[:600]}"
    return a == b, note


if __name__ == "__main__":
    import __spark_entry__ as contract
    from rankloom.session import build_session

    session = build_session(
        "compare", "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
           "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "16g"},
    )
    session.sparkContext.setLogLevel("ERROR")
    folder = sys.argv[1]
    registered, twins = contract.queries(), contract.oracle_sql()
    connection = duck(folder)
    for query in sys.argv[2:] or registered:
        if query not in twins:
            print(query, "rows", registered[query](session, folder).count(), flush=True)
            continue
        try:
            ok, text = compare(session, connection, query, registered[query], twins[query], folder)
            print("ok  " if ok else "FAIL", query, text, flush=True)
        except Exception as error:
            print("ERR ", query, str(error)[:700], flush=True)
