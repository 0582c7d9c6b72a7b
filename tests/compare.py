"""Compare registered queries with their SQL in DuckDB, the way the driver does: sorted columns, row multisets."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time

import duckdb

from shelfspark.checks.fixtures import BASE


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in BASE:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def cell(value):
    if value is None:
        return None
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9) + 0.0
    if isinstance(value, decimal.Decimal):
        return ("decimal", float(value))
    if isinstance(value, (list, tuple)):
        return tuple(cell(v) for v in value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(
        (tuple((type(cell(r[i])).__name__, cell(r[i])) for i in order) for r in rows), key=repr
    )


def compare(df, con, sql):
    """Empty text when equal, else what differs."""
    result = con.execute(sql)
    want = rows_of([d[0] for d in result.description], result.fetchall())
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if want[0] != got[0]:
        return f"columns {got[0]} != {want[0]}"
    if want[1] == got[1]:
        return "" if want[1] else "both empty"
    got_set, want_set = set(got[1]), set(want[1])
    missing = [r for r in want[1] if r not in got_set][:3]
    extra = [r for r in got[1] if r not in want_set][:3]
    return f"rows {len(got[1])} != {len(want[1])}\n   wanted {missing}\n   got    {extra}"


if __name__ == "__main__":
    sys.path.insert(0, ".")
    import __spark_entry__ as entry
    from shelfspark.session import build_session

    folder, names = sys.argv[1], sys.argv[2:]
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                                "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracles, con = entry.queries(), entry.oracle_sql(), connect(folder)
    chosen = [n for n in queries if not names or any(n.startswith(p) for p in names)]
    bad = 0
    for name in chosen:
        started = time.time()
        try:
            df = queries[name](spark, folder)
            problem = compare(df, con, oracles[name]) if name in oracles else f"no oracle, {len(df.collect())} rows"
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        if problem:
            bad += 1
        print(f"{'ok ' if not problem else '---'} {name} {time.time() - started:.1f}s {problem}", flush=True)
    print(f"{len(chosen)} queries, {bad} to look at")
