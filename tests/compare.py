"""Compare registered queries with their SQL twins in DuckDB."""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return round(value, 9)
    return value


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cells = [tuple(_cell(row[i]) for i in order) for row in rows]
    return sorted(cells, key=lambda r: tuple((v is None, str(type(v)), str(v)) for v in r))


def difference(spark_df, con, sql: str) -> str | None:
    """None when both give the same rows, else what differs."""
    got_rows = [tuple(r) for r in spark_df.collect()]
    con_result = con.execute(sql)
    want_cols = [c[0] for c in con_result.description]
    want_rows = con_result.fetchall()
    if sorted(spark_df.columns) != sorted(want_cols):
        return f"columns {sorted(spark_df.columns)} vs {sorted(want_cols)}"
    got, want = rows_of(spark_df.columns, got_rows), rows_of(want_cols, want_rows)
    if got == want:
        return None
    got_set, want_set = set(got), set(want)
    extra = [r for r in got if r not in want_set][:3]
    missing = [r for r in want if r not in got_set][:3]
    return f"rows {len(got)} vs {len(want)}; only spark {extra}; only sql {missing}"


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from noteloom.session import local_session

    import __spark_entry__ as entry

    sf_dir = sys.argv[1]
    names = sys.argv[2:] or list(entry.queries())
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    for name in names:
        start = time.time()
        df = entry.queries()[name](spark, sf_dir)
        if name in entry.oracle_sql():
            result = difference(df, con, entry.oracle_sql()[name]) or "same"
        else:
            result = f"rows only: {df.count()}"
        print(f"{name:32s} {time.time() - start:6.2f}s  {result[:900]}", flush=True)
