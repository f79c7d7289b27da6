"""Compare registered queries with their SQL statements on DuckDB."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, (int, float)):
        value = float(value)
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def bag(columns: list[str], rows) -> tuple[list[str], Counter]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(plain(r[i]) for i in order) for r in rows)


def compare(df, con, sql: str) -> str | None:
    """None when equal, else a short description of the difference."""
    cursor = con.execute(sql)
    want_cols, want = bag([d[0] for d in cursor.description], cursor.fetchall())
    got_cols, got = bag(df.columns, df.collect())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if got != want:
        a, b = list((got - want).items())[:2], list((want - got).items())[:2]
        return f"rows {sum(got.values())} vs {sum(want.values())}; only spark {str(a)[:700]}; only sql {str(b)[:700]}"
    return None


def main(folder: str, names: list[str]) -> int:
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as entry
    from glossa.session import local_session
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con, queries, sqls, bad = connect(folder), entry.queries(), entry.oracle_sql(), 0
    for name, run in queries.items():
        if names and not any(name.startswith(n) for n in names):
            continue
        start = time.time()
        try:
            if name in sqls:
                problem = compare(run(spark, folder), con, sqls[name])
                state = "ok" if problem is None else f"DIFF {problem}"
            else:
                state = f"rows {run(spark, folder).count()}"
        except Exception as error:
            state = f"FAIL {type(error).__name__}: {str(error)[:900]}"
        bad += state.startswith(("DIFF", "FAIL"))
        print(f"{name:32s} {time.time() - start:6.2f}s {state}", flush=True)
    print(f"{bad} bad")
    spark.stop()
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]) > 0)
