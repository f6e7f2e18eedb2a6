"""Run registered queries in Spark and their SQL in DuckDB and compare the results.

``python tests/check_oracle.py [sf folder] [name part ...]``
"""

from __future__ import annotations

import math
import pathlib
import sys
import time

import duckdb

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent.parent))

from lakefind.session import intermediate_tables  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    """A database of its own, small enough to live beside Spark."""
    con = duckdb.connect(config={"memory_limit": "4GB", "threads": 4})
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf}/{table}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, bool):
        return str(value)
    return repr(value)


def rows(columns: list[str], data) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(row[i]) for i in order) for row in data)


def compare(spark, con, sf: str, run, sql: str | None) -> str:
    """Empty when both sides agree, otherwise what differs."""
    with intermediate_tables(spark):
        df = run(spark, sf)
        got = [tuple(r) for r in df.collect()]
    if sql is None:
        return "" if got else "no rows"
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    left, right = rows(df.columns, got), rows(names, want)
    if left == right:
        return "" if left else "both empty"
    only_left, only_right = set(left) - set(right), set(right) - set(left)
    return (f"{len(left)} vs {len(right)} rows, {len(only_left)}/{len(only_right)} differ: "
            f"spark {[x[:6] for x in sorted(only_left)[:2]]} sql {[x[:6] for x in sorted(only_right)[:2]]}")[:1500]


def main() -> None:
    import __spark_entry__ as entry
    from lakefind.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark, con = local_session(8), connect(sf)
    sqls = entry.oracle_sql()
    bad = 0
    for name, run in entry.queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            problem = compare(spark, con, sf, run, sqls.get(name))
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:1200]}"
        kind = "sql " if name in sqls else "rows"
        bad += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {kind} {time.time() - start:6.1f}s {name} {problem}", flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main()
