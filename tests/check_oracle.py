"""Run registered queries against their DuckDB SQL: ``python tests/check_oracle.py [sf_dir] [name ...]``."""

from __future__ import annotations

import os
import sys
import time
import traceback

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _key(row: tuple) -> tuple:
    return tuple((v is None, str(v)) for v in row)


def rows_of(columns: list[str], rows: list[tuple]) -> tuple[list[str], list[tuple]]:
    """Columns by name, rows in a fixed order, numbers as they are."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=_key)


def _plain(v):
    if v.__class__.__name__ == "Decimal":
        return float(v)
    if isinstance(v, float) and v == 0:
        return 0.0
    return v


def compare(spark, con, fn, sql: str | None, sf_dir: str) -> str:
    df = fn(spark, sf_dir)
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return f"rows only ({len(mine[1])})" if mine[1] else "EMPTY"
    cur = con.execute(sql)
    theirs = rows_of([d[0] for d in cur.description], cur.fetchall())
    if mine[0] != theirs[0]:
        return f"COLUMNS {mine[0]} != {theirs[0]}"
    if len(mine[1]) != len(theirs[1]):
        return f"ROWS {len(mine[1])} != {len(theirs[1])}"
    if not mine[1]:
        return "EMPTY"
    bad = [(a, b) for a, b in zip(mine[1], theirs[1]) if a != b]
    if bad:
        return f"VALUES {len(bad)} of {len(mine[1])} differ, first: {str(bad[0])[:700]}"
    types = [(a, type(x), type(y)) for a, x, y in zip(mine[0], mine[1][0], theirs[1][0]) if type(x) is not type(y)]
    return f"ok ({len(mine[1])})" + (f" types {types}" if types else "")


def main() -> int:
    from groundcheck.plans.catalog import ORACLE, QUERIES
    from groundcheck.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = build_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con, failed = connect(sf_dir), 0
    for name in names:
        started = time.time()
        try:
            verdict = compare(spark, con, QUERIES[name], ORACLE.get(name), sf_dir)
        except Exception as exc:  # the check goes on with the next query
            verdict = f"ERROR {type(exc).__name__}: {str(exc)[:900]}"
            if os.environ.get("TRACE"):
                traceback.print_exc()
        failed += not verdict.startswith(("ok", "rows only"))
        print(f"{name:28s} {time.time() - started:6.1f}s  {verdict}", flush=True)
    print(f"{len(names)} queries, {failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
