"""Run the registered queries and their SQL side by side: `python tests/compare.py [sf_dir] [name ...]`."""

from __future__ import annotations

import datetime as dt
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(value: object) -> object:
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    if isinstance(value, bool) or value is None or isinstance(value, (str, int)):
        return value
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if hasattr(value, "as_tuple"):
        return round(float(value), 9)
    return str(value)


def normal_rows(columns: list[str], rows: list) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    shown = [tuple(plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(shown, key=lambda r: tuple((v is None, str(type(v)), str(v)) for v in r))


def compare(spark, con, query, sql: str, sf_dir: str) -> str:
    """Empty if both agree, else what differs."""
    df = query(spark, sf_dir)
    got = normal_rows(df.columns, df.collect())
    cursor = con.execute(sql)
    want = normal_rows([d[0] for d in cursor.description], cursor.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} against {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"{len(got[1])} rows against {len(want[1])}"
    wrong = [(g, w) for g, w in zip(got[1], want[1]) if g != w]
    return f"{len(wrong)} of {len(got[1])} rows differ, first {wrong[0]}" if wrong else ""


def main() -> None:
    from __spark_entry__ import oracle_sql, queries
    from maskflow.session import local_session

    args = sys.argv[1:]
    sf_dir = args[0] if args else "/root/testdata/sf0.01"
    names = args[1:]
    spark, con = local_session(8), connect(sf_dir)
    sql = oracle_sql()
    bad = 0
    for name, query in queries().items():
        if names and not any(n in name for n in names):
            continue
        start = time.time()
        try:
            if name in sql:
                problem = compare(spark, con, query, sql[name], sf_dir)
            else:
                problem = "" if query(spark, sf_dir).count() >= 0 else "?"
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        bad += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - start:.1f}s {'' if name in sql else '(no SQL)'} {problem}", flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main()
