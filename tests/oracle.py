"""Compares a query's rows with what DuckDB makes of its SQL over the same tables."""

from __future__ import annotations

import glob
import os
from collections import Counter

import duckdb

#: The tables that queries are compared on.
TABLES = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


def plain(value):
    if isinstance(value, float):
        return "nan" if value != value else round(value, 6) + 0.0
    if isinstance(value, list | tuple):
        return tuple(map(plain, value))
    return value if value is None or isinstance(value, str | bytes | int) else str(value)


def counted(rows, columns) -> Counter:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def duck_rows(sql: str, sf_dir: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    found = con.execute(sql)
    return [c[0] for c in found.description], found.fetchall()


def check(spark, query, sql: str, sf_dir: str = TABLES) -> int:
    """Fails where the rows differ; gives their number."""
    got = query(spark, sf_dir)
    columns, want = duck_rows(sql, sf_dir)
    assert sorted(got.columns) == sorted(columns)
    ours, theirs = counted(got.collect(), got.columns), counted(want, columns)
    assert ours == theirs, f"{(ours - theirs).total()} rows of ours and {(theirs - ours).total()} of the SQL's differ, such as {list((ours - theirs).items())[:2]} and {list((theirs - ours).items())[:2]}"
    return ours.total()
