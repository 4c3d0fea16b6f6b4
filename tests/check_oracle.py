"""Compare registered queries with their SQL at a scale: ``python tests/check_oracle.py [sf] [name …]``."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def plain(x):
    if x is None:
        return None
    if isinstance(x, float):
        return None if math.isnan(x) else x
    return x


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    table = [tuple(plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(table, key=lambda r: tuple((x is not None, str(x)) for x in r))


def compare(spark_result, sql_result) -> str | None:
    (names, left), (other, right) = spark_result, sql_result
    if names != other:
        return f"columns differ: {set(names) ^ set(other)}"
    if len(left) != len(right):
        return f"rows {len(left)} != {len(right)}"
    for a, b in zip(left, right):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            bad = [(n, x, y) for n, x, y in zip(names, a, b) if x != y or type(x) is not type(y)]
            return f"first difference {bad[:4]} in row {a[:3]}"
    return None


def main(sf: str, only: list[str]) -> int:
    import __spark_entry__ as entry
    from tests.conftest import build_session

    folder = f"/root/testdata/{sf}"
    spark, con = build_session(), connect(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    missing = set(oracles) - set(queries)
    failed = [f"no query for {m}" for m in missing]
    for name in only or queries:
        start = time.time()
        try:
            df = queries[name](spark, folder)
            found = rows_of(df.columns, [tuple(r) for r in df.collect()])
            took = time.time() - start
            note = f"{len(found[1])} rows"
            if name in oracles:
                cursor = con.execute(oracles[name])
                expected = rows_of([d[0] for d in cursor.description], cursor.fetchall())
                problem = compare(found, expected)
            else:
                problem, note = None, note + " (rows only)"
        except Exception as error:  # report and go on with the next query
            problem, took, note = f"{type(error).__name__}: {str(error)[:600]}", time.time() - start, ""
        print(f"{'FAIL' if problem else 'ok  '} {name:32s} {took:6.2f}s {note} {problem or ''}", flush=True)
        if problem:
            failed.append(name)
    print(f"{len(failed)} failed: {failed}")
    return len(failed)


if __name__ == "__main__":
    args = sys.argv[1:]
    scale = args[0] if args else "sf0.01"
    sys.exit(1 if main(scale, args[1:]) else 0)
