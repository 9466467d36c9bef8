"""Compare the named queries with their SQL: ``python tests/check_oracles.py [sf_dir] [names...]``."""

from __future__ import annotations

import math
import sys
import time
from decimal import Decimal
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(
            f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')"
        )
    return connection


def plain(value):
    if isinstance(value, Decimal):
        return int(value) if value == value.to_integral_value() else float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return 0.0 if value == 0 else value
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, (bytearray, memoryview)):
        return bytes(value)
    return value


def normalised(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    table = [tuple(plain(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(table, key=repr)


def compare(spark, connection, query, text, folder):
    """An empty list when both sides agree, else what differs."""
    frame = query(spark, folder)
    ours = normalised(frame.columns, [tuple(r) for r in frame.collect()])
    result = connection.execute(text)
    theirs = normalised([d[0] for d in result.description], result.fetchall())
    if ours[0] != theirs[0]:
        return [f"columns {ours[0]} vs {theirs[0]}"]
    if len(ours[1]) != len(theirs[1]):
        return [f"{len(ours[1])} rows vs {len(theirs[1])}"]
    bad = [(a, b) for a, b in zip(ours[1], theirs[1], strict=True) if repr(a) != repr(b)]
    return [f"{len(bad)} of {len(ours[1])} rows differ, e.g. {bad[0]}"] if bad else []


def main() -> int:
    import __spark_entry__ as entry
    from tidewatch.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    queries, oracles = entry.queries(), entry.oracle_sql()
    names = sys.argv[2:] or list(queries)
    spark = local_session()
    spark.sparkContext.setLogLevel("OFF")
    connection = connect(folder)
    failed = 0
    for name in names:
        started = time.time()
        try:
            if name in oracles:
                problems = compare(spark, connection, queries[name], oracles[name], folder)
            else:
                rows = queries[name](spark, folder).collect()
                problems = [] if rows else ["no rows"]
        except Exception as error:  # noqa: BLE001 - report every query
            problems = [f"{type(error).__name__}: {str(error)[:600]}"]
        mark = "ok  " if not problems else "FAIL"
        kind = "sql" if name in oracles else "rows"
        print(f"{mark} {kind:4} {time.time() - started:6.2f}s {name} {' '.join(problems)}",
              flush=True)
        failed += bool(problems)
    print(f"{len(names) - failed} of {len(names)} agree")
    return 1 if failed else 0


if __name__ == "__main__":
    raise SystemExit(main())
