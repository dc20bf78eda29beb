"""Run registered queries and their SQL and compare all values."""

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb  # noqa: E402

import __spark_entry__ as entry_module  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def database(sf_dir):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9) + 0.0
    if hasattr(value, "item"):
        return value.item()
    return value


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(
        (tuple(plain(row[i]) for i in order) for row in rows), key=lambda r: tuple(map(str, r))
    )


def compare(spark, connection, name, sf_dir):
    """Returns (rows, seconds); raises where the results differ."""
    started = time.time()
    frame = entry_module.queries()[name](spark, sf_dir)
    got = normal(frame.columns, [tuple(r) for r in frame.collect()])
    seconds = time.time() - started
    relation = connection.execute(entry_module.oracle_sql()[name])
    want = normal([d[0] for d in relation.description], relation.fetchall())
    assert got[0] == want[0], f"{name}: columns {got[0]} != {want[0]}"
    assert len(got[1]) == len(want[1]), f"{name}: {len(got[1])} rows, expected {len(want[1])}"
    for mine, theirs in zip(got[1], want[1]):
        assert mine == theirs, f"{name}:\n  got  {mine}\n  want {theirs}"
    assert want[1], f"{name}: no rows"
    return len(want[1]), seconds


if __name__ == "__main__":
    from rollcall.session import local_session

    directory = sys.argv[1]
    names = sys.argv[2:] or list(entry_module.queries())
    session = local_session()
    connection = database(directory)
    for query in names:
        try:
            rows, seconds = compare(session, connection, query, directory)
            print(f"ok   {query:24s} {rows:8d} rows {seconds:6.2f}s", flush=True)
        except Exception as problem:
            print(f"FAIL {query}: {str(problem)[:700]}", flush=True)
