"""Run registered queries next to their SQL and compare names, types and values.

    python tests/compare.py [sf_dir] [query ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if value is None or value is pd.NaT or value is pd.NA or (isinstance(value, float) and math.isnan(value)):
        return ""
    return str(float(value)) if isinstance(value, float) else str(value)


def rows(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(map(_plain, row)) for row in frame.itertuples(index=False))


def difference(found: pd.DataFrame, expected: pd.DataFrame) -> str | None:
    """What differs first, or None."""
    if sorted(found.columns) != sorted(expected.columns):
        return f"columns {sorted(found.columns)} != {sorted(expected.columns)}"
    if len(found) != len(expected):
        return f"rows {len(found)} != {len(expected)}"
    types = {
        c: (found[c].dtype.kind, expected[c].dtype.kind)
        for c in found.columns
        if found[c].dtype != expected[c].dtype
        and not expected[c].isna().all()  # null throughout: pandas picks some type
        and not {found[c].dtype.kind, expected[c].dtype.kind} <= {"O", "U", "T"}
    }
    left, right = rows(found), rows(expected)
    for a, b in zip(left, right, strict=True):
        if a != b:
            return f"{a} != {b}"[:1500]
    return f"types {types}" if types else None


def main() -> None:
    from conftest import make_session

    import __spark_entry__ as entry

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark, con = make_session(), database(sf_dir)
    sql = entry.oracle_sql()
    bad = []
    for name, run in entry.queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            found = run(spark, sf_dir).toPandas()
            seconds = time.time() - start
            result = "rows only" if name not in sql else None
            start = time.time()
            if name in sql:
                result = difference(found, con.execute(sql[name]).df())
        except Exception as error:  # noqa: BLE001
            seconds, result, found = 0.0, f"{type(error).__name__}: {str(error)[:1500]}", []
        good = result in (None, "rows only")
        if not good:
            bad.append(name)
        print(
            f"{'ok ' if good else 'BAD'} {name:28s} {seconds:6.2f}s "
            f"sql {time.time() - start:5.2f}s {len(found):7d} {result or ''}",
            flush=True,
        )
    print("different:", bad)


if __name__ == "__main__":
    main()
