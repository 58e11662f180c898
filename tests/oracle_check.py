"""Compare catalogue queries with their SQL on the given tables.

    python tests/oracle_check.py [sf_dir] [query ...]
"""

from __future__ import annotations

import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def rows_of(names: list[str], rows) -> Counter:
    order = sorted(range(len(names)), key=lambda n: names[n])
    return Counter(tuple(row[n] for n in order) for row in rows)


def compare(spark, con, sf_dir: str, query, sql: str) -> tuple[bool, str]:
    df = query(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    want = rows_of(names, cursor.fetchall())
    if sorted(names) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} / {sorted(names)}"
    if got != want:
        extra, missing = list((got - want).elements()), list((want - got).elements())
        return False, f"{len(extra)} extra, {len(missing)} missing: {extra[:2]} / {missing[:2]}"
    return True, f"{sum(got.values())} rows"


def main() -> int:
    from lexdrift.catalog import ORACLES, QUERIES
    from lexdrift.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark, con, bad = local_session(8), connect(sf_dir), 0
    for name in names:
        start = time.time()
        try:
            ok, note = compare(spark, con, sf_dir, QUERIES[name], ORACLES[name])
        except Exception as error:
            ok, note = False, f"{type(error).__name__}: {str(error)[:600]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'BAD '} {name:24} {time.time() - start:6.2f}s {note}", flush=True)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
