"""Run queries in Spark and DuckDB on the same folder and compare the rows.

    python -m verification.compare [folder] [query ...]
"""

import glob
import math
import os
import sys
import time

import duckdb

from basketry import storage
from verification.oracle import ORACLE
from verification.queries import QUERIES


def database(folder):
    db = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return db


def _cell(value):
    if isinstance(value, float):
        return "null" if math.isnan(value) else repr(value)
    return "null" if value is None else str(value)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, db, folder, name):
    """None if equal, otherwise a short account of the difference. Rows are compared as a bag."""
    df = QUERIES[name](spark, folder)
    ours = _rows(df.columns, df.collect())
    cursor = db.execute(ORACLE[name])
    theirs = _rows([c[0] for c in cursor.description], cursor.fetchall())
    if ours == theirs:
        return None
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} / {theirs[0]}"
    only_ours = [r for r in ours[1] if r not in set(theirs[1])][:2]
    only_theirs = [r for r in theirs[1] if r not in set(ours[1])][:2]
    return f"rows {len(ours[1])} / {len(theirs[1])}, only ours {only_ours}, only theirs {only_theirs}"


def main():
    from tests.session import session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark, db, bad = session(), database(folder), []
    for name in names:
        start = time.time()
        with storage.scope(spark):
            if name in ORACLE:
                problem = compare(spark, db, folder, name)
            else:
                problem = None if QUERIES[name](spark, folder).count() else "no rows"
        bad += [name] if problem else []
        print(f"{name}: {problem or 'ok'} ({time.time() - start:.1f}s)", flush=True)
    print(f"{len(names) - len(bad)} of {len(names)} equal")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
