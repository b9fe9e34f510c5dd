"""Runs registered queries next to their SQL twins and compares the rows."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def canonical(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return ("f", round(value, 6) + 0.0)
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(canonical(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, folder, name, query, sql):
    """None when equal, else a short description of the first difference."""
    frame = query(spark, folder)
    ours = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    theirs = rows_of(names, cursor.fetchall())
    if sorted(frame.columns) != sorted(names):
        return f"columns {sorted(frame.columns)} vs {sorted(names)}"
    if len(ours) != len(theirs):
        return f"rows {len(ours)} vs {len(theirs)}"
    for a, b in zip(ours, theirs):
        if a != b:
            return f"{a} vs {b}"
    return None if ours else "no rows"


if __name__ == "__main__":
    import __spark_entry__ as E
    from atlas.session import local_session

    folder = "/root/testdata/sf0.01"
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    wanted = [a for a in sys.argv[1:] if not a.startswith("@")]
    module = next((a[1:] for a in sys.argv[1:] if a.startswith("@")), "")
    for name, query in E.queries().items():
        if module not in query.__module__ or (wanted and not any(w in name for w in wanted)):
            continue
        start = time.time()
        try:
            sql = E.oracle_sql().get(name)
            if sql:
                result = compare(spark, con, folder, name, query, sql) or "ok"
            else:
                result = f"rows {query(spark, folder).count()} (no twin)"
        except Exception as error:  # noqa: BLE001
            result = f"ERROR {type(error).__name__} {str(error)[:600]}"
        print(f"{name:28s} {time.time() - start:6.2f}s {result}", flush=True)
