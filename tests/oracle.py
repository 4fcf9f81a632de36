"""Runs registered queries against their checking SQL on DuckDB."""

from __future__ import annotations

import math
import sys
import time
import traceback

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _key(value):
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    return value


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted((tuple(_key(r[c]) for c in names) for r in df.collect()), key=repr)


def duck_rows(con, sql):
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    names = sorted(columns)
    order = [columns.index(c) for c in names]
    return names, sorted((tuple(_key(r[i]) for i in order) for r in result.fetchall()), key=repr)


def compare(df, con, sql) -> str | None:
    """None if equal, else what differs first."""
    names, got = spark_rows(df)
    expected_names, expected = duck_rows(con, sql)
    if names != expected_names:
        return f"columns {names} != {expected_names}"
    if len(got) != len(expected):
        return f"rows {len(got)} != {len(expected)}\n  spark {got[:2]}\n  duck  {expected[:2]}"
    for a, b in zip(got, expected):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return f"\n  spark {str(a)[:900]}\n  duck  {str(b)[:900]}\n  types {[type(x).__name__ for x in a]} {[type(x).__name__ for x in b]}"
    return None


def main() -> int:
    from toolmill.plans import ORACLES, QUERIES
    from toolmill.session import build_session

    folder = sys.argv[1]
    wanted = sys.argv[2:]
    spark = build_session(master="local[8]", partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    for name, fn in QUERIES.items():
        if wanted and not any(name == w or name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            df = fn(spark, folder)
            if name in ORACLES:
                problem = compare(df, con, ORACLES[name])
                rows = ""
            else:
                rows, problem = f" rows {df.count()} (no SQL)", None
        except Exception:
            problem, rows = "".join(traceback.format_exc()[-1500:]), ""
        bad += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - start:.1f}s{rows}" + (f": {problem}" if problem else ""), flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
