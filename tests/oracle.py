"""Run registered queries in Spark and their SQL in DuckDB and compare all rows and columns.

    python tests/oracle.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark"
    " labels conversations"
).split()


def connect(d: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    if hasattr(v, "to_pydatetime"):
        v = v.to_pydatetime()
    if hasattr(v, "tzinfo") and getattr(v, "tzinfo", None) is not None:
        v = v.replace(tzinfo=None)
    return v


def _key(row):
    return tuple((v is None, str(type(v)) if isinstance(v, str) else "", v if v is not None else 0) for v in row)


def rows_of(columns, rows):
    at = [columns.index(c) for c in sorted(columns)]
    return sorted((tuple(_plain(r[i]) for i in at) for r in rows), key=_key)


def compare(name, df, con, sql) -> list[str]:
    got_columns = df.columns
    got = rows_of(got_columns, [tuple(r) for r in df.collect()])
    ref = con.execute(sql)
    ref_columns = [c[0] for c in ref.description]
    want = rows_of(ref_columns, ref.fetchall())
    if sorted(got_columns) != sorted(ref_columns):
        return [f"{name}: columns {sorted(got_columns)} / {sorted(ref_columns)}"]
    if len(got) != len(want):
        return [f"{name}: {len(got)} rows / {len(want)}"]
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    return [f"{name}: {len(bad)} of {len(got)} rows differ, first {bad[0]}"] if bad else []


def main():
    import __spark_entry__ as entry

    from tarnis.session import build_session

    d = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark = build_session(
        "oracle", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"}
    )
    spark.sparkContext.setLogLevel("OFF")
    con, sql = connect(d), entry.oracle_sql()
    failed = 0
    for name, q in entry.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            if name in sql:
                problems = compare(name, q(spark, d), con, sql[name])
            else:
                n = len(q(spark, d).collect())
                problems = [] if n else [f"{name}: no rows"]
                name = f"{name} (rows {n})"
        except Exception as e:  # report and go on
            problems = [f"{name}: {type(e).__name__} {str(e)[:700]}"]
        print(f"{'FAIL' if problems else 'ok  '} {name} {time.time() - start:.1f}s", *problems, flush=True)
        failed += bool(problems)
    print("failed", failed)
    sys.exit(bool(failed))


if __name__ == "__main__":
    main()
