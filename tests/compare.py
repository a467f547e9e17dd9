"""Run registered queries beside their SQL: ``python tests/compare.py <sf dir> [name ..]``."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, float, decimal.Decimal)):
        return "nan" if isinstance(v, float) and math.isnan(v) else round(float(v), 6) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def sql_rows(sf_dir, sql):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    cur = con.execute(sql)
    return rows_of([d[0] for d in cur.description], cur.fetchall())


def spark_rows(spark, sf_dir, run):
    df = run(spark, sf_dir)
    return rows_of(df.columns, [tuple(r) for r in df.collect()])


def main(argv):
    from runlore.queries import QUERIES, SQL
    from runlore.session import get_spark

    spark = get_spark(master="local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir, names = argv[0], argv[1:] or list(QUERIES)
    bad = []
    for name in names:
        started = time.time()
        try:
            got = spark_rows(spark, sf_dir, QUERIES[name])
            spent = time.time() - started
            if name not in SQL:
                print(f"{name}: {len(got[1])} rows, no SQL, {spent:.1f}s", flush=True)
                continue
            want = sql_rows(sf_dir, SQL[name])
        except Exception as e:
            bad.append(name)
            print(f"{name}: ERROR {type(e).__name__} {str(e)[:1500]}", flush=True)
            continue
        same = got == want
        print(f"{name}: {'ok' if same else 'DIFFERENT'} {len(got[1])}/{len(want[1])} rows, {spent:.1f}s", flush=True)
        if not same:
            bad.append(name)
            print("  columns", got[0], want[0])
            a, b = set(got[1]), set(want[1])
            for side, rows in (("spark", a - b), ("sql", b - a)):
                for r in sorted(rows, key=repr)[:2]:
                    print("  only", side, str(r)[:600])
    print("bad:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
