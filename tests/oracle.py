"""Run registered queries beside their SQL and compare rows.

    python tests/oracle.py [sf] [name-prefix ...]
"""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def normal(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    if isinstance(v, (datetime.datetime, datetime.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(normal(x) for x in v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(normal(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def compare(df, con, sql):
    """Empty text when equal, else what differs."""
    sc, sr = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    dc, dr = rows_of([d[0] for d in cur.description], cur.fetchall())
    if sc != dc:
        return f"columns {sc} <> {dc}", len(sr)
    if len(sr) != len(dr):
        return f"rows {len(sr)} <> {len(dr)}; spark {sr[:2]} duck {dr[:2]}", len(sr)
    kinds_s = [next((type(r[i]) for r in sr if r[i] is not None), None) for i in range(len(sc))]
    kinds_d = [next((type(r[i]) for r in dr if r[i] is not None), None) for i in range(len(sc))]
    if kinds_s != kinds_d:
        return f"types {dict(zip(sc, kinds_s))} <> {kinds_d}", len(sr)
    bad = [(a, b) for a, b in zip(sr, dr) if repr(a) != repr(b)]
    if bad:
        return f"{len(bad)}/{len(sr)} rows differ, e.g. {sc}: spark {bad[0][0]} duck {bad[0][1]}", len(sr)
    return "", len(sr)


def main(argv):
    from __spark_entry__ import oracle_sql, queries
    from tests.conftest import build_session

    sf = argv[0] if argv else "0.01"
    prefixes = argv[1:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con, sqls = build_session(), duck(sf_dir), oracle_sql()
    failed = []
    for name, fn in queries().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        t = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in sqls:
                problem, n = compare(df, con, sqls[name])
            else:
                n, problem = len(df.collect()), ""
        except Exception as e:  # report and go on
            problem, n = f"{type(e).__name__}: {str(e)[:1500]}", 0
        print(f"{'FAIL' if problem else 'ok  '} {name:34s} {n:7d} rows {time.time() - t:6.2f}s {'' if name in sqls else '(rows only)'} {problem}", flush=True)
        if problem:
            failed.append(name)
    print(f"{len(failed)} failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
