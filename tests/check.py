"""Run registered queries and their SQL side by side: ``python tests/check.py [sf] [names...]``."""

from __future__ import annotations

import math
import sys
import time

import duckdb

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    fix = lambda v: "nan" if isinstance(v, float) and math.isnan(v) else (0.0 if v == 0 and isinstance(v, float) else v)
    return sorted((tuple(repr(fix(r[i])) for i in order) for r in rows))


def compare(df, con, sql):
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = rows_of(names, cur.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns differ: {sorted(df.columns)} / {sorted(names)}", len(got)
    if got != want:
        a, b = set(got), set(want)
        return f"rows {len(got)}/{len(want)}, only spark {len(a - b)}, only sql {len(b - a)}: {sorted(a - b)[:3]} / {sorted(b - a)[:3]}", len(got)
    return "", len(got)


if __name__ == "__main__":
    import __spark_entry__ as entry
    from cuestrata.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    only = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_session()
    con = connect(sf_dir)
    qs, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if only and not any(name == o or (o.endswith("*") and name.startswith(o[:-1])) for o in only):
            continue
        t0 = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in sqls:
                err, n = compare(df, con, sqls[name])
            else:
                n, err = len(df.collect()), ""
        except Exception as e:  # noqa: BLE001
            err, n = f"{type(e).__name__}: {str(e)[:1500]}", -1
        bad += bool(err)
        print(f"{'FAIL' if err else 'ok  '} {name} rows={n} {time.time() - t0:.1f}s {'sql' if name in sqls else 'no sql'} {err}", flush=True)
    print("failures:", bad)
