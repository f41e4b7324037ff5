"""Compare every registered query with its SQL twin: python tests/oracle.py [sf] [names...]."""
from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()
DATA = "/root/testdata"


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if hasattr(v, "as_tuple") and hasattr(v, "quantize"):
        return round(float(v), 6)
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((x is None, str(type(x)) if isinstance(x, str) else "", str(x)) for x in r))


def same(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, (int, float)) or isinstance(b, float) and isinstance(a, (int, float)):
        return abs(a - b) <= 1.01e-6
    return a == b


def compare(spark, con, sf_dir, fn, sql):
    df = fn(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if not sql:
        return f"rows={len(got)}", True
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    types = {d[0]: str(d[1]) for d in cur.description}
    want = rows_of(names, cur.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns differ: {sorted(df.columns)} vs {sorted(names)}", False
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}", False
    bad = [(g, w) for g, w in zip(got, want) if not all(same(x, y) for x, y in zip(g, w))]
    kinds = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string"}
    loose = [f"{c}:{t}/{types[c]}" for c, t in df.dtypes if types[c] in kinds and kinds[types[c]] != t or "HUGE" in types[c]
             or "DECIMAL" in types[c]]
    note = f" types {loose}" if loose else ""
    if bad:
        return f"rows={len(got)} differ={len(bad)} first={bad[0]}{note}", False
    return f"rows={len(got)} equal{note}", True


def main(argv):
    from __spark_entry__ import oracle_sql, queries
    from telltale.session import local_session
    argv = list(argv)
    sf = argv[0] if argv else "0.01"
    spark = local_session()
    sf_dir = f"{DATA}/sf{sf}"
    con = duck(sf_dir)
    sqls, failed = oracle_sql(), []
    for name, fn in queries().items():
        if len(argv) > 1 and not any(a in name for a in argv[1:]):
            continue
        start = time.time()
        try:
            text, ok = compare(spark, con, sf_dir, fn, sqls.get(name))
        except Exception as exc:  # show and go on with the next query
            text, ok = f"{type(exc).__name__}: {str(exc)[:1500]}", False
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - start:.2f}s {text}", flush=True)
        if not ok:
            failed.append(name)
    print("failed:", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
