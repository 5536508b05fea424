"""Run registered queries against their DuckDB SQL: python -m tests.check [sf] [name-part ...]."""

import sys
import time

import duckdb

sys.path.insert(0, __file__.rsplit("/", 2)[0])
from ampliq.catalog.fixtures import BASE  # noqa: E402
from ampliq.session import local_session  # noqa: E402


def duck(sf_dir):
    con = duckdb.connect()
    for t in BASE:
        con.execute(f"create view {t} as from '{sf_dir}/{t}.parquet'").fetchall()
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return "nan" if v != v else v + 0.0
    if isinstance(v, int):
        return float(v)
    return str(v)


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(repr(norm(r[i])) for i in order) for r in data)


def compare(spark, con, name, fn, sql, sf_dir):
    t = time.time()
    df = fn(spark, sf_dir)
    got = df.collect()
    t_spark = time.time() - t
    bad = [f.name for f in df.schema.fields if f.dataType.typeName() in ("array", "map", "struct", "decimal")]
    if bad:
        return False, f"{name}: unsuitable types in {bad}"
    if sql is None:
        return True, f"{name}: rows {len(got)} spark {t_spark:.1f}s (no sql)"
    t = time.time()
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    t_duck = time.time() - t
    note = f"{name}: rows {len(got)} spark {t_spark:.1f}s duck {t_duck:.1f}s"
    if sorted(names) != sorted(df.columns):
        return False, f"{note} COLUMNS {sorted(df.columns)} vs {sorted(names)}"
    a, b = rows(df.columns, got), rows(names, want)
    if a != b:
        sa, sb = set(a), set(b)
        return False, f"{note} vs {len(b)} DIFF\n   cols {sorted(names)}\n   spark {[r for r in a if r not in sb][:2]}\n   duck  {[r for r in b if r not in sa][:2]}"
    return True, note


def main():
    import __spark_entry__ as e

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    parts = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_session(8)
    con = duck(sf_dir)
    q, o = e.queries(), e.oracle_sql()
    failed = []
    for name, fn in q.items():
        if parts and not any(p in name for p in parts):
            continue
        try:
            ok, note = compare(spark, con, name, fn, o.get(name), sf_dir)
        except Exception as exc:  # show the failure and go on
            ok, note = False, f"{name}: {type(exc).__name__} {str(exc)[:1500]}"
            con = duck(sf_dir)
        print(("ok   " if ok else "FAIL ") + note, flush=True)
        if not ok:
            failed.append(name)
    print("failed:", failed)


if __name__ == "__main__":
    main()
