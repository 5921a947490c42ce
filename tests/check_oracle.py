"""Run every registered query next to its SQL and compare names, types and values.

    python tests/check_oracle.py [sf_dir] [name-substring ...]
"""

from __future__ import annotations

import datetime as dt
import importlib.util
import pathlib
import sys
import time

import duckdb

ROOT = pathlib.Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def load_entry():
    spec = importlib.util.spec_from_file_location("spark_entry", ROOT / "__spark_entry__.py")
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    return mod


def canon(value):
    if isinstance(value, float):
        return round(value, 9)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None)
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(canon(r[i]) for i in order) for r in rows), key=lambda r: tuple((v is None, str(v)) for v in r))


KIND = {"bigint": "int", "int": "int", "BIGINT": "int", "INTEGER": "int", "HUGEINT": "huge", "string": "str",
        "VARCHAR": "str", "double": "float", "DOUBLE": "float", "boolean": "bool", "BOOLEAN": "bool",
        "timestamp": "ts", "timestamp_ntz": "ts", "TIMESTAMP": "ts", "date": "date", "DATE": "date"}


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET threads TO 8")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def compare(spark, con, name, query, sql, sf_dir):
    t = time.time()
    df = query(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    took = time.time() - t
    if sql is None:
        return "rows-only", len(got), took, 0.0, ""
    t = time.time()
    cur = con.execute(sql)
    cols = [(d[0], str(d[1])) for d in cur.description]
    want = cur.fetchall()
    sql_took = time.time() - t
    names = df.columns
    if sorted(names) != sorted(c for c, _ in cols):
        return "columns", len(got), took, sql_took, f"{sorted(names)} vs {sorted(c for c, _ in cols)}"
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    off = [(c, types[c], t) for c, t in cols if KIND.get(types[c], types[c]) != KIND.get(t, t)]
    if off:
        return "types", len(got), took, sql_took, str(off)
    a, b = rows_of(names, got), rows_of([c for c, _ in cols], want)
    if a != b:
        gone = [r for r in b if r not in set(a)][:2]
        extra = [r for r in a if r not in set(b)][:2]
        return "values", len(got), took, sql_took, f"{len(a)} vs {len(b)} rows\n   {sorted(names)}\n   only sql   {gone}\n   only spark {extra}"
    return "ok", len(got), took, sql_took, ""


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    from partsmith.session import build_session

    entry = load_entry()
    spark = build_session("check")
    con = connect(sf_dir)
    sqls = entry.oracle_sql()
    bad = 0
    for name, query in entry.queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        try:
            verdict, n, took, sql_took, note = compare(spark, con, name, query, sqls.get(name), sf_dir)
        except Exception as e:  # noqa: BLE001 - report every query
            verdict, n, took, sql_took, note = "error", 0, 0.0, 0.0, f"{type(e).__name__}: {str(e)[:350]}"
        bad += verdict not in ("ok", "rows-only")
        flag = " EMPTY" if n == 0 else ""
        print(f"{verdict:10s} {name:28s} rows={n:<7d} spark={took:6.2f}s sql={sql_took:6.2f}s{flag} {note}", flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main()
