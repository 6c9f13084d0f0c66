"""Run registered queries beside their DuckDB SQL and compare the rows."""

from __future__ import annotations

import argparse
import datetime
import math
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf: str):
    con = duckdb.connect()
    con.execute("set TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def _cell(v):
    if v is None:
        return "∅"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "∅"
        return repr(v)
    if isinstance(v, int):
        return str(v)
    if isinstance(v, (datetime.date, datetime.datetime)):
        return v.isoformat()[:19]
    return str(v)


def rows_of(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in records)


def check(spark, con, name, fn, sql, sf):
    started = time.time()
    df = fn(spark, sf)
    got = [tuple(r) for r in df.collect()]
    took = time.time() - started
    result = {"rows": len(got), "sec": round(took, 2), "status": "rows-only"}
    if sql is None:
        return result
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    types = {d[0]: str(d[1]) for d in cursor.description}
    want = cursor.fetchall()
    gc, gr = rows_of(df.columns, got)
    wc, wr = rows_of(columns, want)
    if gc != wc:
        return result | {"status": "COLUMNS", "detail": f"{gc} != {wc}"}
    loose = {"double": "DOUBLE", "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE"}
    bad_types = [f"{c}: {t} vs {types[c]}" for c, t in df.dtypes if loose.get(t, t) != types[c]]
    if len(gr) != len(wr):
        return result | {"status": "ROWS", "detail": f"{len(gr)} != {len(wr)}"}
    diffs = [(a, b) for a, b in zip(gr, wr) if a != b]
    if diffs:
        return result | {"status": "VALUES", "detail": f"{len(diffs)} differ: {gc} {diffs[:3]}"}
    return result | ({"status": "TYPES", "detail": "; ".join(bad_types)} if bad_types else {"status": "ok"})


def main():
    from checks import all_queries
    from stratafin.session import local_session

    p = argparse.ArgumentParser()
    p.add_argument("--sf", default="/root/testdata/sf0.01")
    p.add_argument("names", nargs="*")
    args = p.parse_args()
    queries, oracles = all_queries()
    spark = local_session("checks")
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(args.sf)
    bad = 0
    for name, fn in queries.items():
        if args.names and not any(n in name for n in args.names):
            continue
        try:
            r = check(spark, con, name, fn, oracles.get(name), args.sf)
        except Exception as e:  # noqa: BLE001
            r = {"status": "ERROR", "rows": -1, "sec": -1, "detail": f"{type(e).__name__}: {str(e)[:900]}"}
        if r["status"] not in ("ok", "rows-only"):
            bad += 1
        print(f"{r['status']:10} {name:40} rows={r['rows']} {r['sec']}s {r.get('detail', '')}", flush=True)
    print("bad", bad)


if __name__ == "__main__":
    main()
