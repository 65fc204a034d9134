"""Run a registered query on Spark and its SQL on DuckDB and compare the rows."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'").fetchall()
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if value is None:
        return None
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if hasattr(value, "isoformat"):
        return value.isoformat()
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([plain(r[i]) for i in order] for r in rows), key=str)


def compare(spark, folder: str, name: str, query, sql: str | None) -> dict:
    start = time.time()
    df = query(spark, folder)
    got = [tuple(r) for r in df.collect()]
    took = time.time() - start
    out = {"name": name, "rows": len(got), "sec": round(took, 2), "ok": None}
    if sql is None:
        return out
    con = duck(folder)
    start = time.time()
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    out["duck_sec"] = round(time.time() - start, 2)
    out["want_rows"] = len(want)
    if sorted(names) != sorted(df.columns):
        out["ok"], out["why"] = False, f"columns {sorted(df.columns)} != {sorted(names)}"
        return out
    a, b = rows_of(df.columns, got), rows_of(names, want)
    out["ok"] = a == b
    if a != b:
        sa, sb = {str(r) for r in a}, {str(r) for r in b}
        left, right = sorted(sa - sb)[:3], sorted(sb - sa)[:3]
        out["why"] = f"\n   spark {left}\n   duck  {right}"
    return out


if __name__ == "__main__":
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as entry

    from storyloom.session import local_session

    scale, wanted = sys.argv[1], sys.argv[2:]
    folder = f"/root/testdata/sf{scale}"
    spark = local_session()
    registered, oracle = entry.queries(), entry.oracle_sql()
    assert set(oracle) <= set(registered), set(oracle) - set(registered)
    bad = 0
    for name, query in registered.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            result = compare(spark, folder, name, query, oracle.get(name))
        except Exception as error:  # noqa: BLE001
            result = {"name": name, "ok": False, "why": str(error)[:900], "rows": -1}
        bad += result["ok"] is False
        mark = {True: "ok  ", False: "FAIL", None: "rows"}[result["ok"]]
        print(mark, {k: v for k, v in result.items() if k not in ("ok", "why")}, result.get("why", ""), flush=True)
    print("failures:", bad)
