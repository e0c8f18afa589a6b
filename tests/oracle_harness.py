"""Spark result vs DuckDB oracle, the way the round driver compares them.

Row count, column names (sorted) and an order-insensitive hash of the values.
Values are normalised the same way on both sides: floats rounded to 6
decimals, everything else by ``str``; NULL stays NULL.
"""

from __future__ import annotations

import hashlib
import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = Path(sf_dir) / f"{t}.parquet"
        if p.exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(str(_norm(x)) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{_norm(x)}" for k, x in sorted(v.items())) + "}"
    if hasattr(v, "asDict"):
        return _norm(v.asDict())
    return str(v)


def digest(columns: list[str], rows: list[tuple]) -> str:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    lines = sorted("\x1f".join(str(_norm(r[i])) for i in order) for r in rows)
    h = hashlib.sha256()
    for line in lines:
        h.update(line.encode())
        h.update(b"\n")
    return h.hexdigest()


def compare(spark, name: str, fn, sql: str | None, sf_dir: str, con=None) -> dict:
    t0 = time.time()
    df = fn(spark, sf_dir)
    cols = df.columns
    rows = [tuple(r) for r in df.collect()]
    t1 = time.time()
    res = {"query": name, "rows": len(rows), "spark_sec": round(t1 - t0, 2)}
    if sql is None:
        res["status"] = "rows-only"
        return res
    con = con or duck(sf_dir)
    rel = con.sql(sql)
    ocols = rel.columns
    orows = rel.fetchall()
    res["oracle_rows"] = len(orows)
    same_cols = sorted(cols) == sorted(ocols)
    res["columns_match"] = same_cols
    if not same_cols:
        res["status"] = "schema-mismatch"
        res["spark_cols"] = sorted(cols)
        res["oracle_cols"] = sorted(ocols)
        return res
    ok = len(rows) == len(orows) and digest(cols, rows) == digest(ocols, orows)
    res["status"] = "match" if ok else "value-mismatch"
    if not ok:
        a = {"\x1f".join(str(_norm(r[sorted(range(len(cols)), key=lambda i: cols[i])[j]])) for j in range(len(cols))) for r in rows}
        b = {"\x1f".join(str(_norm(r[sorted(range(len(ocols)), key=lambda i: ocols[i])[j]])) for j in range(len(ocols))) for r in orows}
        res["only_spark"] = sorted(a - b)[:3]
        res["only_oracle"] = sorted(b - a)[:3]
    return res


def main(argv: list[str]) -> int:
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as E
    from sitesieve.session import local_session

    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    only = set(argv[2:])
    spark = local_session()
    con = duck(sf_dir)
    qs = E.queries()
    sqls = E.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if only and name not in only:
            continue
        try:
            r = compare(spark, name, fn, sqls.get(name), sf_dir, con)
        except Exception as e:  # report and go on
            r = {"query": name, "status": "error", "error": f"{type(e).__name__}: {str(e)[:400]}"}
        if r["status"] not in ("match", "rows-only"):
            bad += 1
        print(r, flush=True)
    print(f"{len(qs) if not only else len(only)} queries, {bad} not matching")
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main(sys.argv))
