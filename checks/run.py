"""Compare every registered query with its SQL: ``python -m checks.run [sf_dir] [name-part…]``."""

from __future__ import annotations

import math
import sys
import time

import duckdb

from checks.views import TABLES
from pkgrisk.session import local_session


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if hasattr(v, "as_tuple"):  # Decimal
        return round(float(v), 6)
    return v


def normal(cols: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return [cols[i] for i in order], sorted(out, key=repr)


def oracle_rows(con, sql: str):
    cur = con.execute(sql)
    return normal([d[0] for d in cur.description], cur.fetchall())


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def spark_rows(df):
    return normal(df.columns, [tuple(r) for r in df.collect()])


def compare(spark, con, sf_dir: str, name: str, fn, sql: str | None) -> str:
    t0 = time.time()
    cols, rows = spark_rows(fn(spark, sf_dir))
    took = time.time() - t0
    if sql is None:
        return f"rows-only {len(rows)} rows {took:.1f}s"
    ocols, orows = oracle_rows(con, sql)
    if cols != ocols:
        return f"MISMATCH columns {cols} vs {ocols}"
    if rows != orows:
        diff = next(((a, b) for a, b in zip(rows, orows) if a != b), (None, None))
        return f"MISMATCH {len(rows)} vs {len(orows)} rows; first {str(diff)[:700]}"
    kinds = {
        c: (type(a).__name__, type(b).__name__)
        for r, o in zip(rows[:200], orows[:200]) for c, a, b in zip(cols, r, o)
        if a is not None and b is not None and type(a) is not type(b)
    }
    extra = f" TYPES {kinds}" if kinds else ""
    return f"ok {len(rows)} rows {took:.1f}s{extra}" + (" EMPTY" if not rows else "")


def main() -> int:
    from checks import all_checks

    args = sys.argv[1:]
    sf_dir = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    parts = [a for a in args if not a.startswith("/")]
    spark, con = local_session(), connect(sf_dir)
    bad = 0
    for name, fn in all_checks.QUERIES.items():
        if parts and not any(p in name for p in parts):
            continue
        try:
            result = compare(spark, con, sf_dir, name, fn, all_checks.ORACLES.get(name))
        except Exception as e:  # report and go on
            result = f"ERROR {type(e).__name__} {str(e)[:600]}"
        bad += result.startswith(("MISMATCH", "ERROR"))
        print(f"{name:28s} {result}", flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
