"""Compare registered queries with their checking SQL.

    python tests/compare.py [--sf DIR] [name ...]
"""

from __future__ import annotations

import math
import pathlib
import sys
import time

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

import duckdb

from proofloom.plans import ORACLES, QUERIES, tables
from proofloom.session import build_session


def canonical(value):
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else f"{value:.6g}"
    if hasattr(value, "isoformat"):
        return value.isoformat()
    if hasattr(value, "is_integer") or value.__class__.__name__ == "Decimal":
        return f"{float(value):.6g}" if value.__class__.__name__ == "Decimal" else value
    return value


def rows_of(rows):
    return sorted(repr(tuple(canonical(v) for v in r)) for r in rows)


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in tables.BASE:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def check(spark, con, sf_dir: str, name: str):
    """(ok, message) for one query."""
    start = time.time()
    df = QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = rows_of(df.select(*[df[c] for c in cols]).collect())
    took = time.time() - start
    if name not in ORACLES:
        return True, f"{name}: rows only, {len(got)} rows, {took:.1f}s"
    start = time.time()
    rel = con.execute(ORACLES[name])
    names = [d[0] for d in rel.description]
    if sorted(names) != cols:
        return False, f"{name}: columns {cols} vs {sorted(names)}"
    order = [names.index(c) for c in cols]
    want = rows_of([tuple(r[i] for i in order) for r in rel.fetchall()])
    sql_took = time.time() - start
    if got == want:
        return True, f"{name}: {len(got)} rows equal, {took:.1f}s, sql {sql_took:.1f}s"
    a, b = set(got), set(want)
    only_a, only_b = sorted(a - b)[:2], sorted(b - a)[:2]
    return False, (f"{name}: DIFFERENT spark {len(got)} sql {len(want)} (cols {cols})\n"
                   + "\n".join(f"   spark {x[:600]}" for x in only_a) + "\n"
                   + "\n".join(f"   sql   {x[:600]}" for x in only_b))


def main(argv: list[str]) -> int:
    sf_dir = "/root/testdata/sf0.001"
    if argv[:1] == ["--sf"]:
        sf_dir, argv = argv[1], argv[2:]
    spark = build_session(master="local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sf_dir)
    chosen = [n for n in QUERIES if not argv or any(n.startswith(a) for a in argv)]
    bad = 0
    for name in chosen:
        try:
            ok, message = check(spark, con, sf_dir, name)
        except Exception as e:  # report and go on
            ok, message = False, f"{name}: {type(e).__name__} {str(e)[:700]}"
        bad += not ok
        print(("ok   " if ok else "FAIL ") + message, flush=True)
    print(f"{len(chosen)} queries, {bad} failed")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
