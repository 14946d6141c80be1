"""Run registered queries on Spark and DuckDB over the same tables and compare them.

usage: python tools/check_oracle.py [--sf DIR] [--new] [name-substring ...]
"""

from __future__ import annotations

import argparse
import math
import sys
import time
import traceback
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def canon(value):
    if value is None:
        return "∅"
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(value + 0.0)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(canon(v) for v in value) + "]"
    if isinstance(value, dict):
        return "{" + ",".join(f"{k}:{canon(v)}" for k, v in sorted(value.items())) + "}"
    return str(value)


def same(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return a == b or abs(a - b) <= 1e-9 * max(abs(a), abs(b), 1.0)
    return canon(a) == canon(b)


def type_class(name: str) -> str:
    name = name.lower()
    if name.startswith(("int", "bigint", "long", "hugeint", "smallint", "ubigint")):
        return name if name in ("int", "integer", "bigint", "hugeint") else name
    return name


def compare(spark_df, con, sql: str) -> tuple[bool, str]:
    cols = sorted(spark_df.columns)
    got = [tuple(r) for r in spark_df.select(*[f"`{c}`" for c in cols]).collect()]
    rel = con.sql(sql)
    dcols = sorted(rel.columns)
    if cols != dcols:
        return False, f"columns {cols} vs {dcols}"
    quoted = ", ".join(f'"{c}"' for c in cols)
    rel = con.sql(f"SELECT {quoted} FROM ({sql}) q")
    types = dict(zip(rel.columns, [str(t) for t in rel.types]))
    want = rel.fetchall()
    notes = []
    spark_types = dict(spark_df.dtypes)
    alias = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    for c in cols:
        exp = alias.get(spark_types[c])
        if exp and exp != types[c]:
            notes.append(f"type {c}: {spark_types[c]} vs {types[c]}")
    if len(got) != len(want):
        return False, f"rows {len(got)} vs {len(want)}; {notes}"
    ks = lambda r: tuple(canon(round(v, 5) if isinstance(v, float) and math.isfinite(v) else v) for v in r)
    got.sort(key=ks)
    want.sort(key=ks)
    exact = 0
    for g, w in zip(got, want):
        if all(canon(a) == canon(b) for a, b in zip(g, w)):
            exact += 1
        elif not all(same(a, b) for a, b in zip(g, w)):
            return False, f"row {dict(zip(cols, g))} vs {dict(zip(cols, w))}; {notes}"
    note = f"{len(got)} rows" + ("" if exact == len(got) else f" ({len(got) - exact} rows differ in last digits)")
    return not notes and exact == len(got), note + ("; " + "; ".join(notes) if notes else "")


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--spark-only", action="store_true")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    from chartloom.plans.registry import all_queries
    from chartloom.session import build_session

    spark = build_session(
        "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(args.sf)
    bad = 0
    for name, q in all_queries().items():
        if args.names and not any(n in name or n in q.covers for n in args.names):
            continue
        start = time.time()
        try:
            df = q.plan(spark, args.sf)
            if q.sql is None or args.spark_only:
                n = len(df.collect())
                ok, note = True, f"{n} rows (no SQL)"
            else:
                ok, note = compare(df, con, q.sql)
        except Exception as exc:  # noqa: BLE001
            ok, note = False, f"{type(exc).__name__}: {str(exc)[:1500]}"
            if "AnalysisException" not in type(exc).__name__ and "duckdb" not in type(exc).__module__:
                traceback.print_exc(limit=-3)
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:42s} {time.time() - start:6.2f}s  {note}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
