"""Run registered queries next to their DuckDB oracle: names, types by kind, rows, exact values."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb  # noqa: E402

from semspace.bindings import ORACLE, QUERIES  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def _cell(x):
    if x is None:
        return "~"
    if isinstance(x, float):
        return "~" if math.isnan(x) else repr(x + 0.0)
    return str(x)


def _kind(t: str) -> str:
    t = t.lower()
    if any(n in t for n in ("int", "long")):
        return "integer"
    return "double" if "double" in t else t.replace("varchar", "string")


def _rows(table) -> list[tuple]:
    names = sorted(table.column_names)
    columns = [table[n].to_pylist() for n in names]
    return sorted(tuple(_cell(c) for c in row) for row in zip(*columns, strict=True))


def compare(name: str, spark, con, sf: str) -> tuple[bool, str]:
    start = time.time()
    df = QUERIES[name](spark, sf)
    got = df.toArrow()
    took = time.time() - start
    if name not in ORACLE:
        return got.num_rows > 0, f"{got.num_rows} rows, no oracle, {took:.1f}s"
    start = time.time()
    want = con.sql(ORACLE[name])
    types = {c: _kind(str(t)) for c, t in zip(want.columns, want.types, strict=True)}
    mine = {f.name: _kind(f.dataType.simpleString()) for f in df.schema.fields}
    want = want.to_arrow_table() if hasattr(want, "to_arrow_table") else want.arrow()
    sql_took = time.time() - start
    if types != mine:
        return False, f"schema {mine} != {types}"
    a, b = _rows(got), _rows(want)
    if a != b:
        bad = [(x, y) for x, y in zip(a, b, strict=False) if x != y][:3]
        return False, f"{len(a)} rows against {len(b)}, e.g. {bad}"
    return True, f"{len(a)} rows, {took:.1f}s (sql {sql_took:.1f}s)"


if __name__ == "__main__":
    from semspace.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or sorted(QUERIES)
    spark = build_session("oracle", "local[8]", **{"spark.ui.showConsoleProgress": "false"})
    con = connect(sf)
    failed = []
    for name in names:
        try:
            ok, note = compare(name, spark, con, sf)
        except Exception as problem:
            ok, note = False, f"{type(problem).__name__}: {str(problem)[:600]}"
        if not ok:
            failed.append(name)
        print("ok  " if ok else "FAIL", name, note, flush=True)
    print(len(names) - len(failed), "of", len(names), "pass; failed:", failed)
