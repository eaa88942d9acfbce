"""Runs registered queries next to their SQL: ``python tests/oracle.py SF [name ...]``."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

_TYPES = {"int": "INTEGER", "bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE",
          "boolean": "BOOLEAN"}


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[:-len(".parquet")]
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _key(row):
    return tuple((v is None, str(v)) for v in row)


def _same(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return a == b or (math.isnan(a) and math.isnan(b))
    return a == b and type(a) is type(b)


def compare(df, con, sql: str) -> list[str]:
    """Differences in columns, types, row count and values; empty if equal."""
    rel = con.sql(sql)
    cols = sorted(df.columns)
    if cols != sorted(rel.columns):
        return [f"columns {cols} vs {sorted(rel.columns)}"]
    problems = []
    duck_types = dict(zip(rel.columns, map(str, rel.types)))
    for name, kind in df.dtypes:
        if _TYPES.get(kind, kind) != duck_types[name]:
            problems.append(f"type of {name}: {kind} vs {duck_types[name]}")
    mine = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=_key)
    order = [rel.columns.index(c) for c in cols]
    theirs = sorted((tuple(r[i] for i in order) for r in rel.fetchall()), key=_key)
    if len(mine) != len(theirs):
        problems.append(f"rows {len(mine)} vs {len(theirs)}")
    bad = [(a, b) for a, b in zip(mine, theirs) if not all(map(_same, a, b))]
    if bad:
        problems.append(f"{len(bad)} rows differ, first {str(bad[0])[:600]}")
    return problems


if __name__ == "__main__":
    from tests.conftest import make_session
    import __spark_entry__ as entry

    spark = make_session()
    sf = f"/root/testdata/sf{sys.argv[1]}"
    con = duck(sf)
    names = sys.argv[2:] or list(entry.queries())
    for name in names:
        start = time.time()
        try:
            df = entry.queries()[name](spark, sf)
            if name in entry.oracle_sql():
                out = compare(df, con, entry.oracle_sql()[name]) or "ok"
            else:
                out = f"{len(df.collect())} rows"
        except Exception as e:  # report and go on
            out = f"{type(e).__name__} {str(e)[:1500]}"
        print(f"{name:28} {time.time() - start:6.1f}s  {out}", flush=True)
