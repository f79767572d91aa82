"""Run registered queries and their SQL side by side: `python -m tests.oracle_check SF_DIR [names]`."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

KINDS = {
    "tinyint": "int", "smallint": "int", "int": "int", "integer": "int", "bigint": "long", "long": "long",
    "double": "double", "float": "float", "string": "string", "varchar": "string", "boolean": "bool",
}


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return v


def _table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(
        (tuple(_cell(r[i]) for i in order) for r in rows),
        key=lambda t: tuple((v is None, str(type(v)), v) if v is not None else (True, "", 0) for v in t),
    )


def compare(df, con, sql):
    """None if equal, else what differs."""
    got = [tuple(r) for r in df.collect()]
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    want = rel.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} vs {sorted(names)}"
    kinds = {d[0]: KINDS.get(str(d[1]).lower(), str(d[1]).lower()) for d in rel.description}
    mine = {n: KINDS.get(t, t) for n, t in df.dtypes}
    if kinds != mine:
        return f"types {[(n, mine[n], kinds[n]) for n in mine if mine[n] != kinds[n]]}"
    a, b = _table(df.columns, got), _table(names, want)
    if len(a) != len(b):
        return f"rows {len(a)} vs {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} of {len(a)} rows differ, e.g. {bad[:2]}" if bad else None


def main():
    from sieveline.plans import ORACLES, QUERIES
    from sieveline.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark, con = local_session(8), connect(sf_dir)
    failed = []
    for name in names:
        t = time.time()
        try:
            df = QUERIES[name](spark, sf_dir)
            if name in ORACLES:
                problem = compare(df, con, ORACLES[name])
                state = "ok" if problem is None else f"DIFF {problem}"
            else:
                n = len(df.collect())
                state, problem = f"rows {n}", None if n else "empty"
        except Exception as exc:  # report and go on with the next query
            problem = state = f"ERROR {type(exc).__name__}: {str(exc)[:600]}"
        if problem:
            failed.append(name)
        print(f"{name:28s} {time.time() - t:6.2f}s  {state}", flush=True)
    print(f"{len(names) - len(failed)}/{len(names)} fine; failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
