"""Run registered queries and their SQL counterparts side by side.

    python tests/oracle_check.py [--sf 0.01] [name-regex]
"""

from __future__ import annotations

import math
import re
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def canon(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if hasattr(value, "__float__") and not isinstance(value, str):
        value = float(value)
        if math.isnan(value):
            return "nan"
        return repr(value + 0.0)
    if isinstance(value, (list, tuple)):
        return tuple(canon(v) for v in value)
    if isinstance(value, dict):
        return tuple((k, canon(v)) for k, v in value.items())
    return str(value)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(canon(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def duck(folder: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{folder}/{name}.parquet')")
    return con


def compare(df, con, sql):
    rows = df.collect()
    got = table(df.columns, [tuple(r) for r in rows])
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = table(names, cur.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}", 0
    if len(got[1]) != len(want[1]):
        return f"rows {len(got[1])} != {len(want[1])}", 0
    if got[1] != want[1]:
        bad = [(a, b) for a, b in zip(got[1], want[1]) if a != b]
        return f"{len(bad)} of {len(got[1])} rows differ, first {got[0]}: {bad[0]}", 0
    return None, len(rows)


def main(argv):
    sf = "0.01"
    if "--sf" in argv:
        i = argv.index("--sf")
        sf = argv[i + 1]
        argv = argv[:i] + argv[i + 2 :]
    pattern = re.compile(argv[0] if argv else ".")
    from craquelure import plans
    from craquelure.session import local_session

    spark = local_session("8")
    folder = f"/root/testdata/sf{sf}"
    con = duck(folder)
    oracles = plans.oracles()
    failed = 0
    for name, fn in plans.queries().items():
        if not pattern.search(name):
            continue
        start = time.time()
        try:
            df = fn(spark, folder)
            if name in oracles:
                problem, rows = compare(df, con, oracles[name])
                n = f"{rows} rows equal" if rows else "EMPTY"
            else:
                n = f"{len(df.collect())} rows"
                problem = None
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:700]}"
            n = ""
        took = time.time() - start
        failed += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {took:6.2f}s {name} {problem or n}", flush=True)
    print(f"{failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
