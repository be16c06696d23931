"""Runs registered queries and their SQL side by side: ``python tests/compare.py SF [name ...]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return ("", "")
    if isinstance(value, bool):
        return ("b", str(value))
    if isinstance(value, float):
        return ("f", repr(value + 0.0))
    return (type(value).__name__, str(value))


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir, name, fn, sql) -> str | None:
    """None when equal, else what differs."""
    df = fn(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    if sql is None:
        return None if df.columns else "no columns"
    con.execute(sql)
    names, want = [d[0] for d in con.description], con.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}"
    if not a:
        return "no rows on either side"
    different = [(x, y) for x, y in zip(a, b) if x != y]
    if different:
        x, y = different[0]
        return f"{len(different)} rows differ ({sorted(names)}): spark {x} sql {y}"
    return None


def main() -> None:
    import __spark_entry__ as entry
    from demospan.session import local_session

    sf_dir = f"/root/testdata/{sys.argv[1]}"
    spark, con = local_session(8), connect(sf_dir)
    fns, sqls = entry.queries(), entry.oracle_sql()
    wanted = [n for n in fns if len(sys.argv) < 3 or any(w in n for w in sys.argv[2:])]
    bad = 0
    for name in wanted:
        at = time.time()
        try:
            said = compare(spark, con, sf_dir, name, fns[name], sqls.get(name))
        except Exception as e:  # noqa: BLE001 - report and go on with the next query
            said = f"{type(e).__name__}: {str(e)[:700]}"
        bad += said is not None
        print(f"{'ok  ' if said is None else 'BAD '} {time.time() - at:5.1f}s {name} {'' if name in sqls else '(rows only)'} {said or ''}", flush=True)
    print(f"{len(wanted) - bad} of {len(wanted)} ok")


if __name__ == "__main__":
    main()
