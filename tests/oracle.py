"""Run registered queries next to their SQL in DuckDB.

``python -m tests.oracle [sf_dir] [name ...]`` prints one line per query.
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6) + 0.0
    if hasattr(v, "as_tuple"):
        return round(float(v), 6) + 0.0
    if isinstance(v, int):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(_cell(x) for x in v)
    return str(v)


def normal_rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(_cell(r[i]) for i in order) for r in rows]
    return sorted(names), sorted(out, key=repr)


def compare(spark, con, fn, sql, sf_dir):
    """None when equal, else a text that says what differs."""
    df = fn(spark, sf_dir)
    mine = normal_rows(df.columns, df.collect())
    if sql is None:
        return None if mine[1] else "no rows"
    cur = con.execute(sql)
    theirs = normal_rows([d[0] for d in cur.description], cur.fetchall())
    if mine[0] != theirs[0]:
        return f"columns {mine[0]} != {theirs[0]}"
    if len(mine[1]) != len(theirs[1]):
        return f"rows {len(mine[1])} != {len(theirs[1])}: {mine[1][:3]} | {theirs[1][:3]}"
    for a, b in zip(mine[1], theirs[1]):
        if a != b:
            return f"{a} != {b}"
    types_duck = {d[0]: str(d[1]) for d in cur.description}
    for name, kind in df.dtypes:
        duck = types_duck[name]
        group = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}.get(kind)
        if group and group != duck:
            return f"TYPE {name}: {kind} vs {duck}"
    return None


def main(argv):
    from tests.conftest import make_session
    import __spark_entry__ as entry

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    queries, sql = entry.queries(), entry.oracle_sql()
    names = argv[1:] or list(queries)
    spark = make_session()
    con = connect(sf_dir)
    bad = 0
    for name in names:
        t = time.time()
        try:
            diff = compare(spark, con, queries[name], sql.get(name), sf_dir)
        except Exception as e:
            diff = f"{type(e).__name__}: {str(e)[:600]}"
        bad += diff is not None
        print(f"{name:28s} {time.time() - t:6.2f}s {'sql ' if name in sql else 'rows'} {'ok' if diff is None else 'DIFF ' + diff}", flush=True)
    print("different:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
