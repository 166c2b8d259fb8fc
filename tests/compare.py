"""Run registered queries on Spark and their SQL on DuckDB over one data folder and compare rows exactly."""

from __future__ import annotations

import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple("" if r[i] is None else repr(r[i] + 0.0 if isinstance(r[i], float) else r[i]) for i in order) for r in rows]
    return [names[i] for i in order], sorted(out)


SPARK_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE", "boolean": "BOOLEAN"}


def compare(spark, con, query, sql, sf_dir):
    """Returns (ok, message)."""
    df = query(spark, sf_dir)
    schema = {f.name: SPARK_TYPES.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema}
    names, rows = canonical(df.columns, [tuple(r) for r in df.collect()])
    rel = con.sql(sql)
    other = dict(zip(rel.columns, map(str, rel.types)))
    names2, rows2 = canonical(list(rel.columns), rel.fetchall())
    if names != names2:
        return False, f"columns {names} / {names2}"
    types = {n: (schema[n], other[n]) for n in names if schema[n] != other[n]}
    if rows != rows2:
        have, want = set(rows), set(rows2)
        a, b = [r for r in rows if r not in want], [r for r in rows2 if r not in have]
        return False, f"{len(rows)}/{len(rows2)} rows, {len(a)} differ: {names} {a[:3]} {b[:3]} types {types}"
    return True, f"{len(rows)} rows" + (f" types {types}" if types else "")


if __name__ == "__main__":
    sys.path.insert(0, ".")
    import __spark_entry__ as e
    from creditladder.session import local_session

    sf_dir = sys.argv[1]
    only = sys.argv[2:]
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connection(sf_dir)
    oracle = e.oracle_sql()
    bad = 0
    for name, q in e.queries().items():
        if only and not any(name.startswith(o) for o in only):
            continue
        t = time.time()
        try:
            ok, msg = compare(spark, con, q, oracle[name], sf_dir) if name in oracle else (True, f"rows only {q(spark, sf_dir).count()}")
        except Exception as err:  # noqa: BLE001
            ok, msg = False, f"{type(err).__name__}: {str(err)[:1500]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - t:.1f}s {msg}", flush=True)
    print("failures:", bad)
