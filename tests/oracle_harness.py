"""Run a named Spark query and its DuckDB oracle on the same Parquet tables and compare.

Comparison: same column names, same row count, and the same multiset of rows
after sorting columns by name.  Floats compare exactly unless ``float_tol`` is set.
"""

from __future__ import annotations

import math
import sys
from collections import Counter

import duckdb

DRIVER_TABLES = ("region nation customer supplier part orders lineitem events documents "
                 "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in DRIVER_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v, float_tol):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        if float_tol:
            return round(v, float_tol)
        return v
    if hasattr(v, "item"):
        return _norm(v.item(), float_tol)
    return v


def rows_of(cols, rows, float_tol):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return Counter(tuple(_norm(r[i], float_tol) for i in order) for r in rows)


SPARK_TO_DUCK = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
                 "int": "INTEGER", "date": "DATE"}


def compare(spark_df, con, sql, float_tol=None):
    s_cols = spark_df.columns
    s_types = {f.name: SPARK_TO_DUCK.get(f.dataType.simpleString(), f.dataType.simpleString())
               for f in spark_df.schema.fields}
    s_rows = [tuple(r) for r in spark_df.collect()]
    rel = con.sql(sql)
    d_cols = rel.columns
    d_types = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    d_rows = rel.fetchall()
    problems = []
    if sorted(s_cols) != sorted(d_cols):
        problems.append(f"columns differ: spark={s_cols} duck={d_cols}")
        return problems, len(s_rows), len(d_rows)
    if s_types != d_types:
        problems.append(f"types differ: {[(c, s_types[c], d_types[c]) for c in s_cols if s_types[c] != d_types[c]]}")
    if len(s_rows) != len(d_rows):
        problems.append(f"row count spark={len(s_rows)} duck={len(d_rows)}")
    a, b = rows_of(s_cols, s_rows, float_tol), rows_of(d_cols, d_rows, float_tol)
    if a != b:
        only_s = list((a - b).elements())[:3]
        only_d = list((b - a).elements())[:3]
        problems.append(f"values differ: spark-only={only_s} duck-only={only_d}")
    return problems, len(s_rows), len(d_rows)


if __name__ == "__main__":
    sys.path.insert(0, ".")
    from basketlens.plans import catalog, oracle
    from basketlens.session import local_session

    args = [a for a in sys.argv[1:] if a != "--suite"]
    suite = "--suite" in sys.argv           # run over one RetailTables with materialized grains
    sf_dir = args[0] if args else "/root/testdata/sf0.01"
    names = args[1:] or list(catalog.registry())
    spark = local_session()
    con = duck(sf_dir)
    reg = catalog.registry()
    if suite:
        from basketlens.sources.tables import RetailTables
        shared = RetailTables.from_test_tables(spark, sf_dir)
        shared.persist_derived = True
        shared = shared.stored()
        reg = {n: (lambda s, d, _n=n: catalog.run(_n, s, d, tables=shared)) for n in reg}
    bad = 0
    for n in names:
        if n not in oracle.SQL:
            print(f"{n:32s} (no oracle) rows={reg[n](spark, sf_dir).count()}")
            continue
        probs, ns, nd = compare(reg[n](spark, sf_dir), con, oracle.SQL[n])
        print(f"{n:32s} {'OK ' if not probs else 'BAD'} rows={ns}/{nd} {'; '.join(probs)}")
        bad += bool(probs)
    print("mismatches:", bad)
