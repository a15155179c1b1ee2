"""Spark-vs-DuckDB comparison of registered queries (the correctness gate).

Normalizes both results the same way (columns sorted by name, floats
rounded to 6 places, arrays as tuples, rows sorted) and compares row
count, column names and values. Usable from pytest or as a script:
``python tests/oracle_compare.py [sf_dir] [name ...]``.
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if hasattr(v, "tolist") and not isinstance(v, (str, bytes)):
        v = v.tolist()
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, float):
        if math.isnan(v):
            return None
        r = round(v, 6)
        return 0.0 if r == 0 else r
    if isinstance(v, int):
        return v
    if hasattr(v, "isoformat"):
        return str(v)
    return v


_SPARK2DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "float": "FLOAT",
               "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "date": "DATE",
               "timestamp": "TIMESTAMP WITH TIME ZONE",
               "smallint": "SMALLINT", "tinyint": "TINYINT"}


def spark_type(dt) -> str:
    s = dt.simpleString()
    if s.startswith("array<"):
        return spark_type(dt.elementType) + "[]"
    return _SPARK2DUCK.get(s, s.upper())


def _rows(cols, records):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in records]
    return sorted(out, key=repr), [cols[i] for i in order]


def compare(spark, name: str, sf_dir: str, con=None) -> dict:
    from wordlake.plans import QUERIES

    q = QUERIES[name]
    t0 = time.time()
    sdf = q.build(spark, sf_dir)
    srows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    res = {"name": name, "spark_rows": len(srows), "spark_sec": round(t1 - t0, 2)}
    if not q.sql:
        res["match"] = None
        return res
    con = con or duck(sf_dir)
    cur = con.execute(q.sql)
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    s_sorted, s_cols = _rows(sdf.columns, srows)
    d_sorted, d_cols = _rows(dcols, drows)
    s_types = dict(zip(sdf.columns, [spark_type(f.dataType) for f in sdf.schema.fields]))
    d_types = dict(zip(dcols, [str(dsc[1]) for dsc in cur.description]))
    res["types_match"] = s_types == d_types
    if not res["types_match"]:
        res["type_diff"] = {c: (s_types.get(c), d_types.get(c)) for c in set(s_types) | set(d_types)
                            if s_types.get(c) != d_types.get(c)}
    res.update(duck_rows=len(drows), cols_match=s_cols == d_cols,
               values_match=s_sorted == d_sorted)
    res["match"] = res["cols_match"] and res["values_match"] and len(srows) == len(drows)
    if not res["match"]:
        res["spark_cols"], res["duck_cols"] = s_cols, d_cols
        diff_s = [r for r in s_sorted if r not in set(d_sorted)][:3]
        diff_d = [r for r in d_sorted if r not in set(s_sorted)][:3]
        res["only_spark"], res["only_duck"] = diff_s, diff_d
    return res


def main(argv):
    from wordlake.plans import QUERIES
    from wordlake.session import build_session

    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:] or sorted(QUERIES)
    spark = build_session(shuffle_partitions=8)
    con = duck(sf_dir)
    bad = 0
    for n in names:
        try:
            r = compare(spark, n, sf_dir, con)
        except Exception as e:  # report and continue
            r = {"name": n, "match": False, "error": repr(e)[:800]}
        if r.get("match") is False:
            bad += 1
        print(r, flush=True)
    print(f"mismatches: {bad} of {len(names)}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
