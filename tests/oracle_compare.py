"""Run a Spark query and its DuckDB oracle on the same tables and compare.

Mirrors the driver's gate: row count, column names, and an
order-insensitive hash of the values with columns sorted by name.
"""

from __future__ import annotations

import datetime as dt
import decimal
import hashlib
import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v + 0.0, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, bool):
        return v
    if isinstance(v, int):
        return v
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return [_norm(x) for x in v]
    if hasattr(v, "asDict"):
        return {k: _norm(x) for k, x in v.asDict().items()}
    if isinstance(v, dict):
        return {k: _norm(x) for k, x in v.items()}
    return v


def digest(columns: list[str], rows: list[tuple]) -> tuple[int, str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    lines = sorted(repr([_norm(r[i]) for i in order]) for r in rows)
    return len(lines), hashlib.sha256("\n".join(lines).encode()).hexdigest()


_SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
                  "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP",
                  "smallint": "SMALLINT", "float": "FLOAT"}


def spark_type_as_duck(t: str) -> str:
    if t.startswith("decimal"):
        return t.upper().replace(" ", "")
    return _SPARK_TO_DUCK.get(t, t.upper())


def type_mismatches(sdf, con, sql: str) -> dict:
    duck_types = {r[0]: r[1].replace(" ", "") for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    out = {}
    for name, t in sdf.dtypes:
        want = duck_types.get(name)
        if want is not None and spark_type_as_duck(t) != want:
            out[name] = (t, want)
    return out


def compare(spark, con, sf_dir: str, query, sql: str) -> dict:
    sdf = query(spark, sf_dir)
    s_cols = sdf.columns
    s_rows = [tuple(r) for r in sdf.collect()]
    rel = con.execute(sql)
    d_cols = [c[0] for c in rel.description]
    d_rows = rel.fetchall()
    s_n, s_h = digest(s_cols, s_rows)
    d_n, d_h = digest(d_cols, d_rows)
    out = {"spark_rows": s_n, "oracle_rows": d_n,
           "columns_match": sorted(s_cols) == sorted(d_cols),
           "hash_match": s_h == d_h}
    out["type_mismatches"] = type_mismatches(sdf, con, sql)
    out["ok"] = out["columns_match"] and out["hash_match"] and s_n == d_n and not out["type_mismatches"]
    if not out["ok"]:
        out["spark_cols"] = s_cols
        out["oracle_cols"] = d_cols
        order_s = sorted(range(len(s_cols)), key=lambda i: s_cols[i])
        order_d = sorted(range(len(d_cols)), key=lambda i: d_cols[i])
        ss = sorted(repr([_norm(r[i]) for i in order_s]) for r in s_rows)
        dd = sorted(repr([_norm(r[i]) for i in order_d]) for r in d_rows)
        only_s = [x for x in ss if x not in set(dd)][:3]
        only_d = [x for x in dd if x not in set(ss)][:3]
        out["only_spark"] = only_s
        out["only_oracle"] = only_d
    return out
