"""Run a Spark result and its DuckDB oracle side by side and compare them.

The comparison is order-insensitive and works on normalised Python values:
decimals and floats are compared after rounding to ``digits`` places, dates and
times by their ISO text. It mirrors the driver's check (column names, row
count, value multiset) and additionally reports type differences.
"""

from __future__ import annotations

import datetime as _dt
import decimal
import os
from collections import Counter
from dataclasses import dataclass, field

import duckdb

VIEW_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def duckdb_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in VIEW_TABLES:
        path = os.path.join(sf_dir, f"{name}.parquet")
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _norm(value, digits: int):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (float, decimal.Decimal)):
        f = float(value)
        if f != f:
            return "nan"
        r = round(f, digits)
        return 0.0 if r == 0 else r
    if isinstance(value, int):
        return float(value)
    if isinstance(value, (_dt.datetime, _dt.date)):
        return value.isoformat()
    if isinstance(value, dict):
        return tuple(sorted((k, _norm(v, digits)) for k, v in value.items()))
    if isinstance(value, (list, tuple)):
        return tuple(_norm(v, digits) for v in value)
    if hasattr(value, "asDict"):
        return _norm(value.asDict(recursive=True), digits)
    return value


@dataclass
class Comparison:
    name: str
    ok: bool
    spark_rows: int
    oracle_rows: int
    column_diff: tuple = ()
    type_diff: list = field(default_factory=list)
    only_spark: list = field(default_factory=list)
    only_oracle: list = field(default_factory=list)

    def summary(self) -> str:
        status = "OK " if self.ok else "BAD"
        text = f"{status} {self.name}: spark={self.spark_rows} oracle={self.oracle_rows}"
        if self.column_diff:
            text += f" columns={self.column_diff}"
        if self.type_diff:
            text += f" types={self.type_diff}"
        if not self.ok and (self.only_spark or self.only_oracle):
            text += f"\n   only spark: {self.only_spark[:3]}\n   only oracle: {self.only_oracle[:3]}"
        return text


_SPARK_TO_DUCK = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "date": "DATE",
    "timestamp_ntz": "TIMESTAMP",
    "timestamp": "TIMESTAMP WITH TIME ZONE",
    "boolean": "BOOLEAN",
}


def _spark_type_as_duck(simple: str) -> str:
    if simple.startswith("array<"):
        return _spark_type_as_duck(simple[6:-1]) + "[]"
    if simple.startswith("decimal"):
        return simple.upper().replace(" ", "")
    return _SPARK_TO_DUCK.get(simple, simple.upper())


def compare(name: str, spark_df, con, sql: str, digits: int = 6) -> Comparison:
    rel = con.sql(sql)
    oracle_cols = list(rel.columns)
    oracle_types = [str(t).replace(" ", "") for t in rel.types]
    oracle_rows = rel.fetchall()
    spark_cols = spark_df.columns
    spark_types = [f.dataType.simpleString() for f in spark_df.schema.fields]
    spark_rows = [tuple(r) for r in spark_df.collect()]

    column_diff = ()
    if sorted(spark_cols) != sorted(oracle_cols):
        column_diff = (
            sorted(set(spark_cols) - set(oracle_cols)),
            sorted(set(oracle_cols) - set(spark_cols)),
        )
    type_diff = []
    duck_types = dict(zip(oracle_cols, oracle_types))
    for col, st in zip(spark_cols, spark_types):
        dt = duck_types.get(col)
        if dt is not None and _spark_type_as_duck(st) != dt:
            type_diff.append((col, st, dt))

    order = sorted(spark_cols)
    s_idx = [spark_cols.index(c) for c in order]
    o_idx = [oracle_cols.index(c) for c in order if c in oracle_cols]
    s_vals = Counter(repr(tuple(_norm(r[i], digits) for i in s_idx)) for r in spark_rows)
    o_vals = (
        Counter(repr(tuple(_norm(r[i], digits) for i in o_idx)) for r in oracle_rows)
        if len(o_idx) == len(order)
        else Counter()
    )
    only_s = list((s_vals - o_vals).elements())
    only_o = list((o_vals - s_vals).elements())
    ok = not (column_diff or type_diff or only_s or only_o) and len(spark_rows) == len(oracle_rows)
    return Comparison(name, ok, len(spark_rows), len(oracle_rows), column_diff, type_diff, only_s, only_o)
