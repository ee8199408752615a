"""Run a registered query and its SQL on the same tables and compare the rows exactly."""

from __future__ import annotations

import glob
import math
import os
from collections import Counter

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


SPARK_TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "float": "FLOAT",
}


def canonical(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return value + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(canonical(v) for v in value)
    return value


def compare(df, sql: str, con: duckdb.DuckDBPyConnection) -> list[str]:
    """Differences as messages; empty when rows, names and types agree."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    types = {d[0]: str(d[1]) for d in result.description}
    expected_rows = result.fetchall()
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} != {sorted(names)}"]
    problems = []
    for name, kind in df.dtypes:
        wanted = SPARK_TYPES.get(kind)
        if wanted and types[name] != wanted:
            problems.append(f"type of {name}: {kind} != {types[name]}")
    order = sorted(names)
    actual = Counter(tuple(canonical(r[c]) for c in order) for r in df.collect())
    picks = [names.index(c) for c in order]
    expected = Counter(tuple(canonical(r[i]) for i in picks) for r in expected_rows)
    if actual != expected:
        extra, missing = actual - expected, expected - actual
        problems.append(
            f"{sum(actual.values())} rows against {sum(expected.values())}; "
            f"only here {list(extra.items())[:3]}; only in SQL {list(missing.items())[:3]}"
        )
    return problems
