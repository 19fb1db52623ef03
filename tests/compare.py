"""Row-by-row comparison of a query with its SQL."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if isinstance(value, bool) or value is None or isinstance(value, (int, str)):
        return value
    number = float(value)
    return "nan" if math.isnan(number) else number + 0.0


def differences(df, con: duckdb.DuckDBPyConnection, sql: str, limit: int = 5) -> list[str]:
    """What differs between a frame and a SQL result, as text; empty if nothing does."""
    names = sorted(df.columns)
    result = con.execute(sql)
    sql_names = [d[0] for d in result.description]
    if sorted(sql_names) != names:
        return [f"columns {names} != {sorted(sql_names)}"]
    order = [sql_names.index(n) for n in names]
    expected = Counter(tuple(_plain(row[i]) for i in order) for row in result.fetchall())
    table = df.select(*(f"`{n}`" for n in names)).toArrow()
    columns = [c.to_pylist() for c in table.columns]
    got = Counter(tuple(map(_plain, row)) for row in zip(*columns))
    out = []
    if sum(got.values()) != sum(expected.values()):
        out.append(f"{sum(got.values())} rows, SQL has {sum(expected.values())}")
    out += [f"only in Spark: {row}" for row in list((got - expected).elements())[:limit]]
    out += [f"only in SQL: {row}" for row in list((expected - got).elements())[:limit]]
    types = con.execute(f"DESCRIBE {sql}").fetchall()
    kinds = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean",
             "FLOAT": "float", "HUGEINT": "bigint"}
    for name, kind, *_ in types:
        mine = df.schema[name].dataType.simpleString()
        if kinds.get(kind, kind) != mine:
            out.append(f"type of {name}: {mine}, SQL has {kind}")
    return out
