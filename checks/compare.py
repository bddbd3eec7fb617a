"""Run a registered query and its SQL side by side and compare the rows."""

import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    return value


def _rows(table):
    names = sorted(table.column_names)
    columns = [[_plain(v) for v in table.column(n).to_pylist()] for n in names]
    types = [str(table.schema.field(n).type) for n in names]
    return names, types, sorted(zip(*columns), key=repr)


def compare(frame, con, sql: str) -> str | None:
    """None when equal, else a short description of the difference."""
    left = _rows(frame.toArrow())
    right = _rows(con.sql(sql).to_arrow_table())
    if left[0] != right[0]:
        return f"columns differ: {left[0]} / {right[0]}"
    if len(left[2]) != len(right[2]):
        return f"row counts differ: {len(left[2])} / {len(right[2])}"
    for a, b in zip(left[2], right[2]):
        if a != b:
            return f"rows differ:\n  {a}\n  {b}"
    if left[1] != right[1]:
        return f"types differ: {[(n, a, b) for n, a, b in zip(left[0], left[1], right[1]) if a != b]}"
    return None
