"""Spark's rows against DuckDB's: names, counts and values without regard to order."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.6g}"
    return "-" if value is None else str(value)


def differences(spark_frame, sql: str, sf_dir: str) -> str | None:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    found = con.execute(sql)
    names = [x[0] for x in found.description]
    expected = found.fetchall()
    if sorted(names) != sorted(spark_frame.columns):
        return f"columns {sorted(spark_frame.columns)} and {sorted(names)}"
    order = sorted(names)
    own = sorted(tuple(_plain(r[c]) for c in order) for r in spark_frame.collect())
    other = sorted(tuple(_plain(dict(zip(names, r))[c]) for c in order) for r in expected)
    if own == other:
        return None
    apart = [(a, b) for a, b in zip(own, other) if a != b][:3]
    return f"{len(own)} and {len(other)} rows; first that differ: {apart}"
