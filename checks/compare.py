"""Run registered queries against DuckDB: ``python -m checks.compare [sf] [name …]``."""

from __future__ import annotations

import sys
import time

import duckdb

from checks.suite import ORACLES, QUERIES
from wayside.session import build_session

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]

# Spark type to DuckDB type, for the schema comparison.
TYPES = {
    "string": "VARCHAR",
    "int": "INTEGER",
    "bigint": "BIGINT",
    "smallint": "SMALLINT",
    "double": "DOUBLE",
    "boolean": "BOOLEAN",
    "date": "DATE",
    "timestamp_ntz": "TIMESTAMP",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def compare(spark, con, name: str, sf_dir: str) -> str:
    """``ok`` or what differs."""
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(row)) for row in df.select(*columns).collect())
    if name not in ORACLES:
        return f"rows only: {len(got)}"
    schema = {row[0]: row[1] for row in con.execute(f"describe {ORACLES[name]}").fetchall()}
    if sorted(schema) != columns:
        return f"columns differ: {sorted(set(schema) ^ set(columns))}"
    types = {c: TYPES.get(t, t) for c, t in df.dtypes}
    wrong = {c: (types[c], schema[c]) for c in columns if types[c] != schema[c]}
    chosen = ", ".join(f'"{c}"' for c in columns)
    found = con.execute(f"select {chosen} from ({ORACLES[name]})").fetchall()
    want = sorted(repr(row) for row in found)
    if got != want:
        first = next((pair for pair in zip(got, want) if pair[0] != pair[1]), None)
        return f"VALUES DIFFER: {len(got)} against {len(want)} rows; {first}"
    if wrong:
        return f"types differ: {wrong}"
    return "ok" if got else "ok, but empty"


def main(sf: str = "0.01", *names: str) -> int:
    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session(
        master="local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name in names or QUERIES:
        start = time.time()
        try:
            verdict = compare(spark, con, name, sf_dir)
        except Exception as error:  # report and go on with the others
            verdict = f"ERROR: {type(error).__name__}: {str(error)[:600]}"
        bad += not verdict.startswith(("ok", "rows only"))
        print(f"{name:26s} {time.time() - start:6.1f}s {verdict}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(*sys.argv[1:]))
