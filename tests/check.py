"""Run registered queries beside their SQL and compare whole results.

Usage: python -m tests.check [sf_dir] [query ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

import __spark_entry__ as contract
from runloom.session import build_session

TABLES = Path("/root/testdata")
SAME_TYPE = {"boolean": "BOOLEAN", "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE"}


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in Path(sf).glob("*.parquet"):
        files = f"{path}/*.parquet" if path.is_dir() else path
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{files}')")
    return con


def normal(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)].astype(object).where(frame.notna(), None)
    return sorted(map(tuple, frame.itertuples(index=False)), key=repr)


def compare(spark, con, name: str, sf: str) -> str:
    result = contract.queries()[name](spark, sf)
    got = result.toPandas()
    relation = con.sql(contract.oracle_sql()[name])
    want = relation.df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    types = {column: str(kind) for column, kind in zip(relation.columns, relation.types)}
    for column, kind in result.dtypes:
        if types[column] != SAME_TYPE[kind]:
            return f"type of {column}: {kind} != {types[column]}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    for mine, theirs in zip(normal(got), normal(want)):
        if mine != theirs:
            return f"values\n  {str(mine)[:1500]}\n  {str(theirs)[:1500]}"
    if not len(got) and not name.endswith("_empty"):
        return "no rows"
    return ""


def main(argv: list[str]) -> int:
    sf = argv[0] if argv else str(TABLES / "sf0.01")
    names = argv[1:] or list(contract.queries())
    spark = build_session(
        **{"spark.master": "local[8]", "spark.sql.shuffle.partitions": "8",
           "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(sf), 0
    for name in names:
        begin = time.time()
        try:
            problem = compare(spark, con, name, sf)
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - begin:.1f}s {problem}", flush=True)
    print(f"{len(names) - bad}/{len(names)}")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
