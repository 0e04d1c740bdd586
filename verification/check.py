"""Run every query in Spark and its SQL in DuckDB and compare the rows.

    python -m verification.check [folder] [name ...]
"""

from __future__ import annotations

import math
import sys
import time

import duckdb
from pyspark.sql import DataFrame, SparkSession

from verification.oracle import ORACLE_SQL
from verification.registry import QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


# DuckDB type -> Spark type.
_SQL_TYPES = {
    "VARCHAR": "string",
    "BIGINT": "bigint",
    "INTEGER": "int",
    "DOUBLE": "double",
    "BOOLEAN": "boolean",
}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for table in TABLES:
        db.execute(
            f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')"
        )
    return db


def _cell(value: object) -> tuple:
    if value is None:
        return (0, "")
    if isinstance(value, bool):
        return (1, str(value))
    if isinstance(value, int):
        return (2, str(value))
    if isinstance(value, float):
        return (3, "nan" if math.isnan(value) else repr(value + 0.0))
    return (4, str(value))


def _rows(names: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def differences(df: DataFrame, db: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None when both give the same columns and rows, else what differs."""
    result = db.execute(sql)
    names = [d[0] for d in result.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    types = {d[0]: str(d[1]) for d in result.description}
    for name, ours in df.dtypes:
        if _SQL_TYPES.get(types[name]) != ours:
            return f"type of {name}: {ours} != {types[name]}"
    ours, theirs = _rows(df.columns, df.collect()), _rows(names, result.fetchall())
    if len(ours) != len(theirs):
        return f"rows {len(ours)} != {len(theirs)}"
    for a, b in zip(ours, theirs):
        if a != b:
            return f"row {a} != {b}"
    return None


def main() -> int:
    from tradespec.session import build_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    wanted = sys.argv[2:] or list(QUERIES)
    spark = build_session(
        "check",
        "local[8]",
        {
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "8g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    db = connect(folder)
    failed = 0
    for name in wanted:
        start = time.perf_counter()
        try:
            df = QUERIES[name](spark, folder)
            problem = (
                differences(df, db, ORACLE_SQL[name]) if name in ORACLE_SQL else None
            )
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failed += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} "
              f"{time.perf_counter() - start:.1f}s {problem or ''}", flush=True)
    print(f"{len(wanted) - failed} of {len(wanted)} agree")
    return failed


if __name__ == "__main__":
    sys.exit(main())
