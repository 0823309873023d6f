"""Run queries and their SQL counterparts side by side.

    python tests/compare.py sf0.01 [query ...]
"""

from __future__ import annotations

import sys
import tempfile
import time
from collections import Counter
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parent.parent
DATA = Path("/root/testdata")
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def connect(folder: Path) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in folder.glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def difference(result, connection, sql: str) -> str | None:
    """None when both sides agree on columns, types and rows; otherwise what differs."""
    relation = connection.sql(sql)
    theirs = dict(zip(relation.columns, map(str, relation.types)))
    ours = {f.name: KINDS[f.dataType.simpleString()] for f in result.schema.fields}
    if ours != theirs:
        return f"schema {sorted(ours.items() ^ theirs.items())}"
    names = sorted(ours)
    left = Counter(tuple(row[n] for n in names) for row in result.collect())
    right = Counter(relation.select(*[f'"{n}"' for n in names]).fetchall())
    if left != right:
        only_left, only_right = left - right, right - left
        return (f"rows {sum(left.values())} vs {sum(right.values())}; {sum(only_left.values())} differ, "
                f"{names}: {sorted(only_left, key=str)[:3]} vs {sorted(only_right, key=str)[:3]}")
    return None


def main() -> None:
    sys.path.insert(0, str(ROOT))
    import __spark_entry__ as contract
    from pyspark.sql import SparkSession

    folder, names = DATA / sys.argv[1], sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="compare-")).getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    sql = contract.oracle_sql()
    for name, query in contract.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            result = query(spark, str(folder))
            found = difference(result, connect(folder), sql[name]) if name in sql else f"no SQL, {result.count()} rows"
        except Exception as error:  # report and go on with the next query
            found = f"ERROR {str(error)[:1500]}"
        print(f"{name:32s} {time.time() - start:6.2f}s {found or 'ok'}", flush=True)


if __name__ == "__main__":
    main()
