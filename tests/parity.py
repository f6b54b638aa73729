"""Compare every named query with its SQL counterpart on one data directory.

    python tests/parity.py /root/testdata/sf0.01 [name-prefix ...]
"""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(directory: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        path = f"{directory}/{table}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}')")
    return con


def canonical(frame: pd.DataFrame) -> pd.DataFrame:
    """Columns by name, values as comparable text, rows sorted."""

    def cell(value) -> str:
        if value is None or value is pd.NaT or (isinstance(value, float) and value != value):
            return "NULL"
        if value is pd.NA:
            return "NULL"
        if isinstance(value, bool):
            return str(value)
        if hasattr(value, "isoformat"):
            return value.isoformat()[:10]
        if hasattr(value, "item"):
            value = value.item()
        return repr(value)

    frame = frame[sorted(frame.columns)].astype(object)
    frame = frame.map(cell)
    return frame.sort_values(list(frame.columns)).reset_index(drop=True) if len(frame.columns) else frame


_SAME_TYPE = {
    "int": "INTEGER",
    "bigint": "BIGINT",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "date": "DATE",
    "boolean": "BOOLEAN",
}


def rows_of(df) -> pd.DataFrame:
    return pd.DataFrame([tuple(r) for r in df.collect()], columns=df.columns, dtype=object)


def compare(spark_df, con, sql: str) -> str:
    """Empty text when both sides agree, else what differs."""
    relation = con.sql(sql)
    ours = dict(spark_df.dtypes)
    theirs = dict(zip(relation.columns, map(str, relation.types)))
    if set(ours) != set(theirs):
        return f"columns {sorted(ours)} / {sorted(theirs)}"
    wrong = {n: (ours[n], theirs[n]) for n in ours if _SAME_TYPE.get(ours[n]) != theirs[n]}
    if wrong:
        return f"types {wrong}"
    left = canonical(rows_of(spark_df))
    right = canonical(pd.DataFrame(relation.fetchall(), columns=relation.columns, dtype=object))
    if len(left) != len(right):
        return f"row count {len(left)} / {len(right)}"
    different = (left != right).any(axis=1)
    if different.any():
        return (
            f"{different.sum()} of {len(left)} rows differ\n"
            f"{left[different].head(3).to_string()}\n{right[different].head(3).to_string()}"
        )
    return ""


def main() -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    directory = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = tuple(sys.argv[2:])
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(directory)
    oracle = entry.oracle_sql()
    failed = 0
    for name, build in entry.queries().items():
        if prefixes and not name.startswith(prefixes):
            continue
        start = time.time()
        try:
            df = build(spark, directory)
            verdict = compare(df, con, oracle[name]) if name in oracle else f"no SQL, {df.count()} rows"
        except Exception as error:  # report and go on with the next query
            verdict = f"{type(error).__name__}: {str(error)[:600]}"
        failed += bool(verdict)
        print(f"{'ok  ' if not verdict else 'FAIL'} {name} {time.time() - start:.2f}s {verdict}", flush=True)
    unknown = set(oracle) - set(entry.queries())
    print(f"{failed} failed; SQL without query: {sorted(unknown)}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
