"""Run registered queries in Spark and their SQL in DuckDB and compare whole results.

python tests/compare.py [--sf /root/testdata/sf0.01] [name ...]
"""

from __future__ import annotations

import argparse
import glob
import os
import sys
import tempfile
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def open_tables(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def difference(spark_df, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None when columns, types of values and the multiset of rows agree."""
    relation = con.sql(sql)
    names = sorted(spark_df.columns)
    if names != sorted(relation.columns):
        return f"columns differ: {names} and {sorted(relation.columns)}"
    order = [relation.columns.index(n) for n in names]
    expected = Counter(tuple(row[i] for i in order) for row in relation.fetchall())
    got = Counter(tuple(row) for row in spark_df.select(*names).collect())
    if expected == got:
        return None
    missing, extra = expected - got, got - expected
    return (
        f"{sum(got.values())} rows and {sum(expected.values())} expected; "
        f"missing {sum(missing.values())} e.g. {list(missing)[:2]}; extra {sum(extra.values())} e.g. {list(extra)[:2]}"
    )


def main() -> int:
    import __spark_entry__ as contract
    from rookery.session import build_session

    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("--zone", default="UTC")
    parser.add_argument("--partitions", default="8")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    spark = build_session(
        master="local[8]",
        spark__checkpoint__dir=tempfile.mkdtemp(prefix="rookery-compare-"),
        spark__sql__shuffle__partitions=args.partitions,
        spark__sql__session__timeZone=args.zone,
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="8g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = open_tables(args.sf)
    queries, oracle = contract.queries(), contract.oracle_sql()
    failed = 0
    for name in args.names or queries:
        started = time.time()
        try:
            df = queries[name](spark, args.sf)
            problem = difference(df, con, oracle[name]) if name in oracle else f"no SQL, {df.count()} rows"
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failed += problem is not None
        print(f"{name:26s} {time.time() - started:6.2f}s {'ok' if problem is None else problem}", flush=True)
    print(f"{failed} of {len(args.names or queries)} differ")
    return int(failed > 0)


if __name__ == "__main__":
    sys.exit(main())
