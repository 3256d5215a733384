"""Queries from the command line: python -m tidelog list | sql NAME | run NAME FOLDER [--out PATH] [--rows N] [--explain]."""

from __future__ import annotations

import argparse
import sys

from tidelog.plans.oracle import ORACLE_SQL
from tidelog.plans.queries import QUERIES


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tidelog", description="Event-log queries over the Parquet tables of a folder.")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list", help="names of the queries")
    sql = commands.add_parser("sql", help="a query as DuckDB SQL, where there is one")
    run = commands.add_parser("run", help="runs a query and shows or writes its rows")
    for p in (sql, run):
        p.add_argument("name", choices=sorted(QUERIES), metavar="NAME")
    run.add_argument("folder")
    run.add_argument("--out", help="write the rows there as Parquet instead of showing some")
    run.add_argument("--rows", type=int, default=20, help="rows to show")
    run.add_argument("--explain", action="store_true", help="show the plan and run nothing")
    args = parser.parse_args(argv)
    if args.command == "list":
        print("\n".join(sorted(QUERIES)))
        return 0
    if args.command == "sql":
        print(ORACLE_SQL.get(args.name, "-- not expressed in SQL"))
        return 0
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName(f"tidelog {args.name}").config("spark.sql.session.timeZone", "UTC").getOrCreate()  # the master is spark-submit's or the environment's
    df = QUERIES[args.name](spark, args.folder)
    if args.explain:
        df.explain("formatted")
    elif args.out:
        df.write.parquet(args.out)
    else:
        df.show(args.rows, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
