"""``python -m tidemark list`` and ``python -m tidemark run NAME FOLDER [--rows N]``: registered queries from the command line."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from tidemark import queries


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tidemark", description=__doc__)
    sub = parser.add_subparsers(dest="verb", required=True)
    sub.add_parser("list")
    run = sub.add_parser("run")
    run.add_argument("name", choices=sorted(queries.QUERIES))
    run.add_argument("folder")
    run.add_argument("--rows", type=int, default=20)
    got = parser.parse_args(args)
    if got.verb == "list":
        print("\n".join(sorted(queries.QUERIES)))
        return
    spark = SparkSession.builder.appName(f"tidemark {got.name}").getOrCreate()
    queries.QUERIES[got.name](spark, got.folder).show(got.rows, truncate=False)


if __name__ == "__main__":
    main()
