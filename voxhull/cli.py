"""python -m voxhull.cli: list or run named queries, or run a module's tests."""

from __future__ import annotations

import argparse
import subprocess
import sys


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="voxhull")
    sub = parser.add_subparsers(dest="command", required=True)
    sub.add_parser("queries", help="list the named queries")
    run = sub.add_parser("run", help="run a named query and show its first rows")
    run.add_argument("name")
    run.add_argument("folder")
    test = sub.add_parser("test", help="run the tests, or those of one module")
    test.add_argument("module", nargs="?", default="")
    args = parser.parse_args(argv)
    if args.command == "test":
        return subprocess.call([sys.executable, "-m", "pytest", "-q", f"tests/test_{args.module}.py" if args.module else "tests"])
    from .plans.catalogue import QUERIES

    if args.command == "queries":
        print("\n".join(sorted(QUERIES)))
        return 0
    if args.name not in QUERIES:
        print(f"unknown query: {args.name}", file=sys.stderr)
        return 1
    from pyspark.sql import SparkSession

    QUERIES[args.name](SparkSession.builder.getOrCreate(), args.folder).show()
    return 0


if __name__ == "__main__":
    sys.exit(main())
