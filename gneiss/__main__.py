"""python -m gneiss queries | run NAME FOLDER | tool ROOT COPYBOOKS NAME KEY=VALUE..."""

from __future__ import annotations

import argparse
import json
import sys


def main(words: list[str]) -> int:
    parser = argparse.ArgumentParser(prog="gneiss")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("queries")
    run = commands.add_parser("run")
    run.add_argument("name")
    run.add_argument("folder")
    run.add_argument("--rows", type=int, default=20)
    tool = commands.add_parser("tool")
    tool.add_argument("root")
    tool.add_argument("copybooks", help="folders, separated by commas")
    tool.add_argument("name")
    tool.add_argument("arguments", nargs="*", help="key=value")
    asked = parser.parse_args(words)
    from gneiss.plans import programs, records, registry  # noqa: F401  # the first two register their queries

    if asked.command == "queries":
        print(*sorted(registry.queries()), sep="\n")
        return 0
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.getOrCreate()
    if asked.command == "run":
        if asked.name not in registry.queries():
            print(f"no query {asked.name!r}", file=sys.stderr)
            return 2
        registry.queries()[asked.name](spark, asked.folder).show(asked.rows, truncate=False)
        return 0
    from gneiss.operators.tools import Corpus

    corpus = Corpus.load(spark, asked.root, [c for c in asked.copybooks.split(",") if c])
    seen = corpus.call(asked.name, **dict(a.split("=", 1) for a in asked.arguments))
    print(json.dumps(seen, ensure_ascii=False))
    return 1 if seen["error"] else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
