"""generate, verify and inspect: JSON on standard output; errors as JSON on standard error, with exit code 2."""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import asdict

from pyspark.sql import SparkSession

from tessera.plans.generate import generate_dataset
from tessera.sources.config import load_generation_config
from tessera.sources.dataset import inspect_dataset, verify_dataset
from tessera.sources.fixture import scene_objects


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tessera", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    make = commands.add_parser("generate")
    make.add_argument("config")
    make.add_argument("output")
    make.add_argument("--tables", required=True, help="folder of the tables that scenes are made of")
    make.add_argument("--work", required=True, help="folder of the stage tables")
    for name in ("verify", "inspect"):
        commands.add_parser(name).add_argument("root")
    args = parser.parse_args(argv)
    try:
        spark = SparkSession.builder.getOrCreate()
        if args.command == "generate":
            out = asdict(generate_dataset(spark, scene_objects(spark, args.tables), load_generation_config(args.config), args.output, args.work))
        elif args.command == "verify":
            out = asdict(verify_dataset(spark, args.root))
        else:
            out = inspect_dataset(spark, args.root)
    except (OSError, ValueError, TypeError) as e:
        print(json.dumps({"error": type(e).__name__, "message": str(e)}), file=sys.stderr)
        return 2
    print(json.dumps(out, sort_keys=True))
    return 0


if __name__ == "__main__":
    sys.exit(main())
