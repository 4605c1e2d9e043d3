"""Command line: score a creature or a folder of creatures against a folder of packed records.

    python -m evalgrid CREATURES CORPUS [--cost MSE] [--sample-rate 1] [--sample-phase 0] [--race-stdio CHUNK]
    python -m evalgrid --creature-stdin CORPUS

CREATURES is a folder of *.json (a result by key) or one .json file (one result). Errors go to stderr with exit code 1.
"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession

from .functions.losses import checked_cost
from .operators.sampling import checked_rate
from .operators.scoring import result_json, score_bin
from .plans.creature import parse_creature
from .sources.corpus import read_bin, record_count
from .sources.creatures import read_creatures
from .streaming.racing import RacingError, StdioReferee, race


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="evalgrid")
    parser.add_argument("paths", nargs="+")
    parser.add_argument("--creature-stdin", action="store_true")
    parser.add_argument("--cost", default="MSE")
    parser.add_argument("--sample-rate", type=float, default=1.0)
    parser.add_argument("--sample-phase", type=int, default=0)
    parser.add_argument("--race-stdio", type=int, metavar="CHUNK_RECORDS")
    args = parser.parse_args(argv)
    try:
        checked_cost(args.cost)
        checked_rate(args.sample_rate)
        if len(args.paths) != 2 - args.creature_stdin:
            raise ValueError("give a creature or folder of creatures and a corpus" if not args.creature_stdin else "with --creature-stdin give the corpus only")
        if args.race_stdio is not None and (args.creature_stdin or not os.path.isdir(args.paths[0])):
            raise ValueError("racing needs a folder of creatures")
        spark = SparkSession.builder.config("spark.ui.showConsoleProgress", "false").getOrCreate()
        options = {"cost": args.cost, "sample_rate": args.sample_rate, "sample_phase": args.sample_phase}
        if args.creature_stdin:
            print(result_json(score_bin(spark, sys.stdin.read(), args.paths[0], **options), keyed=False))
        elif os.path.isdir(args.paths[0]):
            creatures = read_creatures(spark, args.paths[0])
            if args.race_stdio is None:
                scores = score_bin(spark, creatures, args.paths[1], **options)
            else:
                shape = next(iter(creatures.values()))
                referee = StdioReferee(sys.stdin.readline, lambda x: print(x, flush=True))
                scores = race(read_bin(spark, args.paths[1], shape.input, shape.output), creatures, referee, args.race_stdio, records=record_count(args.paths[1], shape.input, shape.output), **options)
            print(result_json(scores))
        else:
            with open(args.paths[0], encoding="utf-8") as f:
                parse_creature(text := f.read())
            print(result_json(score_bin(spark, text, args.paths[1], **options), keyed=False))
    except (ValueError, RacingError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
