"""Command line: import days, rebuild snapshots, forecast, evaluate, audit, load covariates."""

from __future__ import annotations

import argparse
import json
import os
import sys
import urllib.request

from pyspark.sql import SparkSession

from tallyloom.operators.basket_catalogue import load_exclusions
from tallyloom.plans import backfill, daily, runs
from tallyloom.sources import fetch


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="python -m tallyloom", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)

    day = commands.add_parser("day", help="one day's archives to observations and a snapshot")
    day.add_argument("archives", nargs="+")
    day.add_argument("--date", required=True)

    many = commands.add_parser("backfill", help="past days from an index of archived revisions")
    many.add_argument("--index", required=True, help="file or URL of the index")
    many.add_argument("--start", required=True)
    many.add_argument("--end", required=True)
    many.add_argument("--cache", required=True, help="folder for downloads that all executors share")
    many.add_argument("--keep-archives", action="store_true")

    again = commands.add_parser("rebuild", help="a snapshot from stored observations")
    again.add_argument("--date", required=True)
    again.add_argument("--rematch", action="store_true", help="classify and price anew")
    again.add_argument("--keep-outliers", action="store_true")

    tomorrow = commands.add_parser("forecast", help="the next day's forecast of all series as a file")
    tomorrow.add_argument("--file", help="where to write it (default: forecast-next.json below the output)")

    stage = commands.add_parser("evaluate", help="a stage of the evaluation; later ones compare with an earlier one")
    stage.add_argument("--stage", required=True)
    stage.add_argument("--start", required=True, help="first test day")
    stage.add_argument("--end", required=True)
    stage.add_argument("--since", help="first day that the stage may learn from")
    stage.add_argument("--earlier", help="stage to compare with, whose targets this one must have")

    check = commands.add_parser("audit", help="are all linked days imported or rejected, and all cells consistent?")
    check.add_argument("--index", required=True, help="file or URL of the index")

    more = commands.add_parser("covariates", help="currency rates, a published index and competitors' prices by day")
    for name, what in (("currency", "history of rates"), ("prices-index", "monthly index")):
        more.add_argument(f"--{name}", required=True, help=f"file or URL of the {what}")
    more.add_argument("--cache", help="folder for copies of what is fetched; an old copy serves where the source can't be had")

    for command in (tomorrow, stage, check, more):
        command.add_argument("--output", required=True, help="folder with the days' snapshots and manifest")

    for command in (day, many, again):
        command.add_argument("--output", required=True)
        command.add_argument("--exclusions", help="JSON file of words that rule items out")
    return parser.parse_args(argv)


def _index(where: str) -> dict:
    if "://" in where:
        with urllib.request.urlopen(where, timeout=30) as reply:
            return json.loads(reply.read())
    with open(where, encoding="utf-8") as f:
        return json.load(f)


#: Seconds that a copy of rates, and of the index, is fresh.
FRESH = {"currency": 12 * 3600, "prices_index": 24 * 3600}


def _copy(where: str, name: str, cache: str | None) -> str:
    """A path that Spark can read: a URL is fetched into the cache first."""
    if not where.startswith(("http://", "https://")):
        return where
    if cache is None:
        raise SystemExit("--cache is needed to fetch a URL")
    os.makedirs(cache, exist_ok=True)
    path = os.path.join(cache, f"{name}.json")
    if not fetch.cached(where, path, FRESH[name]):
        print(f"{where} can't be had; an old copy serves", file=sys.stderr)
    return path


def main(argv: list[str] | None = None) -> int:
    args = arguments(argv)
    spark = SparkSession.builder.appName("tallyloom").getOrCreate()
    if args.command == "forecast":
        print(json.dumps({"series": runs.forecast_run(spark, args.output, args.file or f"{args.output}/forecast-next.json")}))
        return 0
    if args.command == "evaluate":
        made = runs.evaluation_run(spark, args.output, args.stage, (args.start, args.end), args.since, args.earlier)
        print(json.dumps({k: made[k] for k in ("stage", "targets", "first", "last")}))
        return 0
    if args.command == "audit":
        made, good = runs.audit_run(spark, args.output, _index(args.index))
        print(json.dumps(made, default=str))
        return int(not good)
    if args.command == "covariates":
        print(json.dumps({"days": runs.covariates_run(spark, args.output, _copy(args.currency, "currency", args.cache), _copy(args.prices_index, "prices_index", args.cache))}))
        return 0
    out = load_exclusions(args.exclusions) if args.exclusions else None
    raw, snapshots = f"{args.output}/raw", f"{args.output}/snapshots"
    if args.command == "day":
        print(json.dumps(daily.run_day(spark, args.archives, args.date, raw, snapshots, exclusions=out)))
    elif args.command == "rebuild":
        daily.rebuild_day(spark, raw, args.date, snapshots, args.rematch, not args.keep_outliers, out)
    else:
        done = backfill.backfill(spark, _index(args.index), args.start, args.end, args.output, args.cache, out, args.keep_archives)
        states = {r["status"]: r["n"] for r in done.groupBy("status").count().withColumnRenamed("count", "n").collect()}
        print(json.dumps(states))
        return int("failed" in states)
    return 0


if __name__ == "__main__":
    sys.exit(main())
