"""Command line: health, status, latest, backfill and replay over recorded data.

    python -m strandline.cli latest --source events.parquet
    python -m strandline.cli backfill --source pages/ --start 1 --end 500 --format csv --output out.csv
"""

from __future__ import annotations

import argparse
import json
import os
import sys
import tempfile

from strandline.functions.checks import SAFE_INTEGER
from strandline.operators.export import FORMATS, export_stream


def ledger(text: str) -> int:
    """A positive safe integer argument."""
    try:
        n = int(text)
    except ValueError:
        raise argparse.ArgumentTypeError(f"{text} is not a ledger number") from None
    if not 1 <= n <= SAFE_INTEGER:
        raise argparse.ArgumentTypeError(f"{text} is not a positive ledger number")
    return n


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="strandline")
    commands = top.add_subparsers(dest="command", required=True)
    for name in ("health", "status", "latest", "backfill", "replay"):
        sub = commands.add_parser(name)
        sub.add_argument("--source", required=True, help="a Parquet event table, or a folder of JSON pages")
        if name in ("backfill", "replay"):
            sub.add_argument("--start", type=ledger, required=True)
            sub.add_argument("--end", type=ledger, required=True)
            sub.add_argument("--format", choices=FORMATS, default="jsonl", type=str.lower)
            sub.add_argument("--output")
    return top


def open_source(spark, path: str):
    from strandline.sources.events import EventSource
    from strandline.sources.pages import read_pages

    if os.path.isdir(path) and any(x.endswith(".json") for x in os.listdir(path)):
        return EventSource(read_pages(spark, path))
    return EventSource(spark.read.parquet(path))


def write_output(lines, path: str | None) -> None:
    """To stdout line by line, or to one file that appears when it is complete."""
    if path is None:
        for line in lines:
            sys.stdout.write(line)
        return
    handle, temp = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)))
    with os.fdopen(handle, "w", encoding="utf-8") as f:
        f.writelines(lines)
    os.replace(temp, path)


def main(argv: list[str] | None = None, spark=None) -> int:
    args = parser().parse_args(argv)
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("strandline").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    source = open_source(spark, args.source)
    if args.command == "health":
        row = source.health().first()
        print(f"{'ok' if row['status'] == 'healthy' else 'failed'} {row['status']}")
        return int(row["status"] != "healthy")
    if args.command == "status":
        row = source.health().first().asDict()
        print(json.dumps(row | {"healthy": row["status"] == "healthy"}))
        return int(row["status"] != "healthy")
    if args.command == "latest":
        print(source.latest_ledger())
        return 0
    if args.end < args.start:
        print("--end must not precede --start", file=sys.stderr)
        return 2
    if args.command == "backfill":
        from strandline.operators.ordering import event_order

        rows = source.events_windowed(args.start, args.end, limit=None).orderBy(*event_order("replay"))
    else:
        from strandline.operators.dedupe import order_windows

        rows = order_windows(source.events_windowed(args.start, args.end, limit=None))
    write_output(export_stream(rows, format=args.format), args.output)
    return 0


if __name__ == "__main__":
    sys.exit(main())
