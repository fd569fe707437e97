"""python -m quarrylens analyze PATH [-r REPORT] [-f json|html|markdown] [-s N] [-t TYPE]; python -m quarrylens serve [--port N]"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from quarrylens import reports
from quarrylens.engine import analyze
from quarrylens.model import ProfileError


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quarrylens", description="Profile a dataset with Spark.")
    commands = top.add_subparsers(dest="command", required=True)
    service = commands.add_parser("serve", help="offer the same over HTTP on this machine")
    service.add_argument("--host", default="127.0.0.1")
    service.add_argument("--port", type=int, default=8000)
    run = commands.add_parser("analyze", help="profile a file or folder")
    run.add_argument("path")
    run.add_argument("-r", "--report", help="write a report here")
    run.add_argument("-f", "--format", choices=sorted(reports.WRITERS), help="report format; else from the suffix")
    run.add_argument("-s", "--sample", type=int, help="analyze this many rows or images")
    run.add_argument("-t", "--type", help="dataset type or loader to use")
    run.add_argument("--auto-sample", action="store_true", help="sample data over a gigabyte")
    return top


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    given = parser().parse_args(args)
    spark = spark or SparkSession.builder.appName("quarrylens").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if given.command == "serve":
        from quarrylens.server import serve

        with serve(spark, given.host, given.port) as server:
            print(f"http://{given.host}:{server.server_address[1]}")
            server.serve_forever()
        return 0
    try:
        report = analyze(spark, given.path, given.sample, given.type, lambda u: print(f"{u.progress:4.0%} {u.stage} {u.message}", file=sys.stderr), given.auto_sample)
    except ProfileError as error:
        print(f"error: {error}", file=sys.stderr)
        return 1
    for title, rows in reports.sections(report)[:2]:
        print(title)
        for a, b in rows:
            print(f"  {a}: {b}")
    for f in reports.sorted_findings(report):
        print(f"[{f.severity.value}] {f.code}: {f.message}")
    if given.report:
        print(f"{reports.write(report, given.report, given.format)} report: {given.report}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
