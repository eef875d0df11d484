"""Command line: map, update, formats, init, clean, status, version."""

from __future__ import annotations

import argparse
import json
import os
import shutil
import sys
import time
from dataclasses import asdict

VERSION, FORMATS, HOME = "0.2.0", ("parquet", "json", "yaml"), ".graphloom"


def newest(folder: str) -> tuple[str, float] | None:
    """The file that was changed last, and when."""
    files = [os.path.join(d, f) for d, _, fs in os.walk(folder) for f in fs if not f.startswith((".", "_"))]
    return max(((f, os.path.getmtime(f)) for f in files), key=lambda x: (x[1], x[0]), default=None)


def _map(path: str, out: str, formats: list[str], since: float | None, settings) -> int:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from graphloom.sinks.documents import emit_all
    from graphloom.sources.files import scan
    from graphloom.sources.ruby import extract_files

    spark = SparkSession.builder.appName("graphloom").getOrCreate()
    files = scan(spark, path, excludes=settings.excludes, since=since)
    rows = extract_files(files)
    failed = emit_all({"entities": rows.where(F.col("kind") != "error"), "errors": rows.where(F.col("kind") == "error")}, formats, out, settings.redaction)
    for f, name, message in failed:
        print(f"{name} as {f}: {message}", file=sys.stderr)
    return 1 if failed else 0


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="graphloom")
    verbs = p.add_subparsers(dest="verb", required=True)
    for verb in ("map", "update"):
        v = verbs.add_parser(verb)
        v.add_argument("path", nargs="?", default=".")
        v.add_argument("--out", default=HOME)
        v.add_argument("--format", action="append", choices=FORMATS)
        v.add_argument("--settings")
        if verb == "update":
            v.add_argument("--since", type=float, help="only files changed after this time, in seconds; by default the newest output's")
    for verb in ("version", "formats"):
        verbs.add_parser(verb)
    for verb in ("init", "clean", "status"):
        verbs.add_parser(verb).add_argument("--out", default=HOME)
    a = p.parse_args(args)
    if a.verb == "version":
        print(VERSION)
    elif a.verb == "formats":
        print("\n".join(FORMATS))
    elif a.verb == "init":
        from graphloom.sources.files import Settings

        os.makedirs(a.out, exist_ok=True)
        path = os.path.join(a.out, "settings.json")
        if os.path.exists(path):
            print(f"{path} is there already", file=sys.stderr)
            return 1
        with open(path, "w", encoding="utf-8") as f:
            json.dump(asdict(Settings()), f, indent=2)
        print(path)
    elif a.verb == "clean":
        for f in FORMATS:
            shutil.rmtree(os.path.join(a.out, f), ignore_errors=True)
    elif a.verb == "status":
        last = newest(a.out) if os.path.isdir(a.out) else None
        print("nothing was mapped yet" if last is None else f"{last[0]} {time.strftime('%Y-%m-%dT%H:%M:%SZ', time.gmtime(last[1]))}")
    else:
        from graphloom.sources.files import Settings

        named = a.settings or os.path.join(a.out, "settings.json")
        settings = Settings.from_file(named) if os.path.exists(named) else Settings()
        since = None
        if a.verb == "update":
            last = newest(a.out) if os.path.isdir(a.out) else None
            since = a.since if a.since is not None else last and last[1]
        return _map(a.path, a.out, a.format or ["parquet"], since, settings)
    return 0


if __name__ == "__main__":
    sys.exit(main())
