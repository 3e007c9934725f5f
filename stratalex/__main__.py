"""Command line: classify one description, or the files below a path.

    python -m stratalex --tariff DIR --describe "Garden hose reel"
    python -m stratalex --tariff DIR --file_path invoices --decoder mypackage.decoders:read --output out.json --format both
    python -m stratalex --tariff DIR --rebuild schedule.txt --source_date 2026-08-28

Exit codes: 2 if the path is missing, 1 if it holds no supported file or its only file cannot be read, else 0.
"""

from __future__ import annotations

import argparse
import importlib
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalex.operators.lines import extract_lines
from stratalex.operators.windows import number_all
from stratalex.plans import build, classify
from stratalex.sources import sinks
from stratalex.sources.documents import decode_documents, list_inputs, read_schedule
from stratalex.storage import materialise


def _named(spec: str | None):
    if spec is None:
        return None
    module, _, name = spec.partition(":")
    return getattr(importlib.import_module(module), name)


def _plain_text(path: str, content: bytes):
    return "", [], "No decoder was given."


def run(spark: SparkSession, args: argparse.Namespace) -> int:
    if args.rebuild:
        counts = build.build(read_schedule(spark, args.rebuild), args.tariff, date=args.source_date).first()
        print(f"Built {args.tariff}: {counts.leaves} declarable lines, {counts.chapters} chapters, {counts.nodes} rows, {counts.unknown_duty} without a general rate.", file=sys.stderr)
    corpus = build.load(spark, args.tariff)
    out: DataFrame | None = None
    if args.describe:
        out = classify.describe(spark, args.describe, corpus, args.part_number, args.quantity)
    if args.file_path:
        try:
            files = list_inputs(spark, args.file_path)
        except FileNotFoundError:
            print(f"File not found: {args.file_path}", file=sys.stderr)
            return 2
        docs = materialise(decode_documents(files, _named(args.decoder) or _plain_text, _named(args.recognizer)), "documents")
        routes = docs.groupBy("route").count().collect()  # a handful of routes
        if not routes:
            print(f"No PDF or image files found in {args.file_path}", file=sys.stderr)
            return 1
        if [(r.route, r["count"]) for r in routes] == [("unsupported", 1)]:
            print(docs.first().warnings[0], file=sys.stderr)
            return 1
        lines = classify.classify_lines(extract_lines(docs), corpus).drop("line_number")
        rows = sinks.public(number_all(lines, "source_file", "pos").withColumn("line_number", F.col("line_number") + (1 if args.describe else 0)))
        out = rows if out is None else out.withColumn("line_number", F.col("line_number").cast("long")).unionByName(rows)
    if out is not None:
        if args.output:
            sinks.emit(out, args.output, args.format)
        else:
            print(sinks.json_array(out.orderBy("line_number")))
    return 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="stratalex")
    for name in ("--tariff", "--rebuild", "--source_date", "--describe", "--part_number", "--quantity", "--file_path", "--decoder", "--recognizer", "--output"):
        p.add_argument(name, required=name == "--tariff", default="" if name == "--source_date" else None)
    p.add_argument("--format", choices=("json", "csv", "both"), default="json")
    return run(spark or SparkSession.builder.getOrCreate(), p.parse_args(argv))


if __name__ == "__main__":
    raise SystemExit(main())
