"""``python -m cloakframe.cli``: analyze a text, scan files, anonymize, measure, write or check settings. Exit code 1 tells that something was found."""

from __future__ import annotations

import argparse
import json
import sys
import time

from pyspark.sql import functions as F

from .config import AnalysisConfig, analyze
from .operators import anonymize as an
from .operators import fusion
from .operators.recognizers import each
from .session import local_session
from .sources import files


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="cloakframe")
    sub = parser.add_subparsers(dest="command", required=True)
    for name in ("analyze", "anonymize", "benchmark"):
        p = sub.add_parser(name)
        p.add_argument("text", nargs="?")
        p.add_argument("--iterations", type=int, default=3)
        p.add_argument("-o", "--out")
        p.add_argument("--config")
    p = sub.add_parser("scan")
    p.add_argument("paths", nargs="*")
    p.add_argument("--format", choices=("json", "table", "sarif", "code-quality"), default="json")
    p.add_argument("--config")
    p = sub.add_parser("config")
    p.add_argument("action", choices=("init", "validate"))
    p.add_argument("path")
    args = parser.parse_args(argv)
    if args.command == "config":
        return _config(args)
    config = AnalysisConfig.load(open(args.config, encoding="utf-8").read()) if args.config else AnalysisConfig()
    spark = local_session()
    if args.command == "scan" and args.paths:
        docs = files.scan_files(spark, *args.paths)
    else:
        text = sys.stdin.read() if getattr(args, "text", None) is None else args.text
        docs = spark.createDataFrame([("-", text)], "path string, text string")
    found = analyze(docs, config)
    if args.command == "benchmark":
        start = time.perf_counter()
        for _ in range(args.iterations):
            found.write.format("noop").mode("overwrite").save()
        print(json.dumps({"iterations": args.iterations, "mean_ms": 1000 * (time.perf_counter() - start) / args.iterations}))
        return 0
    if args.command == "anonymize":
        out = an.anonymize(found.withColumn("entities", fusion.longest_only("entities")), {"EMAIL": an.mask(2)}, an.replace("PII"))
        text = out.select("anonymized.text").first()[0]
        if args.out:
            with open(args.out, "w", encoding="utf-8") as f:
                f.write(text)
        else:
            print(text)
        return 0
    rows = each(found, "entities", "e", "path", "text").select("path", F.col("text").alias("body"), "e.*").orderBy("path", "start").persist()
    shape = getattr(args, "format", "json")
    if shape == "table":
        rows.drop("body").show(1000, truncate=80)
    else:
        report = rows.drop("text").withColumnRenamed("body", "text")
        lines = {"sarif": lambda: files.sarif(report), "code-quality": lambda: files.code_quality(report), "json": lambda: rows.select(F.to_json(F.struct("path", "start", "end", "entity_type", "text", "score", "recognizer")))}[shape]()
        for r in lines.toLocalIterator():
            print(r[0])
    return int(rows.limit(1).count() > 0)


def _config(args: argparse.Namespace) -> int:
    if args.action == "init":
        with open(args.path, "w", encoding="utf-8") as f:
            f.write(AnalysisConfig().dump())
        return 0
    try:
        AnalysisConfig.load(open(args.path, encoding="utf-8").read())
    except (ValueError, TypeError) as e:
        print(e)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
