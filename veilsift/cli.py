"""Command line: screen files, print safe text, write the samples.

Exit codes: 0 clean or done, 1 an error, 2 something is flagged.
"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans.model import ScreenConfig
from .plans.screen import Screen, result_json
from .sources.pdf import scan_files
from .sources.pdf_samples import samples, write_samples

EVIDENCE_CHARS = 100


def _session() -> SparkSession:
    return (
        SparkSession.builder.appName("veilsift").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )


def _one_file(spark: SparkSession, path: Path) -> DataFrame:
    return spark.createDataFrame([(0, path.read_bytes())], "doc_id long, content binary")


def _report(name: str, row) -> str:
    lines = [f"File:      {name}", f"Verdict:   {row['verdict']}", f"Score:     {row['risk_score']}/100", f"Pages:     {row['pages']}"]
    lines.append(f"Findings:  {len(row['findings'])}")
    if row["findings"]:
        lines.append("Detectors: " + ", ".join(sorted({f["detector"] for f in row["findings"]})))
    for i, f in enumerate(row["findings"], 1):
        lines.append(f"  {i}. [{f['severity']}] {f['detector']} ({f['category']}): {f['message']}")
        if f["evidence"]:
            lines.append(f"     {f['evidence'][:EVIDENCE_CHARS]!r}")
        if f["page"] is not None:
            lines.append(f"     page {f['page'] + 1}")
    return "\n".join(lines + [f"Error: {e}" for e in row["errors"]])


def _put(text: str, out: str | None) -> None:
    if out:
        Path(out).write_text(text + "\n", encoding="utf-8")
    else:
        print(text)


def _run(args: argparse.Namespace, spark: SparkSession | None) -> int:
    if args.command == "samples":
        made = write_samples(args.folder) if args.folder else samples()
        for s in made:
            print(f"{s.technique:<24}{'poisoned' if s.is_poisoned else 'clean':<10}{s.description}")
        return 0
    path = Path(args.file)
    if not path.is_file():
        raise ValueError(f"no file {path}")
    if args.command == "scan" and args.output and not args.json:
        raise ValueError("--output is for --json")
    config = ScreenConfig.from_file(args.config) if args.config else ScreenConfig.from_env()
    spark = spark or _session()
    results = scan_files(_one_file(spark, path), Screen(config))
    if args.command == "sanitize":
        _put(results.select("sanitized_text").first()[0], args.output)
        return 0
    named = results.withColumn("filename", F.lit(path.name))
    if args.json:
        found = json.loads(result_json(named).first()["json"])
        _put(json.dumps(found, indent=2, ensure_ascii=False), args.output)
        return 0 if found["verdict"] == "clean" else 2
    row = named.first()
    print(_report(path.name, row))
    return 0 if row["verdict"] == "clean" else 2


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser("veilsift", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    scan = commands.add_parser("scan", help="screen a PDF file")
    scan.add_argument("--json", action="store_true")
    clean = commands.add_parser("sanitize", help="print the safe text of a PDF file")
    for command in (scan, clean):
        command.add_argument("file")
        command.add_argument("-o", "--output")
        command.add_argument("--config")
    listing = commands.add_parser("samples", help="list the samples, and write them to a folder")
    listing.add_argument("folder", nargs="?")
    args = parser.parse_args(argv)
    try:
        return _run(args, spark)
    except (OSError, ValueError) as problem:
        sys.stderr.write(f"Error: {problem}\n")
        return 1


if __name__ == "__main__":
    sys.exit(main())
