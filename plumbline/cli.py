"""Command line: scan, calibrate, baseline, config, eval, fairness, explain.

Exit codes: 0 clean, 1 findings at or over --fail-on or new ones, 2 wrong usage, missing or malformed files.
"""

from __future__ import annotations

import argparse
import dataclasses
import json
import os
import sys

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline import settings as st
from plumbline.functions.features import prepare
from plumbline.functions.scoring import score
from plumbline.operators import baseline, batch, calibrate, evaluate, evidence
from plumbline.operators.stored import stored
from plumbline.rules import load_rules
from plumbline.sinks import console, reports
from plumbline.sources import readers

GUIDE = "Each dimension is 0 to 1; their weighted sum, squeezed to 0 to 100, is the score. Under 25 is low, under 50 mild, under 75 elevated, else severe. Texts under 100 words or not in English get no label above mild."


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="plumbline")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("scan", "calibrate", "baseline"):
        c = sub.add_parser(name)
        c.add_argument("paths", nargs="+")
        c.add_argument("--recursive", action="store_true")
        c.add_argument("--profile", choices=sorted(st.PROFILES))
        c.add_argument("--strictness", choices=sorted(st.GAINS))
        c.add_argument("--scorer", choices=("rules", "ml"))
        c.add_argument("--output")
        c.add_argument("--config", help="settings file in place of the nearest one")
        c.add_argument("--rules", action="append", default=[], help="file or folder of further rules")
        if name == "scan":
            c.add_argument("--format", choices=("console", "json", "markdown", "html", "sarif"), default="console")
            c.add_argument("--fail-on", choices=("low", "medium", "high", "none"), default="none")
            c.add_argument("--baseline-file")
            c.add_argument("--fail-on-new", action="store_true")
            c.add_argument("--suggest", action="store_true", default=None)
            c.add_argument("--json-path")
            c.add_argument("--calibration", help="profile that calibrate wrote")
            c.add_argument("--by-paragraph", action="store_true")
            c.add_argument("--diff", metavar="REF", help="of the paths, only files that differ from this git ref")
    for name in ("eval", "fairness"):
        c = sub.add_parser(name)
        c.add_argument("dataset")
        c.add_argument("--threshold", type=float, default=0.2)
    sub.add_parser("config")
    sub.add_parser("explain")
    return p


def _at(path: str) -> str:
    """The path as Spark has to have it, whose working folder may be another one."""
    return path if "://" in path else os.path.abspath(path)


def _read(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """The readable files; one warning line for each other file."""
    if args.paths == ["-"]:
        return readers.from_strings(spark, [sys.stdin.read()], "-")
    if getattr(args, "diff", None):
        args.paths = readers.changed(args.paths, args.diff)
    args.paths = [_at(p) for p in args.paths]
    if missing := [p for p in args.paths if "://" not in p and not os.path.exists(p)]:
        raise ValueError(f"no such file: {', '.join(missing)}")
    docs = readers.read_files(spark, args.paths, args.recursive, getattr(args, "json_path", None))
    for r in docs.where("not valid").select("source").toLocalIterator():
        print(f"skipped, not UTF-8: {r.source}", file=sys.stderr)
    return docs.where("valid").drop("valid")


def _scan(spark: SparkSession, args: argparse.Namespace, settings: st.Settings) -> int:
    docs = _read(spark, args)
    if args.by_paragraph:
        for r in batch.by_paragraph(docs, settings, "source").orderBy(F.desc("slop_score"), "source", "paragraph").toLocalIterator():
            print(f"{r.slop_score:5.1f} {r.label:8} {r.source} paragraph {r.paragraph + 1}: {' '.join(r.text.split())[:80]}")
        return 0
    scored = evidence.with_evidence(score(docs, settings, places=True), settings)
    extra: tuple[str, ...] = ()
    if args.calibration:
        scored, extra = calibrate.beside(scored, calibrate.read(spark, _at(args.calibration))), ("deviations",)
    scored = stored(scored)
    found = scored.select("source", F.posexplode_outer("evidence").alias("ordinal", "e")).where("e is not null").select("source", "ordinal", "e.*")
    many = scored.count() != 1
    column = {"json": reports.to_json(settings, "source", "source_type", extra), "markdown": reports.to_markdown(), "html": reports.to_html(), "sarif": reports.to_sarif()}.get(args.format)
    if args.output and column is not None:
        reports.write_text(scored, column, _at(args.output))
    elif args.format == "sarif":
        print(reports.sarif_log([r[0] for r in scored.select(column).toLocalIterator()]))
    elif args.format in ("json", "console") and many:
        summary = batch.summary(scored, found, "source").first()
        print((console.batch_json if args.format == "json" else console.batch)(summary))
    elif column is not None:
        for r in scored.select(column).toLocalIterator():
            print(r[0])
    else:
        print(console.single(scored.first()))
    if args.baseline_file and args.fail_on_new:
        return int(not baseline.new(found, baseline.read(spark, _at(args.baseline_file)), "source").isEmpty())
    return int(baseline.max_severity(found).first()[0] >= baseline.threshold_rank(args.fail_on))


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    path = getattr(args, "config", None) or st.discover(os.getcwd())
    try:
        if path and not os.path.exists(path):
            raise ValueError(f"no such file: {path}")
        flags = {k: getattr(args, k, None) for k in ("profile", "strictness", "scorer", "suggest")}
        settings = st.resolve(flags, st.load(path) if path else {})
        extra = tuple(r for p in getattr(args, "rules", []) for r in load_rules(p))
        settings = dataclasses.replace(settings, extra_rules=extra)
    except (ValueError, TypeError, OSError) as e:
        print(e, file=sys.stderr)
        return 2
    if args.command == "explain":
        print(GUIDE)
        return 0
    if args.command == "config":
        print(json.dumps(dataclasses.asdict(settings), default=sorted, indent=2))
        return 0
    spark = SparkSession.builder.appName("plumbline").getOrCreate()
    try:
        return _run(spark, args, settings)
    except (ValueError, OSError, AnalysisException) as e:
        print(str(e).split("\n")[0], file=sys.stderr)
        return 2


def _run(spark: SparkSession, args: argparse.Namespace, settings: st.Settings) -> int:
    if args.command == "scan":
        return _scan(spark, args, settings)
    if args.command == "baseline":
        rows = evidence.findings(prepare(_read(spark, args), settings), settings, ("source",))
        baseline.write(baseline.build(rows, "source"), _at(args.output or "baseline.parquet"))
    elif args.command == "calibrate":
        calibrate.profile(score(_read(spark, args), settings)).write.mode("overwrite").parquet(_at(args.output or "profile.parquet"))
    else:
        rows = readers.labelled(spark, _at(args.dataset)).withColumn("doc_id", F.xxhash64("text"))
        scored = score(rows.withColumnRenamed("label", "_truth"), settings).select(F.col("_truth").alias("label"), F.col("slop_score").alias("score"), "abstained", "subgroup")
        if args.command == "eval":
            scored = stored(scored)
            whole = evaluate.metrics(scored).first().asDict()
            groups = {r.subgroup: {k: v for k, v in r.asDict().items() if k != "subgroup"} for r in evaluate.subgroups(scored).toLocalIterator()}
            print(json.dumps(whole | {"subgroups": groups}, indent=2, sort_keys=True))
        else:
            evaluate.rule_rates(evidence.findings(prepare(rows, settings), settings), rows.where("label = 0"), flag_over=args.threshold).orderBy(F.desc("docs")).show(100, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
