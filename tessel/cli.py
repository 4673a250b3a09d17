"""Command line: run a query of the catalogue, difference two test sets, summarise traces, judge answers.

Exit codes: 0 done, 1 a gate failed, 3 bad input."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import functions as F

from tessel import __version__
from tessel.functions import text as X
from tessel.operators import evaluation as E
from tessel.operators import monitoring as M
from tessel.plans import catalogue, reports
from tessel.session import session
from tessel.sources import files


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tessel")
    p.add_argument("--json", action="store_true", help="an envelope of JSON instead of a table")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("version")
    sub.add_parser("queries")
    q = sub.add_parser("run")
    q.add_argument("name")
    q.add_argument("folder")
    q.add_argument("--limit", type=int, default=20)
    e = sub.add_parser("evaluate")
    e.add_argument("runs", help="Parquet of query_id, retrieved, relevant")
    e.add_argument("--k", type=int, default=10)
    e.add_argument("--fail-under", type=float)
    d = sub.add_parser("diff")
    d.add_argument("old")
    d.add_argument("new")
    d.add_argument("--key", default="text")
    t = sub.add_parser("traces")
    t.add_argument("path")
    t.add_argument("--now", required=True)
    t.add_argument("--page", action="store_true")
    j = sub.add_parser("judge")
    j.add_argument("path", help="Parquet of id, answer")
    return p


def main(args: list[str] | None = None, spark=None) -> int:
    a = parser().parse_args(args)
    if a.command == "version":
        print(__version__)
        return 0
    if a.command == "queries":
        print("\n".join(catalogue.QUERIES))
        return 0
    spark = spark or session()
    code, extra = 0, {}
    if a.command == "run":
        if a.name not in catalogue.QUERIES:
            print(f"no query {a.name}", file=sys.stderr)
            return 3
        out = catalogue.QUERIES[a.name](spark, a.folder).limit(a.limit)
    elif a.command == "evaluate":
        scored = E.score_runs(spark.read.parquet(a.runs), a.k)
        out = E.summarise(scored.withColumn("run", F.lit("run")), ["run"])
        row = out.first()
        mean = sum(row[m] for m in E.MEASURES) / 4 if row else 0.0
        extra["mean"] = mean
        code = int(a.fail_under is not None and mean < a.fail_under)
    elif a.command == "diff":
        old, new = (files.read_testset(spark, x) for x in (a.old, a.new))
        out = E.dataset_diff(old, new, a.key, ["ground_truth_docs", "expected_answer"] + (["text"] if a.key != "text" else [])).where("change <> 'unchanged'")
    elif a.command == "traces":
        out = M.snapshot(spark.read.parquet(a.path), F.lit(a.now).cast("timestamp"))
        if a.page:
            print(M.metrics_page(out.first()))
            return 0
    else:
        out = spark.read.parquet(a.path).select("id", X.judge_parse(F.col("answer")).alias("j")).select("id", "j.*")
    print(reports.as_json(out, command=a.command, code=code, **extra) if a.json else reports.console(out) + ("\n" + json.dumps(extra) if extra else ""))
    return code


if __name__ == "__main__":
    sys.exit(main())
