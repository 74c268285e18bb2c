"""python -m annalist VERB: list, stats, run, leaderboard, usage, plan or smoke over a folder of Parquet tables; questions, judge-submission and cost over tiers of files."""

from __future__ import annotations

import argparse
import sys


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="annalist", description=__doc__)
    verbs = p.add_subparsers(dest="verb", required=True)
    verbs.add_parser("list", help="names of all queries")
    for name, text in (("stats", "documents by source"), ("leaderboard", "systems by tier"), ("usage", "calls and costs with totals"), ("plan", "what a budget covers"), ("smoke", "one query, as a test of the set-up")):
        verbs.add_parser(name, help=text).add_argument("folder")
    run = verbs.add_parser("run", help="one query, written as Parquet")
    for name in ("query", "folder", "out"):
        run.add_argument(name)
    of = {"questions": "counts of a tier's questions", "judge-submission": "a dry run's record of predictions; their verdicts need a judge", "cost": "what each system on each tier would cost"}
    for name, text in of.items():
        sub = verbs.add_parser(name, help=text)
        sub.add_argument("root", help="the folder of companies")
        sub.add_argument("--company", required=True)
        sub.add_argument("--tier", required=name != "cost", nargs="+" if name == "cost" else None)
        if name == "judge-submission":
            for option in ("--file", "--system", "--out"):
                sub.add_argument(option, required=option != "--out")
        if name == "cost":
            sub.add_argument("--budget", type=float, default=float("inf"))
    return p


def over_files(given, spark) -> int:
    """The verbs that read tiers of files."""
    from pyspark.sql import functions as F

    from annalist.operators import costs, evaluation
    from annalist.plans import reports
    from annalist.sources import harness

    if given.verb == "cost":
        sizes = None
        for tier in given.tier or ("small", "medium", "large"):
            folder = harness.tier_dir(spark, given.root, tier, given.company)
            own = harness.tier_size(harness.json_lines(spark, f"{folder}/corpus_index.jsonl", harness.INDEX), harness.questions(spark, folder)).withColumn("tier", F.lit(tier))
            sizes = own if sizes is None else sizes.unionByName(own)
        print(reports.budget(costs.within(costs.estimate(sizes), given.budget)))
        return 0
    folder = harness.tier_dir(spark, given.root, given.tier, given.company)
    questions = harness.questions(spark, folder)
    if given.verb == "questions":
        print(reports.markdown(evaluation.question_stats(questions).orderBy("kind", "key")))
        return 0
    predictions = harness.submission(spark, given.file)
    print(reports.markdown(evaluation.validated(questions.select("id"), predictions).orderBy("kind")))
    record = evaluation.full_records(harness.judged(questions, predictions, given.system), ["system"]).withColumns({"company": F.lit(given.company), "tier": F.lit(given.tier), "dry_run": F.lit(True)})
    if given.out:
        harness.write_record(record, given.out)
    print(reports.markdown(record.withColumns({c: F.to_json(c) for c in ("by_category", "by_difficulty", "failure_modes")})))
    return 0


def main(args: list[str] | None = None, spark=None) -> int:
    from annalist.plans import registry, reports

    known, given = registry.QUERIES, parser().parse_args(args)
    if given.verb == "list":
        print("\n".join(sorted(known)))
        return 0
    if given.verb == "run" and given.query not in known:
        print(f"no query {given.query}; known: {', '.join(sorted(known))}", file=sys.stderr)
        return 2
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("annalist").getOrCreate()
    if given.verb in ("questions", "judge-submission", "cost"):
        return over_files(given, spark)
    if given.verb == "run":
        known[given.query](spark, given.folder).write.parquet(given.out)
        return 0
    rows = known[{"stats": "corpus_stats", "leaderboard": "leaderboard_pivot", "usage": "usage_rollup", "plan": "budget_plan", "smoke": "set_validate"}[given.verb]](spark, given.folder)
    print({"leaderboard": reports.leaderboard, "plan": reports.budget}.get(given.verb, reports.markdown)(rows))
    return 0


if __name__ == "__main__":
    sys.exit(main())
