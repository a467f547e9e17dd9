"""Jobs for spark-submit: ``index``, ``prompts``, ``diagnose`` and ``evaluate``.

Model calls happen outside: ``prompts`` writes what a model is to answer, ``diagnose`` and ``evaluate`` read its
replies as JSON lines of (incident_id, text).
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession

from runlore.operators.features import HashedTfIdf
from runlore.operators.language import language_profiles
from runlore.operators.vector_table import VectorTable
from runlore.plans.diagnosis import diagnoses, incident_queries, prompts
from runlore.plans.evaluation import evaluate
from runlore.plans.index_build import build_index, open_index
from runlore.plans.retrieval import retrieve
from runlore.session import clean_scratch, get_spark, materialise, ship_package
from runlore.settings import EmbedSettings, RetrievalSettings, Settings
from runlore.sources.base import Alerts, RemoteTickets, TextFiles, TicketFiles, WikiPages, ingest
from runlore.sources.incidents import read_eval_samples, read_incidents, validate_incidents, write_results

REPLIES = "incident_id string, text string"


def _featurizer(args) -> HashedTfIdf:
    return HashedTfIdf(args.dimensions)


def index(spark: SparkSession, args) -> None:
    sources = [TicketFiles(args.tickets), TextFiles(args.files, tuple(args.patterns))]
    sources += [RemoteTickets(args.remote)] if args.remote else []
    sources += [WikiPages(args.wiki, args.wiki_url)] if args.wiki else []
    sources += [Alerts(args.alerts)] if args.alerts else []
    read = ingest(spark, sources, language_profiles(spark.read.parquet(args.labelled)) if args.labelled else None)
    for w in read.warnings:
        print(w, file=sys.stderr)
    documents = materialise(read.documents)
    table = VectorTable(spark, f"{args.index}/table")
    model = f"{args.index}/featurizer"
    # A new table or a rebuild fits the featurizer; additions must use the one the table was built with.
    fresh = args.rebuild or not table.commit().folders
    fitted = _featurizer(args).fit(documents, "content_text") if fresh else _featurizer(args).load(model)
    if fresh:
        fitted.save(model)
    settings = Settings(embed=EmbedSettings(dimensions=args.dimensions))
    build_index(documents, table, fitted, settings, None if fresh else f"{args.index}/cache", args.rebuild).show(truncate=False)
    read.counts.show(truncate=False)


def _knowledge(spark: SparkSession, args):
    return open_index(VectorTable(spark, f"{args.index}/table"), _featurizer(args).load(f"{args.index}/featurizer"))


def _prompts(spark: SparkSession, args) -> DataFrame:
    valid, rejected = validate_incidents(read_incidents(spark, args.incidents))
    if not rejected.isEmpty():
        rejected.select("incident_id", "reasons").show(truncate=False)
    settings = RetrievalSettings()
    found = retrieve(incident_queries(valid, settings.filter_keys), _knowledge(spark, args), settings)
    return materialise(prompts(valid, found))


def write_prompts(spark: SparkSession, args) -> None:
    write_results(_prompts(spark, args), args.output)


def diagnose(spark: SparkSession, args) -> None:
    write_results(diagnoses(_prompts(spark, args), spark.read.schema(REPLIES).json(args.replies)), args.output)


def run_evaluation(spark: SparkSession, args) -> None:
    replies = spark.read.schema(REPLIES).json(args.replies)
    out = evaluate(read_eval_samples(spark, args.dataset), _knowledge(spark, args), lambda prompt_rows: replies)
    write_results(out, args.output)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="runlore")
    parser.add_argument("--master")
    jobs = parser.add_subparsers(required=True)

    def job(name, run, *options):
        p = jobs.add_parser(name)
        p.set_defaults(run=run)
        p.add_argument("--index", required=True)
        p.add_argument("--dimensions", type=int, default=512)
        for o in options:
            p.add_argument(f"--{o}", required=True)
        return p

    p = job("index", index, "tickets", "files")
    p.add_argument("--patterns", nargs="+", default=["*.md", "*.txt", "*.rst"])
    p.add_argument("--remote", help="landed records of a remote ticket table")
    p.add_argument("--wiki", help="landed wiki pages")
    p.add_argument("--wiki-url", default="")
    p.add_argument("--alerts", help="Parquet events")
    p.add_argument("--labelled", help="Parquet of (lang, text) to learn languages from")
    p.add_argument("--rebuild", action="store_true")
    job("prompts", write_prompts, "incidents", "output")
    job("diagnose", diagnose, "incidents", "replies", "output")
    job("evaluate", run_evaluation, "dataset", "replies", "output")
    args = parser.parse_args(argv)
    spark = get_spark(master=args.master)
    ship_package(spark)
    try:
        args.run(spark, args)
    finally:
        clean_scratch(spark)


if __name__ == "__main__":
    main()
