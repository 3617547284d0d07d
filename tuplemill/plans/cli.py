"""The batch stages from the command line: ``python -m tuplemill.plans.cli JOB INPUT... OUTPUT [--option value]``.

Run it through spark-submit on a cluster, with ``spark.checkpoint.dir`` set to a folder that all machines share.
"""

from __future__ import annotations

import argparse
from urllib.parse import parse_qs

from pyspark.sql import SparkSession

from tuplemill.operators import inverted, search
from tuplemill.plans import jobs


def _flag(text: str) -> bool:
    if text.lower() not in ("true", "false"):
        raise argparse.ArgumentTypeError("true or false")
    return text.lower() == "true"


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tuplemill", description=__doc__)
    each = top.add_subparsers(dest="job", required=True)
    d = jobs.Defaults()

    def job(name: str, about: str, *paths: str, from_lines: bool = True, lines: bool = True) -> argparse.ArgumentParser:
        one = each.add_parser(name, help=about)
        for p in paths:
            one.add_argument(p)
        if from_lines:
            one.add_argument("--from-lines", action="store_true", help="inputs are lines, not Parquet")
        if lines:
            one.add_argument("--lines", action="store_true", help="outputs are lines, not Parquet")
        return one

    job("prepare", "record lines to pruned records", "records", "out", from_lines=False)
    one = job("merge", "document lines and lines with mentions to document lines with these mentions", "documents", "mentions", "out", from_lines=False, lines=False)
    one = job("resolve", "document lines to lines with mentions, by the resolver of plain rules", "documents", "out", from_lines=False, lines=False)
    one.add_argument("--timeout", type=float, default=30.0, help="seconds for a document")
    one = job("extract", "pruned records to tuple pairs and tuples", "records", "out")
    one.add_argument("--mentions", help="mentions as Parquet; lines have their own")
    one.add_argument("--window", type=int, default=d.window)
    one.add_argument("--kept", type=int, default=d.kept, help="ids, sentences and heads kept")
    one.add_argument("--max-hashes", type=int, default=d.max_hashes)
    one.add_argument("--equality", type=_flag, default=d.equality)
    one.add_argument("--noequality", type=_flag, default=d.noequality)
    one.add_argument("--tuples-only", type=_flag, default=d.tuples_only)
    one = job("filter", "tuple pairs to frequent ones", "pairs", "out")
    one.add_argument("--window", type=int, default=jobs.M.FILTER_WINDOW)
    one.add_argument("--least", type=int, default=jobs.M.FILTER_MIN)
    one.add_argument("--at-least", action="store_true", help="keep pairs that just reach the least count")
    one = job("measure", "tuple pairs and tuples to measures", "pairs", "tuples", "out")
    one.add_argument("--window", type=int, default=d.measure_window)
    one.add_argument("--directed", type=int, default=d.min_directed)
    one.add_argument("--undirected", type=int, default=d.min_undirected)
    one = job("index", "measures to a searchable index", "measures", "out", lines=False)
    one.add_argument("--alpha", type=float, default=d.alpha)
    one.add_argument("--delta", type=float, default=d.delta)
    one.add_argument("--least", type=int, default=d.index_min)
    job("index-records", "records to a table that is looked up by id", "records", "out", lines=False)
    job("statistics", "document lines to a histogram of their sizes", "documents", "out", from_lines=False, lines=False)
    one = job("search", "prints the results of a request, as arg1=...&rel=...&sortBy=...", "index", "request", from_lines=False, lines=False)
    one.add_argument("--limit", type=int, default=20)
    one.add_argument("--least", type=int, default=0)
    return top


def run(spark: SparkSession, arguments: list[str]) -> dict[str, int] | None:
    """Runs a job; gives the counts of input lines if it read any."""
    a = parser().parse_args(arguments)
    d = jobs.Defaults
    match a.job:
        case "prepare":
            return jobs.prepare(spark, a.records, a.out, a.lines)
        case "merge":
            return jobs.merge_mentions(spark, a.documents, a.mentions, a.out)
        case "resolve":
            return jobs.resolve(spark, a.documents, a.out, timeout=a.timeout)
        case "extract":
            values = d(window=a.window, kept=a.kept, max_hashes=a.max_hashes, equality=a.equality, noequality=a.noequality, tuples_only=a.tuples_only)
            jobs.extract(spark, a.records, a.out, a.mentions, values, a.from_lines, a.lines)
        case "filter":
            jobs.frequency_filter(spark, a.pairs, a.out, a.window, a.least, not a.at_least, a.from_lines, a.lines)
        case "measure":
            values = d(measure_window=a.window, min_directed=a.directed, min_undirected=a.undirected)
            jobs.measure(spark, a.pairs, a.tuples, a.out, values, a.from_lines, a.lines)
        case "index":
            jobs.build_index(spark, a.measures, a.out, d(alpha=a.alpha, delta=a.delta, index_min=a.least), a.from_lines)
        case "index-records":
            jobs.index_records(spark, a.records, a.out, a.from_lines)
        case "statistics":
            return jobs.statistics(spark, a.documents, a.out)
        case "search":
            query = search.Query.of(parse_qs(a.request))
            search.display(search.search(inverted.InvertedIndex(spark, a.index), query, limit=a.limit)).show(a.limit, truncate=False)
    return None


def main(arguments: list[str] | None = None) -> None:
    spark = SparkSession.builder.appName("tuplemill").getOrCreate()
    counts = run(spark, arguments)
    if counts:
        print(counts)


if __name__ == "__main__":
    main()
