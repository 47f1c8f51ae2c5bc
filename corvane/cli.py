"""Jobs from the command line: python -m corvane.cli list | index | search | manifest | ingest | compare."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from corvane.operators import chunking, engine, index, keyed, reports
from corvane.operators.embedders import MODEL_ALIASES, MODELS, get_embedder
from corvane.session import build_session
from corvane.sources import files


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="corvane")
    jobs = out.add_subparsers(dest="job", required=True)
    jobs.add_parser("list", help="models by name")
    for name in ("index", "search", "manifest", "ingest", "compare"):
        jobs.add_parser(name)
    for name in ("index", "search", "ingest"):
        jobs.choices[name].add_argument("--index", required=True, help="folder of the index")
        jobs.choices[name].add_argument("--model", default="bag")
    for name in ("index", "manifest"):
        jobs.choices[name].add_argument("--root", required=True, help="folder of the documents")
        jobs.choices[name].add_argument("--suffix", action="append", help="formats to take, as they are spelled in file names; aliases don't count")
    jobs.choices["index"].add_argument("--add", action="store_true", help="add to the index instead of replacing it")
    jobs.choices["search"].add_argument("query")
    jobs.choices["search"].add_argument("--top-k", type=int, default=10)
    jobs.choices["manifest"].add_argument("--out", required=True)
    jobs.choices["ingest"].add_argument("--corpus", required=True, help="JSON lines with id, title, text")
    jobs.choices["compare"].add_argument("--baseline", required=True)
    jobs.choices["compare"].add_argument("runs", nargs="+", metavar="NAME=PREFIX")
    return out


def documents(spark: SparkSession, root: str, suffixes: Sequence[str] | None):
    """Files below root as the engine takes them; what counts is the suffix as it is spelled, in any case, and without suffixes those that name a format by themselves."""
    found, suffix = files.listed(spark, root, content=True), files.fx.suffix(F.col("path"))
    wanted = [s.lower().lstrip(".") for s in suffixes] if suffixes else list(files.fx.FORMATS)
    named = index.input_documents(found.where(F.coalesce(suffix.isin(wanted) & files.fx.format_of(F.col("path")).isNotNull(), F.lit(False))))
    return named.join(found.select(F.col("path").alias("file"), "content"), "file")


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> list[str]:
    """Runs a job, prints its lines and returns them."""
    args = parser().parse_args(argv)
    if args.job == "list":
        lines = [f"{name} ({'multi-vector' if multi else 'dense'})" for name, multi in sorted(MODELS.items())] + [f"{a} -> {b}" for a, b in sorted(MODEL_ALIASES.items())]
    else:
        spark = spark or build_session("corvane")
        lines = globals()[f"_{args.job}"](spark, args)
    print("\n".join(lines))
    return lines


def _engine(spark: SparkSession, args: argparse.Namespace) -> engine.Engine:
    return engine.Engine(get_embedder(args.model), keyed.open_index(spark, args.index))


def _index(spark: SparkSession, args: argparse.Namespace) -> list[str]:
    return [f"{len(_engine(spark, args).index(documents(spark, args.root, args.suffix), not args.add))} pages"]


def _search(spark: SparkSession, args: argparse.Namespace) -> list[str]:
    hits = _engine(spark, args).search(args.query, args.top_k)
    return [r["line"] for r in index.shown(hits, []).orderBy("rank").collect()]


def _manifest(spark: SparkSession, args: argparse.Namespace) -> list[str]:
    entries = engine.discovered_entries(files.discover(spark, args.root, args.suffix, with_checksum=True))
    engine.export_manifest(entries, args.out, ["checksum", "doc_id"])
    return [f"{engine.load_manifest(spark, args.out).count()} files"]


def _ingest(spark: SparkSession, args: argparse.Namespace) -> list[str]:
    corpus = files.read_jsonl(spark, args.corpus)
    passages = chunking.chunk(corpus, id_col="id").select("passage_id", "doc_id", "chunk", "text")
    return [f"{engine.ingest(passages, get_embedder(args.model), keyed.KeyedIndex(spark, args.index, "passage_id"))} passages"]


def _compare(spark: SparkSession, args: argparse.Namespace) -> list[str]:
    named = dict(r.split("=", 1) for r in args.runs)
    rows = None
    for run, prefix in named.items():
        one = files.read_stats(spark, prefix, run)
        rows = one if rows is None else rows.unionByName(one)
    return reports.markdown(reports.compared(rows, args.baseline), args.baseline).splitlines()


if __name__ == "__main__":
    main()
