"""Command line: python -m tidewrack.cli build-index|search|dry-run|stats|selfcheck|init-demo ..."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidewrack.operators import frontier, index
from tidewrack.plans import search, selfcheck
from tidewrack.sources import demo, tables


def main(argv: list[str] | None = None) -> None:
    top = argparse.ArgumentParser(prog="tidewrack")
    sub = top.add_subparsers(dest="task", required=True)
    build = sub.add_parser("build-index", help="index documents (JSON lines) into a folder")
    build.add_argument("documents")
    build.add_argument("out")
    find = sub.add_parser("search", help="search documents (JSON lines), by a built index if one is given")
    find.add_argument("documents")
    find.add_argument("query")
    find.add_argument("--index")
    find.add_argument("--backend", default="auto")
    find.add_argument("-n", type=int, default=10)
    dry = sub.add_parser("dry-run", help="order the next addresses to fetch")
    dry.add_argument("frontier")
    dry.add_argument("fetched")
    dry.add_argument("--quota", type=int, default=50)
    dry.add_argument("--target-new", type=int, default=30000)
    sub.add_parser("stats", help="figures of a corpus (JSON lines)").add_argument("documents")
    check = sub.add_parser("selfcheck", help="the acceptance run on documents (JSON lines) and their built index")
    check.add_argument("documents")
    check.add_argument("index")
    check.add_argument("--query", default="library")
    check.add_argument("--site", default="example.org")
    check.add_argument("--filetype", default="pdf")
    check.add_argument("--phrase", default='"of the library"')
    check.add_argument("--wildcard", default="libr*")
    check.add_argument("--regex", default="/[Rr]ule.{0,2}/")
    check.add_argument("--prefix", default="li")
    sub.add_parser("init-demo", help="write a small corpus: documents, links, frontier, snapshots").add_argument("out")
    args = top.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()

    def documents():
        docs = tables.read_documents_jsonl(spark, args.documents)
        return docs.withColumn("doc_id", F.xxhash64("url"))

    fields = {"title": "title", "anchor": "anchor_text", "attachment": "attachment_text", "body": "body"}
    if args.task == "build-index":
        index.store_index(documents(), fields, args.out)
    elif args.task == "search":
        ix = index.stored_index(spark, args.index) if args.index else None
        search.search(documents(), args.query, ix, fields=fields, n=args.n, backend=args.backend).select("place", "score", "url", "title", "snippet").show(args.n, truncate=120)
    elif args.task == "selfcheck":
        rows = selfcheck.measured(documents(), documents(), index.stored_index(spark, args.index), args.query, args.site, args.filetype, args.phrase, args.wildcard, args.regex, args.prefix)
        found = selfcheck.verdicts(rows).collect()
        for r in found:
            print(f"{r.name:<16}{r.verdict} {r.measured:g}")
        if any(r.verdict != "PASS" for r in found):
            raise SystemExit(1)
    elif args.task == "init-demo":
        demo.write(spark, args.out)
    elif args.task == "dry-run":
        seeds = tables.read_frontier(spark, args.frontier).select("url", F.parse_url("url", F.lit("HOST")).alias("host"), F.lit(0).alias("priority"), F.lit("seed").alias("source"))
        frontier.prepared([seeds], tables.read_frontier(spark, args.fetched), args.quota, args.target_new).select("url").show(args.target_new, truncate=False)
    else:
        index.corpus_stats(documents()).show()


if __name__ == "__main__":
    main()
