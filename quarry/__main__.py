"""Command line: the registered queries, and the engine over a folder of tables.

``list`` names the queries; ``run NAME FOLDER`` runs one.  ``ingest FOLDER HITS`` adds a source's hits, ``build FOLDER`` builds what is
stale; ``search``, ``chunks``, ``communities``, ``facets``, ``ideas``, ``retrieve``, ``document`` and ``neighbours`` ask; ``status``
counts the tables; ``profile QUERY`` shows how a query is read.
"""

from __future__ import annotations

import argparse
import json
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="quarry")
    commands = out.add_subparsers(dest="command", required=True)
    commands.add_parser("list", help="names of the registered queries")
    run = commands.add_parser("run", help="a registered query over a folder of tables")
    run.add_argument("name")
    run.add_argument("folder")
    run.add_argument("--out", help="write Parquet here instead of showing rows")
    for name, about in (("build", "build the indexes"), ("status", "count the tables")):
        commands.add_parser(name, help=about).add_argument("folder")
    take = commands.add_parser("ingest", help="add a source's hits to the library")
    take.add_argument("folder")
    take.add_argument("hits", help="text files, a hit as JSON a line")
    one = commands.add_parser("document", help="a work, its chunks and whether it is ready")
    one.add_argument("folder")
    one.add_argument("work_id", type=int)
    for name, about in (("search", "ranked works"), ("chunks", "ranked chunks"), ("retrieve", "what the query's route asks for"), ("communities", "ranked summaries of communities"), ("facets", "ranked facets"), ("ideas", "communities as starting points")):
        ask = commands.add_parser(name, help=about)
        ask.add_argument("folder")
        ask.add_argument("query")
        ask.add_argument("--collection")
        ask.add_argument("--limit", type=int, default=10)
        if name == "search":
            ask.add_argument("--expand", type=int, default=0, help="neighbours of the best that support them")
    near = commands.add_parser("neighbours", help="works coupled or cited with one")
    near.add_argument("folder")
    near.add_argument("work_id", type=int)
    near.add_argument("--limit", type=int, default=10)
    near.add_argument("--kind", default="all", choices=("all", "bibliographic", "co_citation", "similarity"))
    near.add_argument("--collection")
    commands.add_parser("profile", help="how a query is read").add_argument("query")
    return out


def shown(df: DataFrame) -> str:
    return "\n".join(json.dumps(r.asDict(recursive=True), ensure_ascii=False, default=str) for r in df.collect())


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    if args.command == "profile":
        from quarry.functions import query as Q

        target, expand = Q.route(args.query)
        print(json.dumps({**asdict(Q.analyze(args.query)), "embedded": Q.embedded_form(Q.analyze(args.query)), "target": target, "expand": expand}, ensure_ascii=False))
        return
    from quarry.plans import catalog

    if args.command == "list":
        print("\n".join(sorted(catalog.QUERIES)))
        return
    if args.command == "run" and args.name not in catalog.QUERIES:
        raise SystemExit(f"no query is named {args.name}")
    spark = SparkSession.builder.appName("quarry").getOrCreate()
    if args.command == "run":
        df = catalog.QUERIES[args.name](spark, args.folder)
        df.write.parquet(args.out) if args.out else df.show(50, truncate=120)
        return
    from quarry.engine import Engine

    engine = Engine(spark, args.folder)
    if args.command in ("build", "status"):
        print(json.dumps(getattr(engine, args.command)()))
    elif args.command == "ingest":
        print(json.dumps(engine.ingest(spark.read.text(args.hits))))
    elif args.command == "document":
        print(json.dumps(engine.document(args.work_id), ensure_ascii=False, default=str))
    elif args.command in ("communities", "facets"):
        print(shown(getattr(engine, f"search_{args.command}")(args.query, args.limit, args.collection)))
    elif args.command == "ideas":
        print(json.dumps(engine.ideas(args.query, args.limit, args.collection), ensure_ascii=False))
    elif args.command == "neighbours":
        print(shown(engine.neighbours(args.work_id, args.limit, args.kind, args.collection)))
    elif args.command == "search":
        print(shown(engine.search_works(args.query, args.collection, args.limit, args.expand)))
    elif args.command == "chunks":
        print(shown(engine.search_chunks(args.query, args.collection, args.limit)))
    else:
        found = engine.retrieve(args.query, args.collection, args.limit)
        print(json.dumps({k: found[k] for k in ("target", "collection", "summaries")}))
        print(shown(found["works"]))
        print(shown(found["chunks"]))


if __name__ == "__main__":
    main()
