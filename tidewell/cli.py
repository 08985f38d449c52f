"""Command line: `python -m tidewell.cli TABLES COMMAND ...` over a folder with the test tables, or a query by name."""

from __future__ import annotations

import argparse
import json
import sys

from tidewell.session import session


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidewell", description=__doc__)
    p.add_argument("tables", help="folder of Parquet tables")
    p.add_argument("--viewer", help="room whose view is taken; without it nothing is hidden")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("list", help="names of all registered queries")
    one = sub.add_parser("query", help="run a registered query")
    one.add_argument("name")
    one.add_argument("--out", help="Parquet folder to write; without it rows are shown")
    one.add_argument("--show", type=int, default=20)
    one.add_argument("--explain", action="store_true")
    text = sub.add_parser("search")
    text.add_argument("text")
    text.add_argument("--limit", type=int, default=10)
    text.add_argument("--expand", type=int, default=0, help="so many hits with their card's detail")
    text.add_argument("--index", help="folder of a stored index; without it the cards are read")
    new = sub.add_parser("recent")
    new.add_argument("--limit", type=int, default=20)
    new.add_argument("--since")
    new.add_argument("--until")
    new.add_argument("--expand", type=int, default=0)
    near = sub.add_parser("context")
    near.add_argument("card_id")
    near.add_argument("--limit", type=int, default=5)
    near.add_argument("--mode", choices=["around", "before"], default="around")
    show = sub.add_parser("card")
    show.add_argument("ids", nargs="+")
    show.add_argument("--turns", action="store_true")
    least = sub.add_parser("wander")
    least.add_argument("--limit", type=int, default=5)
    least.add_argument("--seed", type=int)
    least.add_argument("--expand", type=int, default=0)
    past = sub.add_parser("history", help="the document of a room's or a context's history")
    past.add_argument("room")
    past.add_argument("--source")
    past.add_argument("--context")
    past.add_argument("--most", type=int, default=10_000)
    find = sub.add_parser("history-search", help="contexts whose conversation has all words")
    find.add_argument("text")
    find.add_argument("--limit", type=int, default=20)
    find.add_argument("--offset", type=int, default=0)
    dump = sub.add_parser("dump", help="turns as JSON lines")
    dump.add_argument("out")
    dump.add_argument("--tail", type=int, help="only so many last rounds of each session")
    pack = sub.add_parser("bundle", help="what the viewer may take along, a Parquet folder a table")
    pack.add_argument("out")
    words = sub.add_parser("reindex", help="store the search index")
    words.add_argument("index")
    words.add_argument("--buckets", type=int, default=64)
    gate = sub.add_parser("gate", help="sessions whose cards may be made now")
    gate.add_argument("--now", default="2024-01-29 12:00:00")
    gate.add_argument("--rounds", type=int, default=5)
    gate.add_argument("--minutes", type=int, default=60)
    step = sub.add_parser("migrate", help="bring stored tables to this engine's schema")
    step.add_argument("store")
    step.add_argument("names", nargs="+")
    sub.add_parser("serve", help="answer requests, a JSON object a line, on standard input")
    watch = sub.add_parser("watch", help="stream new journals of a folder into a store")
    watch.add_argument("folder")
    watch.add_argument("store")
    watch.add_argument("checkpoint")
    watch.add_argument("--once", action="store_true")
    return p


def maintain(args: argparse.Namespace, c) -> int | None:
    """Commands that write tables or read a whole history; None for the others."""
    from pyspark.sql import functions as F

    from tidewell import publish, schema
    from tidewell.operators import cards, history, search, tree

    show = lambda rows: print(json.dumps([json.loads(r) for r in rows.toJSON().collect()], ensure_ascii=False, indent=1))
    try:
        if args.command == "history":
            roots = tree.node_root(c.forest).select("node_id", "root")
            print(json.dumps(history.render(c.forest, roots, c.observations, args.room, args.source, args.context, args.most), ensure_ascii=False, indent=1))
        elif args.command == "history-search":
            roots = tree.node_root(c.forest).select("node_id", "root")
            show(search.history_search(c.forest, roots, tree.catalog(c.observations), search.history_terms(args.text), min(max(args.limit, 1), 100), max(args.offset, 0)).orderBy("rank"))
        elif args.command == "dump":
            publish.dump_json(c.turns, args.out, args.tail)
        elif args.command == "bundle":
            if not args.viewer:
                raise ValueError("a bundle needs --viewer")
            none = c.cards.select(F.lit("").alias("constant_id"), "room", F.lit(False).alias("shared"), F.lit("").alias("content"), F.lit(False).alias("active")).limit(0)
            publish.write_bundle(publish.bundle(c.cards, c.card_tags, c.clusters, c.members, tree.subtree(c.clusters), none, c.turns, args.viewer), args.out)
        elif args.command == "reindex":
            search.SearchIndex(c.spark, args.index, args.buckets).replace(c.cards)
        elif args.command == "gate":
            show(cards.card_gate(c.turns, c.model_calls, args.now, args.rounds, args.minutes).where("open").orderBy("session_id").limit(1000))
        elif args.command == "migrate":
            print(schema.migrate(c.spark, args.store, args.names))
        else:
            return None
    except ValueError as problem:
        print(problem, file=sys.stderr)
        return 2
    return 0


def run(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    from tidewell.plans.queries import QUERIES

    if args.command == "list":
        print("\n".join(QUERIES))
        return 0
    spark = session()
    if args.command == "query":
        if args.name not in QUERIES:
            print(f"no query {args.name}", file=sys.stderr)
            return 2
        frame = QUERIES[args.name](spark, args.tables)
        if args.explain:
            frame.explain("formatted")
        elif args.out:
            frame.write.mode("overwrite").parquet(args.out)
        else:
            frame.show(args.show, truncate=80)
        return 0
    if args.command == "watch":
        from tidewell.streaming.ingest import TurnStore, watch

        watch(spark, args.folder, TurnStore(spark, args.store), args.checkpoint, once=args.once).awaitTermination()
        return 0
    from tidewell.plans.corpus import Corpus
    from tidewell.tools import RequestError, Tools

    c = Corpus(spark, args.tables)
    if (code := maintain(args, c)) is not None:
        return code
    from tidewell.operators.search import SearchIndex

    stored = SearchIndex(spark, args.index) if getattr(args, "index", None) else None
    tools = Tools(c.cards, c.turns, c.card_tags, c.access, args.viewer, index=stored)
    try:
        if args.command == "serve":
            tools.serve()
            return 0
        out = {
            "search": lambda: tools.search(args.text, args.limit, args.expand),
            "recent": lambda: tools.recent(args.limit, args.since, args.until, args.expand),
            "context": lambda: tools.session_context(args.card_id, args.limit, args.mode),
            "card": lambda: tools.card(args.ids, args.turns),
            "wander": lambda: tools.wander(args.limit, args.expand, args.seed),
        }[args.command]()
    except RequestError as problem:
        print(problem, file=sys.stderr)
        return 2
    print(json.dumps(out, ensure_ascii=False, indent=1))
    return 0


if __name__ == "__main__":
    sys.exit(run())
