"""Command line: ``python -m spindrift.cli init|index|search|symbol|references|files|stats|status|web|serve|watch|migrate|projects ...``."""

from __future__ import annotations

import argparse
import os

from .plans import render
from .plans.config import load
from .plans.engine import Engine
from .plans.projects import LOCAL_DIR, Registry, detect, needs_index, project_id, resolve
from .serve import http_server, serve_lines
from .session import session


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="spindrift")
    parser.add_argument("--path", default=".")
    parser.add_argument("--shared", default=os.path.expanduser("~/.spindrift"))
    verbs = parser.add_subparsers(dest="verb", required=True)
    verbs.add_parser("init")
    index = verbs.add_parser("index")
    index.add_argument("--force", action="store_true")
    search = verbs.add_parser("search")
    search.add_argument("query")
    search.add_argument("--limit", type=int)
    search.add_argument("--mode", choices=("vector", "bm25", "hybrid"))
    symbol = verbs.add_parser("symbol")
    symbol.add_argument("query")
    symbol.add_argument("--mode", default="fuzzy")
    refs = verbs.add_parser("references")
    refs.add_argument("name")
    files = verbs.add_parser("files")
    files.add_argument("glob", nargs="?")
    verbs.add_parser("stats")
    verbs.add_parser("status")
    web = verbs.add_parser("web")
    web.add_argument("--port", type=int, default=8080)
    verbs.add_parser("serve")
    verbs.add_parser("watch")
    migrate = verbs.add_parser("migrate")
    migrate.add_argument("--keep", action="store_true")
    projects = verbs.add_parser("projects")
    projects.add_argument("action", choices=("list", "add", "remove", "default"))
    projects.add_argument("name", nargs="?")
    args = parser.parse_args(argv)

    found = detect(args.path)
    registry = Registry(os.path.join(args.shared, "registry.json"))
    if args.verb == "init":
        os.makedirs(os.path.join(args.path, LOCAL_DIR), exist_ok=True)
        return 0
    if args.verb == "projects":
        if args.action == "add":
            registry.add(args.name, args.path)
        elif args.action == "remove":
            registry.remove(args.name)
        elif args.action == "default":
            registry.set_default(args.name)
        for p in sorted(registry.projects.values(), key=lambda p: p.name):
            print(("* " if p.name == registry.default else "  ") + f"{p.name}\t{p.path}\t{p.chunk_count}")
        return 0
    place = resolve(found.root, args.shared)
    config = load(os.path.join(found.root, LOCAL_DIR, "config.toml"), os.path.join(args.shared, "config.toml"))
    engine = Engine(session(master=os.environ.get("SPINDRIFT_MASTER", "local[*]")), found.root, place.base, config)
    if args.verb == "index":
        print(engine.index(args.force))
        return 0
    if args.verb == "search":
        exists = bool(engine.store.paths.exists(engine.store.POINTER))
        if needs_index(config.auto_index, exists, config.auto_index == "on_missing_or_stale" and exists and engine.stale()):
            engine.index()
        print(render.search_results(args.query, engine.search(args.query, args.limit, args.mode)))
    elif args.verb == "symbol":
        print(render.symbol_list(engine.find_symbol(args.query, mode=args.mode)))
    elif args.verb == "references":
        print(render.references(args.name, engine.find_references(args.name)))
    elif args.verb == "files":
        print(render.file_list(engine.list_files(args.glob), args.glob))
    elif args.verb == "web":
        http_server(engine, port=args.port).serve_forever()
    elif args.verb == "serve":
        serve_lines(engine)
    elif args.verb == "watch":
        engine.watch(f"{place.base}/watch").awaitTermination()
    elif args.verb == "migrate":
        target = os.path.join(args.shared, project_id(found.root))
        engine.store.migrate(f"{target}/chunks", keep=args.keep)
    elif args.verb == "status":
        print(f"{found.root}\t{found.type}\t{found.marker}\t{place.base}")
        print(engine.stats())
    else:
        print(engine.stats())
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
