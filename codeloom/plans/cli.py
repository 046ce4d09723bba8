"""The command line: sixteen commands over a repository's store."""

from __future__ import annotations

import argparse
import json
import logging
import os
import sys
from dataclasses import asdict

from codeloom.plans import config as configs
from codeloom.plans import hooks, render
from codeloom.plans import store as stores
from codeloom.sources.storage import is_local


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="codeloom")
    out.add_argument("--log-level", default="")
    out.add_argument("--log-file", default="")
    out.add_argument("--repo", default=".")
    sub = out.add_subparsers(dest="command", required=True)

    def add(name: str, as_json: bool = True) -> argparse.ArgumentParser:
        p = sub.add_parser(name)
        if as_json:
            p.add_argument("--json", action="store_true")
        return p

    add("version", False)
    p = add("index")
    p.add_argument("path", nargs="?", default=None)
    for flag in ("--force", "--enrich", "--no-enrich"):
        p.add_argument(flag, action="store_true")
    add("sync")
    p = add("search")
    p.add_argument("query")
    for flag in ("--kind", "--language", "--file"):
        p.add_argument(flag, default="")
    p.add_argument("--limit", type=int, default=20)
    p = add("get")
    p.add_argument("ids", nargs="*")
    p.add_argument("--file", action="append", default=[])
    p.add_argument("--context", type=int, default=0)
    p.add_argument("--compact", action="store_true")
    p = add("deps")
    p.add_argument("id")
    p.add_argument("--direction", default="both")
    p.add_argument("--depth", type=int, default=1)
    p = add("outline")
    p.add_argument("file")
    p = add("tree")
    p.add_argument("scope", nargs="?", default="")
    p.add_argument("--depth", type=int, default=2)
    p.add_argument("--no-symbols", action="store_true")
    p.add_argument("--source-only", action="store_true")
    add("overview")
    add("env")
    p = add("diff")
    p.add_argument("--since", required=True)
    p = add("status")
    p.add_argument("--verify", action="store_true")
    p = add("savings")
    p.add_argument("--sessions", action="store_true")
    p.add_argument("--session", default="")
    p.add_argument("--top", type=int, default=0)
    p = add("cache")
    p.add_argument("action", choices=["status", "invalidate", "remove", "clear", "prune"])
    p.add_argument("--older-than", default="720h")
    p = add("hook", False)
    p.add_argument("action", choices=["install", "uninstall"])
    add("serve", False)
    return out


def looks_like_path(word: str) -> bool:
    """A path among the words of ``get``: anything but eight hex digits."""
    return not (len(word) == 8 and all(c in "0123456789abcdef" for c in word))


def show(df, as_json: bool, compact: bool = False) -> None:
    form = render.as_json(df) if as_json else render.as_compact(df) if compact else render.as_text(df)
    for row in form.toLocalIterator():
        print(row[0])


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    config = configs.load()
    logging.basicConfig(level=configs.log_level(args.log_level or config.log_level), filename=args.log_file or config.log_file or None)
    if args.command == "version":
        print("codeloom 0.1")
        return 0
    root = os.path.abspath(getattr(args, "path", None) or args.repo)
    if args.command == "hook":
        print(hooks.install(root) if args.action == "install" else hooks.uninstall(root))
        return 0
    if args.command == "cache":
        from codeloom.functions.units import parse_duration

        if not is_local(config.cache_root):
            from codeloom.session import session

            session()
        actions = {
            "status": lambda: stores.cache_status(config.cache_root),
            "invalidate": lambda: stores.invalidate(config.cache_root, root),
            "remove": lambda: stores.remove(config.cache_root, root),
            "clear": lambda: stores.clear(config.cache_root),
            "prune": lambda: stores.prune(config.cache_root, parse_duration(args.older_than)),
        }
        print(json.dumps(actions[args.action]()))
        return 0

    from codeloom.plans.repository import Repository
    from codeloom.session import session

    spark = session()
    if args.command == "serve":
        from codeloom.plans.tools import Tools, serve

        serve(Tools(spark, config, root), sys.stdin.readline, lambda s: (sys.stdout.write(s), sys.stdout.flush()))
        return 0
    repo = Repository(spark, root, config, must_exist=args.command not in ("index", "sync", "env", "savings"))
    if args.command in ("index", "sync"):
        from codeloom.operators import enrich

        describe = enrich.provider(timeout_s=config.enrich_timeout_s) if getattr(args, "enrich", False) and not args.no_enrich and not config.enrich_disabled else None
        print(json.dumps(asdict(repo.index(force=getattr(args, "force", False), describe=describe))))
    elif args.command == "search":
        columns = ["id", "kind", "qualified_name", "file", "signature", "summary", "rank"]
        show(repo.search(args.query, args.kind, args.language, args.file, args.limit).select(columns), args.json)
    elif args.command == "get":
        ids, paths = [w for w in args.ids if not looks_like_path(w)], [w for w in args.ids if looks_like_path(w)]
        symbols, files = repo.get(ids, [*paths, *args.file], args.context)
        show(symbols.select("id", "qualified_name", "file", "source"), args.json, args.compact)
        show(files, args.json, args.compact)
    elif args.command == "deps":
        show(repo.deps(args.id, args.direction, args.depth), args.json)
    elif args.command == "outline":
        show(repo.outline(args.file), args.json)
    elif args.command == "tree":
        show(repo.tree(args.scope, args.depth, not args.no_symbols, args.source_only), args.json)
    elif args.command == "overview":
        show(repo.overview(), True)
    elif args.command == "env":
        files, variables = repo.env()
        show(files, args.json)
        show(variables.drop("value"), args.json)
    elif args.command == "diff":
        show(repo.diff(args.since), args.json)
    elif args.command == "status":
        show(repo.status(args.verify), args.json)
    elif args.command == "savings":
        show(repo.sessions(args.top or None) if args.sessions or args.top else repo.savings(args.session or None), args.json)
    return 0
