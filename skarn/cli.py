"""Command line: index, search and status of a working tree, and a dry run of an extractor; JSON on standard output."""

from __future__ import annotations

import argparse
import json
import os
import sys

from .operators import extractors, snapshot
from .plans import indexing
from .plans import search as S
from .session import session


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="skarn")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("index", "search", "status"):
        one = commands.add_parser(name)
        one.add_argument("--root", default=".")
        one.add_argument("--store", help="a folder that the cluster shares; by default .skarn/store of the root")
        if name == "index":
            one.add_argument("--full", action="store_true")
        if name == "search":
            one.add_argument("pattern")
            one.add_argument("scope", nargs="?", default="")
            one.add_argument("--match", choices=("text", "fixed", "regexp"), default="text")
            one.add_argument("--about", default="")
            one.add_argument("--limit", type=int, default=10)
            one.add_argument("--mode", choices=S.MODES, default="auto")
    dry = commands.add_parser("check")
    dry.add_argument("extractor", choices=sorted(extractors.EXTRACTORS))
    dry.add_argument("file")
    return parser


def main(arguments: list[str] | None = None) -> int:
    """0 if done, 2 for a query or setting that can't be used, 3 if semantic search was wanted and isn't there."""
    args = _parser().parse_args(arguments)
    spark = session()
    try:
        if args.command == "check":
            with open(args.file, encoding="utf-8") as f:
                rows = extractors.dry_run(spark, args.extractor, args.file, f.read())
            print(S.envelope("check", rows))
            return 0
        store = snapshot.Store(spark, args.store or os.path.join(os.path.abspath(args.root), ".skarn", "store"))
        if args.command == "index":
            progress = snapshot.Progress(lambda e: print(json.dumps(e), file=sys.stderr))
            print(S.envelope("index", indexing.index_tree(spark, args.root, store, full=args.full, progress=progress)))
        elif args.command == "status":
            print(S.envelope("status", indexing.status(args.root, store)))
        else:
            records = store.read("records")
            if records is None:
                from .config import load
                from .sources.worktree import read_worktree

                config = load(args.root)
                files = read_worktree(spark, args.root, config.ignoreGlobs, config.maxFileBytes).where("reason IS NULL")
                found = S.search_files(files, args.pattern, args.match, args.about, args.scope, args.limit)
            else:
                found = S.search(records, args.pattern, args.match, args.about, args.scope, args.limit, args.mode, edges=store.read("edges"), index=indexing.open_index(spark, store))
            print(S.result_json(found))
    except S.SemanticUnavailable as e:
        print(S.envelope(args.command, None, error=str(e)))
        return 3
    except ValueError as e:
        print(S.envelope(args.command, None, error=str(e)))
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
