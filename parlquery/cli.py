"""``python -m parlquery.cli``: the engine's commands with text or JSON out."""

from __future__ import annotations

import argparse
import dataclasses
import json
import os
import sys

from . import model
from .functions.vector import ByteEmbedder
from .operators.filters import resolve_current

COMMANDS = ("index", "rebuild", "search", "show", "classify", "status", "doctor")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="parlquery")
    p.add_argument("--json", action="store_true")
    p.add_argument("--db")
    p.add_argument("--embed", action="store_true", help="use the byte embedder")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("index", "rebuild"):
        c = sub.add_parser(name)
        c.add_argument("--token-budget", type=int, help="tokens of one forward pass of the embedder")
    s = sub.add_parser("search")
    s.add_argument("query", nargs="?")
    for flag in ("project", "source", "file"):
        s.add_argument(f"--{flag}")
    s.add_argument("--days", type=int)
    s.add_argument("--limit", type=int, default=model.LIMIT_DEFAULT)
    for flag in ("include-automated", "exclude-current", "only-current"):
        s.add_argument(f"--{flag}", action="store_true")
    w = sub.add_parser("show")
    w.add_argument("session")
    w.add_argument("--chunk", type=int)
    w.add_argument("--window", type=int, default=model.WINDOW_DEFAULT)
    c = sub.add_parser("classify")
    c.add_argument("--all", action="store_true")
    c.add_argument("--dry-run", action="store_true")
    sub.add_parser("status")
    d = sub.add_parser("doctor")
    d.add_argument("--fix", action="store_true")
    return p


def expand(argv: list[str]) -> list[str]:
    """A query on its own is a search."""
    plain = next((k for k, a in enumerate(argv) if not a.startswith("-")), None)
    if plain is not None and argv[plain] not in COMMANDS and (plain == 0 or argv[plain - 1] != "--db"):
        return [*argv[:plain], "search", *argv[plain:]]
    return argv


def run(engine, args) -> tuple[list[dict], list[str]]:
    """The rows of a command and its notes."""
    if args.command in ("index", "rebuild"):
        work = engine.index if args.command == "index" else engine.rebuild
        stats = work(token_budget=args.token_budget)
        return [dataclasses.asdict(stats)], [stats.first_error] if stats.first_error else []
    if args.command == "search":
        current = resolve_current(args.exclude_current, args.only_current, dict(os.environ))
        opts = model.SearchOptions(args.project, args.days, args.source, args.file, args.limit, current, args.include_automated)
        df, meta = engine.search(args.query, opts)
        notes = meta.notes + (["results are not complete"] if meta.results_incomplete else [])
        return [r.asDict() for r in df.collect()], notes
    if args.command == "show":
        df = engine.show(args.session, args.chunk, args.window)
    elif args.command == "classify":
        df = engine.classify(args.all, args.dry_run)
    else:
        df = engine.status() if args.command == "status" else engine.doctor(args.fix)
    return [r.asDict() for r in df.toLocalIterator()], []


def envelope(data: list[dict], notes: list[str]) -> dict:
    return {"ok": True, "data": data, "degraded": bool(notes), "notes": notes}


def error_envelope(error: BaseException) -> dict:
    code = model.classify_error(error)
    own = {"code": code.name, "message": str(error), "next_step": getattr(error, "next_step", ""), "candidates": getattr(error, "candidates", []), "retryable": code == model.ErrorCode.TEMP_FAILURE}
    return {"ok": False, "error": own}


def main(argv: list[str] | None = None, spark=None) -> int:
    argv = sys.argv[1:] if argv is None else argv
    try:
        args = parser().parse_args(expand(argv))
    except SystemExit as e:
        return int(model.ErrorCode.USAGE_ERROR) if e.code else 0
    try:
        if spark is None:
            from pyspark.sql import SparkSession

            spark = SparkSession.builder.getOrCreate()
        from .api import Engine

        data, notes = run(Engine(spark, args.db, ByteEmbedder() if args.embed else None), args)
        if args.json:
            print(json.dumps(envelope(data, notes), default=str, ensure_ascii=False))
        else:
            for row in data:
                print("\t".join(str(v) for v in row.values()))
            for note in notes:
                print(f"note: {note}", file=sys.stderr)
        return 0
    except BrokenPipeError:
        return 0
    except Exception as e:
        print(json.dumps(error_envelope(e)) if args.json else f"error: {e}", file=sys.stderr)
        return int(model.classify_error(e))


if __name__ == "__main__":
    sys.exit(main())
