"""The command line: expand designs, show and diff them, list paths, and run actions."""

from __future__ import annotations

import argparse
import importlib
import inspect
import json
import sys
from pathlib import Path

from pyspark.sql import functions as F

from .operators import search, segments
from .plans.runner import SCRIPTS, append_bounded, catalogue, command_of, find_action, history, remember, run_all
from .plans.specs import SpecSet, diff_all, output_path, select_rows

HISTORY = Path.home() / ".gridloom_history"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("gridloom")
    p.add_argument("command", choices=["show", "run", "path", "cmd", "diff", "hist", "list", "doc", "init", "update"])
    p.add_argument("items", nargs="*", help="spec files (JSON), run indices, or an action")
    p.add_argument("-v", "--verbose", type=int, default=0)
    p.add_argument("--bind", action="append", default=[], help="row rules: a.b, a.!b, a.key.c, a.key.!c")
    p.add_argument("--pmk", nargs="*", default=[], help="further key=value settings")
    p.add_argument("--format", dest="_format")
    p.add_argument("--refdir", dest="_refdir")
    p.add_argument("--repeat", dest="_repeat", nargs="*", type=int)
    p.add_argument("--module", action="append", default=[], help="modules that register scripts and models")
    p.add_argument("--action", default=None)
    p.add_argument("--cores", type=int, default=None)
    return p


def extended(base: argparse.ArgumentParser, *more: argparse.ArgumentParser) -> argparse.ArgumentParser:
    """The parser with the options of plug-ins; an option that is there twice is an error that names it."""
    taken = {o for a in base._actions for o in a.option_strings}
    for p in more:
        for a in p._actions:
            both = taken & set(a.option_strings) - {"-h", "--help"}
            if both:
                raise ValueError(f"options defined twice: {', '.join(sorted(both))}")
            if a.option_strings and "--help" not in a.option_strings:
                base._add_action(a)
                taken |= set(a.option_strings)
    return base


def typed(text: str):
    """int, else float, else text."""
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def settings(args: argparse.Namespace) -> dict:
    over = {k: typed(v) for k, _, v in (x.partition("=") for x in args.pmk)}
    return over | {k: v for k in ("_format", "_refdir", "_repeat") if (v := getattr(args, k)) is not None}


def sort_items(items: list[str]) -> tuple[list[str], list[int], list[str]]:
    """(spec files, run indices, other words)."""
    indices = [int(x) for x in items if x.isdigit()]
    files = [x for x in items if x.endswith(".json")]
    return files, indices, [x for x in items if not x.isdigit() and x not in files]


def printed(df) -> None:
    """Every row, tab separated, partition by partition."""
    print("\t".join(df.columns))
    for row in df.toLocalIterator():
        print("\t".join("" if v is None else str(v) for v in row))


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    for name in args.module:
        importlib.import_module(name)
    files, indices, words = sort_items(args.items)
    if args.command == "hist":
        print("\n".join(history(HISTORY, int(words[0]) if words else 42)))
        return 0
    if args.command == "init":
        for folder in ("data", "results", "specs"):
            Path(folder).mkdir(exist_ok=True)
        return 0
    from .session import build_session

    spark = build_session(master=f"local[{args.cores}]" if args.cores else None)
    if args.command == "list":
        kind = words[0] if words else None
        printed(catalogue(spark).where(f"kind = '{kind}'") if kind in ("script", "model") else catalogue(spark))
        return 0
    if args.command == "doc":
        for word in words:
            cls, method = find_action(word)
            print(f"{word}: {inspect.getdoc(getattr(cls, method)) or inspect.getdoc(cls) or 'no description'}")
        return 0
    if args.command == "update":
        rows = catalogue(spark).withColumn("doc_id", F.xxhash64("kind", "name"))
        path = str(Path("data/.catalogue").absolute())
        search.build(rows, ["name", "content"], path)
        segments.vacuum(spark, path, keep=1)
        return 0
    sets = [SpecSet.of(json.loads(Path(f).read_text()), rules=args.bind, **settings(args)) for f in files]
    remember(HISTORY, " ".join(argv or sys.argv[1:]))
    if args.command == "diff":
        printed(diff_all([s.table(spark) for s in sets]).orderBy("key", "value"))
        return 0
    whole = sets[0]
    for more in sets[1:]:
        whole = whole.concat(more)
    runs = whole.table(spark)
    if indices:
        runs = select_rows(runs, indices).drop("_order")
    if args.command == "show":
        printed(runs.orderBy("_expe_id"))
    elif args.command == "path":
        printed(runs.select("_expe_id", output_path(runs, args._format).alias("path")).orderBy("_expe_id"))
    elif args.command == "cmd":
        for row in runs.orderBy("_expe_id").toLocalIterator():
            print(command_of(row.asDict(), args.action or "run"))
    else:
        _, errors = run_all(spark, runs, args.action or next(iter(SCRIPTS)), *words)
        for e in errors:
            append_bounded(Path("errors.log"), e)
        return int(bool(errors))
    return 0


if __name__ == "__main__":
    sys.exit(main())
