"""Command line: analyse, report, summary, check-ignore, completion, dashboard, init, list, list-profiles, list-rules."""

from __future__ import annotations

import argparse
import json
import os
import sys
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework import completion
from sievework.operators import analyse as A
from sievework.operators import findings as R
from sievework.operators.catalog import RULES, Config, ConfigError
from sievework.session import session
from sievework.sinks import dashboard, reports
from sievework.sources import baseline, changes, listing, settings

SEVERITIES = ("none", "advisory", "warning", "error")
FORMATS = (*reports.FORMATS, "annotations")
#: What a command fails from on, where neither its option nor the configuration says so.
FAIL_ON = {"analyse": "advisory", "summary": "advisory", "report": "none"}
BASELINE = "sievework-baseline.json"


def choice(known: tuple[str, ...], default: str):
    """An option of some words; any other word counts as the default and is told."""

    def read(value: str) -> str:
        if value not in known:
            print(f"{value!r} is none of {', '.join(known)}; {default} is used", file=sys.stderr)
        return value if value in known else default

    return read


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sievework")
    commands = p.add_subparsers(dest="command", required=True)
    for name, told in (("analyse", "Run the rules and show what they find."), ("report", "Run the rules and write a report."), ("summary", "Run the rules and show scores.")):
        c = commands.add_parser(name, help=told)
        c.add_argument("paths", nargs="*", default=["."], help="files and folders below the working directory")
        c.add_argument("--format", default="text", type=choice(FORMATS, "text"))
        c.add_argument("--config")
        c.add_argument("--no-config", action="store_true")
        c.add_argument("--profile", help="a preset, or the path of a profile's file")
        c.add_argument("--fail-on", type=choice(SEVERITIES, FAIL_ON[name]))
        c.add_argument("--include-ignored", action="store_true")
        c.add_argument("--top", type=int, default=10)
        if name != "report":
            c.add_argument("--baseline", nargs="?", const=BASELINE)
            c.add_argument("--no-baseline", action="store_true")
            c.add_argument("--write-baseline", nargs="?", const=BASELINE)
            c.add_argument("--changed-ranges", help="lines such as 3-3,8-10, of every file")
            c.add_argument("--since", help="a revision to compare with")
            c.add_argument("--diff", nargs="?", const="working-tree", help="staged, unstaged, working-tree, a revision, or - for a diff on standard input")
            c.add_argument("--changed-scope", default="symbol", type=choice(("symbol", "hunk"), "symbol"))
            c.add_argument("--history")
    c = commands.add_parser("check-ignore", help="Tell which paths are left out, and why.")
    c.add_argument("paths", nargs="+")
    c.add_argument("--config")
    c.add_argument("--no-config", action="store_true")
    c.add_argument("--json", action="store_true")
    c = commands.add_parser("completion", help="Print a completion script.")
    c.add_argument("shell", nargs="?", default="bash", type=choice(completion.SHELLS, "bash"))
    c = commands.add_parser("dashboard", help="Serve reports on a local page.")
    c.add_argument("--host", default="127.0.0.1")
    c.add_argument("--port", type=int, default=8767)
    c.add_argument("--root", default=".")
    c.add_argument("--profile")
    c = commands.add_parser("init", help="Write a configuration with the defaults.")
    c.add_argument("--profile", default="recommended")
    c.add_argument("--force", action="store_true")
    commands.add_parser("list", help="List the commands.")
    c = commands.add_parser("list-rules", help="List the rules, or show one.")
    c.add_argument("rule", nargs="?")
    c.add_argument("--json", action="store_true")
    commands.add_parser("list-profiles", help="List the presets.").add_argument("--json", action="store_true")
    return p


def fail_on(args: argparse.Namespace, config: Config) -> str:
    """The option goes before the configuration, and that before the command's default."""
    return args.fail_on or config.minimum_severity.get(args.command) or FAIL_ON[args.command]


def scope_of(args: argparse.Namespace, spark: SparkSession, files: DataFrame) -> dict:
    """What ``analyse`` gets to look at changes only: ranges given as such, or those of a diff; the first that is given."""
    if getattr(args, "changed_ranges", None):
        lines = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in changes.parse_ranges(args.changed_ranges)])
        return {"ranges": files.select("repo", "file_path", F.inline(lines)), "scope": args.changed_scope}
    if getattr(args, "since", None) or getattr(args, "diff", None):
        found = changes.parse_diff(sys.stdin.read()) if args.diff == "-" and not args.since else changes.working_tree(".", args.since or args.diff)
        ranges, whole = found.tables(spark)
        return {"ranges": ranges, "whole_files": whole, "scope": args.changed_scope}
    return {}


def run(args: argparse.Namespace) -> int:
    config = settings.load(".", args.config, args.profile, args.no_config)
    spark = session("sievework")
    root = os.path.abspath(".")
    missing = listing.inputs(root, args.paths, config.ignored_paths, args.include_ignored)[2]
    files = listing.files_of(spark, root, config.ignored_paths, include_ignored=args.include_ignored, paths=args.paths).persist()
    found = A.analyse(files, config, **scope_of(args, spark, files)).persist()
    if getattr(args, "write_baseline", None):
        baseline.write_baseline(found, os.path.abspath(args.write_baseline))
    elif not getattr(args, "no_baseline", True) and (at := args.baseline or (BASELINE if os.path.isfile(BASELINE) else None)):
        found = R.not_in_baseline(found, baseline.read_baseline(spark, os.path.abspath(at)))
    if args.command == "summary":
        print(reports.summary(found, args.top, args.format == "json"), end="")
    elif args.format == "annotations":
        for r in reports.annotations(found.orderBy(*R.canonical_order())).toLocalIterator():
            print(r[0])
    elif args.format == "text":
        for line in reports.text_lines(found):
            print(line)
    else:
        print(reports.FORMATS[args.format](found))
    bad = [f"{p}: the path does not exist" for p in missing]
    bad += [f"{r['file_path']}: {r['message']}" for r in A.diagnostics(files, config).toLocalIterator()]
    for line in bad:
        print(line, file=sys.stderr)
    if getattr(args, "history", None):
        d = reports.digest(found)
        baseline.append_history(args.history, str(spark.sql("SELECT current_timestamp()").first()[0]), d["summary"]["total"], d["score"])
    if bad:
        return 2
    return 0 if R.at_least(found, fail_on(args, config)).isEmpty() else 1


def render(kind: str, root: str, profile: str | None) -> str:
    """A report of a tree, for the dashboard."""
    config = settings.load(root, None, profile)
    found = A.analyse(listing.files_of(session("sievework"), os.path.abspath(root), config.ignored_paths), config).persist()
    return reports.FORMATS[kind](found)


def show_rules(args: argparse.Namespace) -> int:
    rules = sorted(RULES.values(), key=lambda r: r.rule_id)
    if args.rule:
        rules = [r for r in rules if r.rule_id == args.rule]
        if not rules:
            print(f"unknown rule {args.rule!r}", file=sys.stderr)
            return 2
    if args.json:
        rows = [asdict(r) for r in rules]
        print(json.dumps(rows[0] if args.rule else rows, indent=2))
    elif args.rule:
        print("\n".join(f"{name}: {', '.join(value) if isinstance(value, tuple) else value}" for name, value in asdict(rules[0]).items() if value not in (None, (), "")))
    else:
        print("\n".join(f"{r.rule_id:<50} {r.severity:<9} {r.pillar:<16} {r.description}" for r in rules))
    return 0


def write_configuration(args: argparse.Namespace) -> int:
    at = settings.NAMES[0]
    there = os.path.exists(at)
    if there and not args.force:
        print(f"{at} exists; --force replaces it", file=sys.stderr)
        return 1
    try:
        kept = settings.load(".") if there else Config()
    except ConfigError:  # what cannot be read is replaced
        kept = Config()
    with open(at, "w", encoding="utf-8") as f:
        f.write(settings.initial(args.profile, kept.ignored_paths, kept.minimum_severity))
    return 0


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        if args.command in FAIL_ON:
            return run(args)
        if args.command == "check-ignore":
            config = settings.load(".", args.config, skip=args.no_config)
            hits = {p: listing.ignored(os.path.normpath(p).replace(os.sep, "/"), ".", config.ignored_paths) for p in args.paths}
            rows = [{"path": p, "source": h[0], "pattern": h[1]} for p, h in hits.items() if h]
            print(json.dumps(rows, indent=2) if args.json else "\n".join(f"{r['path']}\t{r['source']}:{r['pattern']}" for r in rows))
            return 0 if rows else 1
        if args.command == "list-rules":
            return show_rules(args)
        if args.command == "list-profiles":
            rows = settings.profiles()
            print(json.dumps(rows, indent=2) if args.json else "\n".join(f"{r['profile']:<12} {r['enabled']} of {r['total']}" for r in rows))
        elif args.command == "list":
            print(completion.listing(parser()), end="")
        elif args.command == "completion":
            print(completion.script(parser(), args.shell), end="")
        elif args.command == "dashboard":
            with dashboard.server(args.host, args.port, lambda kind, root: render(kind, root or args.root, args.profile)) as server:
                print(f"http://{args.host}:{args.port}/", file=sys.stderr)
                server.serve_forever()
        else:
            return write_configuration(args)
    except ConfigError as x:
        print(f"configuration: {x}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
