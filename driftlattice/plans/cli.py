"""Command line: init, catalog, snapshot, diff, check, trend, show, boundaries infer | ratify | show."""

from __future__ import annotations

import argparse
import logging
import os
import sys

from driftlattice.errors import AnalysisError, ConfigError, ExitCode, NothingToAnalyse
from driftlattice.plans import analysis as A
from driftlattice.plans import report as R
from driftlattice.session import session
from driftlattice.sources import config as C
from driftlattice.sources import snapshots as S


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="driftlattice")
    p.add_argument("--repo", default=".")
    p.add_argument("--config")
    p.add_argument("--format", choices=("text", "json"))
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("init")
    sub.add_parser("catalog")
    sub.add_parser("snapshot").add_argument("--commit")
    diff = sub.add_parser("diff")
    diff.add_argument("before")
    diff.add_argument("after")
    sub.add_parser("check").add_argument("--no-write", action="store_true")
    sub.add_parser("trend").add_argument("--last", type=int)
    sub.add_parser("show").add_argument("id", nargs="?")
    sub.add_parser("boundaries").add_argument("action", choices=("infer", "ratify", "show"))
    return p


def run(args: argparse.Namespace, out) -> int:
    if args.command == "init":
        path, fresh = C.init_config(args.repo)
        print(f"{'wrote' if fresh else 'kept'} {path}; languages: {', '.join(A.languages_of(args.repo)) or 'none'}", file=out)
        return ExitCode.SUCCESS
    config = C.load_config(args.repo, project_file=args.config)
    style = args.format or config["output"]["format"]
    show = lambda value, text: print(A.as_json(value) if style == "json" else text(value), file=out)
    folder = os.path.join(args.repo, config["snapshots"]["dir"])
    if args.command == "diff":
        before, after = S.load(args.before), S.load(args.after)
        if before["snapshot_version"] != after["snapshot_version"]:
            logging.warning("the snapshots have different versions")
        show(A.delta(before, after), R.divergence_text)
        return ExitCode.SUCCESS
    if args.command == "show":
        found = S.by_id(folder, args.id) if args.id else S.latest(folder)
        if found is None:
            raise AnalysisError("there are no snapshots")
        show(found, R.snapshot_text)
        return ExitCode.SUCCESS
    if args.command == "trend" and len(S.read_all(folder)) < 2:
        print("a trend needs two snapshots", file=out)
        return ExitCode.SUCCESS
    if args.command == "boundaries" and args.action == "show":
        spec = C.read_boundaries(os.path.join(args.repo, config["boundaries"]["spec_file"]))
        show(spec or [], lambda s: "\n".join(f"{b['name']}: {', '.join(b['modules'])}" for b in s) or "(no boundaries)")
        return ExitCode.SUCCESS
    a = A.Analysis(session(), args.repo, config)
    if args.command == "catalog":
        show(A.catalog_entries(a.catalog().collect()), R.catalog_text)
    elif args.command == "snapshot":
        show(a.snapshot(args.commit), R.snapshot_text)
    elif args.command == "trend":
        show(A.trend(a.spark, folder, args.last), R.trend_text)
    elif args.command == "boundaries" and args.action == "infer":
        show(a.infer(), lambda found: "\n".join(f"community {p['community_id']} ({p['stable_snapshots']} snapshots): {', '.join(p['node_ids'])}" for p in found) or "(no stable communities)")
    elif args.command == "boundaries":
        path, n, lost = a.ratify()
        if lost:
            logging.warning("comments in %s are lost", path)
        print(f"wrote {n} boundaries to {path}", file=out)
    else:
        summary, breaches, applied = a.check(write=not args.no_write)
        code = ExitCode.THRESHOLD_EXCEEDED if breaches else ExitCode.SUCCESS
        if style == "json":
            print(A.as_json({"exit_code": int(code), "exceeded": [b["dimension"] for b in breaches], "summary": summary, "applied_overrides": applied}), file=out)
        else:
            print(R.check_text(summary, breaches, applied), file=out)
        return code
    return ExitCode.SUCCESS


def main(argv: list[str] | None = None, out=None) -> int:
    logging.basicConfig(stream=sys.stderr, level=os.environ.get("DRIFTLATTICE_LOG_LEVEL", "WARNING").upper())
    args = parser().parse_args(argv)
    try:
        return int(run(args, out or sys.stdout))
    except ConfigError as e:
        logging.error("%s", e)
        return int(ExitCode.CONFIG_ERROR)
    except NothingToAnalyse as e:
        logging.error("%s", e)
        return int(ExitCode.ANALYSIS_ERROR)
    except AnalysisError as e:
        logging.error("%s", e)
        return int(ExitCode.RUNTIME_ERROR)


if __name__ == "__main__":
    sys.exit(main())
