"""Command line: `python -m framesift.cli run|step|list`."""

from __future__ import annotations

import argparse
import json

from framesift.plans import config
from framesift.plans.runs import Run
from framesift.session import session


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="framesift")
    parser.add_argument("--projects", default="projects", help="folder of the projects")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list")
    for name in ("run", "step"):
        sub = commands.add_parser(name)
        sub.add_argument("project")
        sub.add_argument("-s", "--step", action="append", required=name == "step")
        sub.add_argument("--force", action="store_true")
    args = parser.parse_args(argv)
    if args.command == "list":
        print("\n".join(config.names(args.projects)))
        return 0
    reports = Run(session(), config.load(args.project, args.projects)).run(args.step, args.force)
    print(json.dumps(reports, indent=2, default=str))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
