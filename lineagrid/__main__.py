"""Command line: ``python -m lineagrid bundle|check|graph|lsp|version|help``."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from . import __version__
from .functions.statements import PREFIX
from .operators.diagnostics import has_error, lines
from .plans import projects
from .session import local_session
from .sources.files import ConfigError, find_config, load_config, read_tree


def _settings(args: argparse.Namespace) -> tuple[str, str, str]:
    """Flags win over the configuration, which wins over defaults."""
    config = None
    if args.config:
        config = load_config(args.config)
    else:
        try:
            config = load_config(find_config(Path.cwd()))
        except FileNotFoundError:
            pass
    folder = args.dir or (config.schema_dir if config else "") or "."
    return folder, args.dialect or (config.dialect if config else "") or "postgres", args.o or (config.out if config else "")


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lineagrid", description="Order, check and draw trees of SQL schema files.")
    commands = parser.add_subparsers(dest="command")
    for name in ("bundle", "check", "graph"):
        own = commands.add_parser(name)
        own.add_argument("--dir", default="", help="root of the schema tree")
        own.add_argument("--dialect", default="", help="postgres, mysql or sqlite")
        own.add_argument("--config", default="", help="configuration file")
        own.add_argument("--prefix", default=PREFIX, help="the tool whose comments name requirements")
        own.add_argument("--strict", action="store_true", help="mend surprising behaviour instead of keeping it")
        own.add_argument("-o", default="", help="output file")
        if name == "graph":
            own.add_argument("--format", default="dot", choices=("dot", "mermaid", "json", "svg"))
    commands.add_parser("lsp")
    commands.add_parser("version")
    commands.add_parser("help")
    args = parser.parse_args(argv)
    if args.command == "version":
        print(__version__)
        return 0
    if args.command in (None, "help"):
        parser.print_help()
        return 0 if args.command else 2
    if args.command == "lsp":
        from .streaming.server import LanguageServer

        return LanguageServer(local_session(), sys.stdin.buffer, sys.stdout.buffer).serve()
    try:
        folder, dialect, out = _settings(args)
        spark = local_session()
        spark.sparkContext.setLogLevel("ERROR")
        files = read_tree(spark, folder, dialect)
        if args.command == "check":
            found = projects.check(files, args.strict, args.prefix).cache()
            for row in lines(found).collect():
                print(row["line"])
            return int(any(r["has_error"] for r in has_error(found).collect()))
        made = projects.bundle_or_raise(files, strict=args.strict, prefix=args.prefix) if args.command == "bundle" else projects.graph(files, args.format, args.strict, args.prefix)
        out = args.o if args.command == "graph" else out  # graphs ignore the configured output
        if out:
            Path(out).write_text(made, encoding="utf-8")
        else:
            sys.stdout.write(made)
        return 0
    except (ConfigError, FileNotFoundError, ValueError) as e:
        print(f"lineagrid: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
