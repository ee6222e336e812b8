"""Command line: ``python -m edgeframe.cli [--json] [--limit N] [--verbose] COMMAND FILE [options]``."""

from __future__ import annotations

import re
import sys
from dataclasses import dataclass, field

from . import __version__
from .errors import UsageError, WaveError
from .render import COMMANDS, DEFAULT_LIMIT

NAME = "edgeframe"
#: The options, whether they take a value, and the one that a command can't do without.
OPTIONS = {"--json": False, "--verbose": False, "--limit": True, "--begin": True, "--end": True, "--filter": True, "--at": True, "--condition": True, "--show": True, "--changed": True}
NEEDED = {"snapshot": "at", "compare": "at", "search": "condition"}
HELP = f"""{NAME} {__version__} - waveform queries on Spark

usage: {NAME} [--json] [--limit N] [--verbose] COMMAND FILE [options]

  info      FILE
  list      FILE [--filter K1,K2]
  dump      FILE [--begin T] [--end T] [--filter K1,K2]
  summary   FILE [--begin T] [--end T] [--filter K1,K2]
  snapshot  FILE --at T [--filter K1,K2]
  compare   FILE --at T1,T2 [--filter K1,K2]
  search    FILE --condition C [--show K1,K2] [--changed K] [--begin T] [--end T]

  --json     one JSON document
  --limit N  most rows (default {DEFAULT_LIMIT}; 0: all)
  --verbose  more fields; no limit unless one is given
  --version, --help"""


@dataclass
class Request:
    command: str = ""
    file: str = ""
    json: bool = False
    verbose: bool = False
    limit: int | None = None
    options: dict[str, str] = field(default_factory=dict)


def parse(argv: list[str]) -> Request | str:
    """A request, or text to print. Raises UsageError for the first fault; help and version come before any."""
    given: dict[str, str | bool] = {}
    words: list[str] = []
    faults: list[str] = []
    tokens = iter(argv)
    for t in tokens:
        if t == "--version":
            return f"{NAME} {__version__}"
        if t in ("-h", "--help"):
            return HELP
        if t in OPTIONS:
            value = next(tokens, None) if OPTIONS[t] else True
            faults += _faults(t, value)
            given[t[2:]] = value
        elif t.startswith("--") or (words and len(t) > 1 and t[0] == "-"):
            faults.append(f"unrecognized argument: {t}")
        else:
            if not words and t not in COMMANDS:
                faults.append(f"invalid command: '{t}' (choose from {', '.join(COMMANDS)})")
            words.append(t)
    if faults:
        raise UsageError(faults[0])
    if not words:
        return HELP
    command, *files = words
    if not files:
        raise UsageError(f"the following arguments are required: <file> (for '{command}')")
    if files[1:]:
        raise UsageError(f"unexpected extra arguments: {' '.join(files[1:])}")
    if (flag := NEEDED.get(command)) and flag not in given:
        raise UsageError(f"the following arguments are required: --{flag}")
    limit = int(given.pop("limit")) if "limit" in given else None
    if limit is not None and limit < 0:
        raise UsageError(f"limit must be non-negative; got {limit}")
    return Request(command, files[0], bool(given.pop("json", False)), bool(given.pop("verbose", False)), limit, given)


def _faults(option: str, value: str | bool | None) -> list[str]:
    if value is None:
        return [f"{option} requires a value"]
    if option == "--limit" and not re.fullmatch("[+-]?[0-9]+", value):
        return [f"argument --limit: invalid int value: '{value}'"]
    return []


def main(argv: list[str] | None = None, spark=None) -> int:
    """0: done, 1: the request failed, 2: wrong usage."""
    try:
        request = parse(sys.argv[1:] if argv is None else argv)
    except UsageError as e:
        print(f"{NAME}: error: {e}", file=sys.stderr)
        return 2
    if isinstance(request, str):
        print(request)
        return 0
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName(NAME).config("spark.ui.showConsoleProgress", "false").getOrCreate()
    from .sources.registry import open_wave

    try:
        wave = open_wave(spark, request.file)
        for part in COMMANDS[request.command](wave, request.limit, request.verbose, **request.options).parts(request.json):
            print(part, end="")
    except WaveError as e:
        print(f"Error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
