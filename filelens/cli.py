"""Command line: search (the default), index, watch, serve, status, config, version, help.

    python -m filelens ext:pdf 'size:>10mb' -n 20 -s size -d

Options may stand anywhere; ``--`` ends them. Words are joined with spaces to one query. Exit status 1 is a failure, 2 a
mistake on the command line.
"""

from __future__ import annotations

import argparse
import os
import subprocess
import sys
import time
from collections.abc import Callable

from filelens.plans import nodes, parser, values
from filelens.plans.nodes import QueryError
from filelens.sources import config

VERSION = "0.1.0"
COMMANDS = ("search", "index", "watch", "serve", "status", "config", "version", "help")
FAILURE, USAGE = 1, 2


def session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("filelens").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def _words_with_dashes(args: list[str]) -> list[str]:
    """Numbers and dotted words behind a dash are words: an option's name begins with a letter or 0."""
    out, ended = [], False
    for a in args:
        ended = ended or a == "--"
        out.append("\0" + a if not ended and len(a) > 1 and a[0] == "-" and (a[1] == "." or a[1] in "123456789") else a)
    return out


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="filelens", description="Search an index of files and folders.", allow_abbrev=False)
    p.add_argument("words", nargs="*")
    for flag, help_ in (
        ("-r --regex", "treat words as regular expressions"),
        ("-i --case", "match case"),
        ("-w --whole-word", "match whole words"),
        ("-p --match-path", "match the full path"),
        ("-d --descending", "reverse the order"),
        ("--files", "only files"),
        ("--dirs", "only folders"),
        ("--json", "a JSON array"),
        ("--csv", "CSV with a header"),
        ("-0 --null", "NUL after each result"),
        ("--name-only", "names, not paths"),
        ("--size", "a size column"),
        ("--dm", "a column of modification times"),
        ("--dc", "a column of creation times"),
        ("--count", "only the number of results"),
        ("--init", "config: write a default file"),
        ("--version", "show the version"),
    ):
        p.add_argument(*flag.split(), action="store_true", help=help_)
    p.add_argument("-n", "--max-results", type=int, default=0)
    p.add_argument("-o", "--offset", type=int, default=0)
    p.add_argument("-s", "--sort", default="path", help="path, name, size, dm, dc, ext or relevance")
    p.add_argument("--path", default="", help="only results inside this folder")
    p.add_argument("--color", default="auto", choices=("auto", "always", "never"))
    p.add_argument("--root", action="append", default=[], help="index: a root instead of the configured ones")
    p.add_argument("--save-interval", default="10s", help="watch: how often compaction is considered")
    p.add_argument("--config", default=config.config_path())
    p.add_argument("--index", default=config.index_path())
    p.add_argument("--socket", default=config.socket_path())
    return p


def main(args: list[str] | None = None, write: Callable[[str], object] = sys.stdout.write) -> int:
    try:
        o = arguments().parse_intermixed_args(_words_with_dashes(sys.argv[1:] if args is None else args))
    except SystemExit as e:
        return USAGE if e.code else 0
    o.words = [w.removeprefix("\0") for w in o.words]
    command = o.words.pop(0) if o.words and o.words[0] in COMMANDS else "search"
    if o.version or command == "version":
        write(f"filelens {VERSION}\n")
        return 0
    if command == "help":
        write(arguments().format_help())
        return 0
    try:
        return globals()[f"_{command}"](o, write)
    except (QueryError, OSError, ValueError, RuntimeError) as e:
        sys.stderr.write(f"filelens: {e}\n")
        return FAILURE


def _catalog(o):
    from filelens.sources.catalog import Catalog

    return Catalog(session(), o.index)


def _search(o, write) -> int:
    from filelens.operators.search import cli_limits, order_keys, paged
    from filelens.output import Lines, written

    sort = values.sort_key(o.sort)
    node = parser.parse(" ".join(o.words), parser.Defaults(o.regex, o.case, o.whole_word, o.match_path))
    node = nodes.restrict(node, o.path, o.files, o.dirs)
    snapshot = _catalog(o).load_or_build(config.load(o.config))
    if o.count:
        write(f"{snapshot.count(node)}\n")
        return 0
    color = o.color == "always" or o.color == "auto" and write == sys.stdout.write and sys.stdout.isatty() and not os.environ.get("NO_COLOR")
    lines = Lines("json" if o.json else "csv" if o.csv else "plain", o.size, o.dm, o.dc, o.name_only, o.null, color)
    for text in written(paged(snapshot.hits(node), order_keys(node, sort, o.descending), *cli_limits(o.max_results, o.offset)), lines):
        write(text)
    return 0


def _index(o, write) -> int:
    began = time.monotonic()
    c = config.load(o.config)
    snapshot = _catalog(o).build(config.Config(o.root or c.roots, c.excludes))
    n = snapshot.stats().first()
    unread = f", {snapshot.unreadable} folders unreadable" if snapshot.unreadable else ""
    write(f"indexed {n.files} files and {n.folders} folders in {time.monotonic() - began:.1f} s{unread}\n")
    return 0


def _serve(o, write, server: bool = True, rounds: int = 0) -> int:
    """Answers queries and keeps the index current by comparing it with the disk at each interval."""
    from filelens.server import Server
    from filelens.streaming.live import rescan

    pause = values.duration(o.save_interval)
    c = config.load(o.config)
    catalog = _catalog(o)
    snapshot = catalog.load_or_build(c)
    running = Server(snapshot, o.socket, o.index) if server else None
    try:
        while True:
            time.sleep(pause)
            snapshot = rescan(catalog, catalog.load(), c.excludes)
            snapshot = catalog.compact_if_due(snapshot)
            if running:
                running.publish(snapshot)
            rounds -= 1
            if rounds == 0:
                return 0
    except KeyboardInterrupt:
        return 0
    finally:
        if running:
            running.stop()


def _watch(o, write) -> int:
    return _serve(o, write, server=False)


def _status(o, write) -> int:
    from filelens.server import running

    write(f"config:  {o.config}{'' if os.path.exists(o.config) else ' (not there, defaults apply)'}\nindex:   {o.index}\n")
    try:
        snapshot = _catalog(o).load()
    except FileNotFoundError:
        write("         not built yet\n")
        return 0
    n = snapshot.stats().first()
    write(f"entries: {n.files} files, {n.folders} folders\nroots:   {', '.join(snapshot.roots)}\n")
    write(f"built:   {time.strftime('%Y-%m-%d %H:%M', time.localtime(snapshot.built_at))}, {snapshot.batches} batches of changes since\n")
    write(f"server:  {'running' if running(o.socket) else 'not running'} ({o.socket})\n")
    return 0


def _config(o, write) -> int:
    if o.init:
        write(f"{o.config}: {'written' if config.write_default(o.config) else 'is there already'}\n")
        return 0
    if o.words == ["edit"]:
        config.write_default(o.config)
        editor = os.environ.get("VISUAL") or os.environ.get("EDITOR") or "vi"
        subprocess.run([*editor.split(), o.config], check=True)
        config.load(o.config)
        return 0
    write(config.render(config.load(o.config)))
    return 0
