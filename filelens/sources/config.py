"""Which roots are indexed and what is left out: lines of ``root = DIR`` and ``exclude = PATTERN``."""

from __future__ import annotations

import os
from dataclasses import dataclass, field
from pathlib import Path

from filelens.plans.nodes import QueryError

#: Left out where a configuration names nothing, fixed values.
DEFAULT_EXCLUDES = ["node_modules", ".git", ".cache", "~/.local/share/Trash", "/proc", "/sys", "/dev", "/run"]

HEADER = """\
# filelens: lines of "root = DIR" and "exclude = PATTERN", see README.md.
# Run "filelens index" after a change.
"""


@dataclass
class Config:
    roots: list[str] = field(default_factory=list)
    excludes: list[str] = field(default_factory=list)


def default() -> Config:
    return Config([os.path.expanduser("~")], list(DEFAULT_EXCLUDES))


def parse(text: str, name: str = "config") -> Config:
    """Raises QueryError with file and line for anything but the two keys, comments and blank lines."""
    c = Config()
    for n, line in enumerate(text.splitlines(), 1):
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        key, equals, value = (x.strip() for x in line.partition("="))
        if not equals:
            raise QueryError(f"{name}:{n}: expected key = value")
        if key == "root":
            c.roots.append(os.path.expanduser(value))
        elif key == "exclude":
            c.excludes.append(value)
        else:
            raise QueryError(f'{name}:{n}: unknown key "{key}"')
    fallback = default()
    return Config(c.roots or fallback.roots, c.excludes or fallback.excludes)


def load(path: str) -> Config:
    """The defaults if there is no such file."""
    try:
        return parse(Path(path).read_text(), path)
    except FileNotFoundError:
        return default()


def render(c: Config) -> str:
    return HEADER + "\n" + "".join(f"root = {r}\n" for r in c.roots) + "\n" + "".join(f"exclude = {e}\n" for e in c.excludes)


def write_default(path: str) -> bool:
    """Whether the file was made; one that is there stays."""
    if os.path.exists(path):
        return False
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    Path(path + ".new").write_text(render(default()))
    os.replace(path + ".new", path)
    return True


def _place(variable: str, xdg: str, fallback: str, name: str) -> str:
    return os.environ.get(variable) or os.path.join(os.environ.get(xdg) or os.path.expanduser(fallback), "filelens", name)


def config_path() -> str:
    return _place("FILELENS_CONFIG", "XDG_CONFIG_HOME", "~/.config", "config")


def index_path() -> str:
    return _place("FILELENS_INDEX", "XDG_DATA_HOME", "~/.local/share", "index")


def socket_path() -> str:
    return os.environ.get("FILELENS_SOCKET") or os.path.join(os.environ.get("XDG_RUNTIME_DIR") or f"/tmp/filelens-{os.getuid()}", "filelens.sock")
