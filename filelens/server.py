"""JSON lines over a Unix socket: searches and status.

One thread per connection and one per request; a new request on a connection cancels the one before, by the Spark tag that
its jobs carry. The total is observed while the page is made, in one scan.
"""

from __future__ import annotations

import json
import os
import socket
import threading
import time
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import Observation
from pyspark.sql import functions as F

from filelens.functions import columns as C
from filelens.operators.search import DEEP, order_keys, paged
from filelens.output import json_line
from filelens.plans import nodes, parser, values
from filelens.plans.nodes import QueryError
from filelens.sources.catalog import Snapshot

DEFAULT_LIMIT = 100
#: Longest request line in bytes.
LONGEST_LINE = 1 << 20


def _int(body: dict, key: str, fallback: int) -> int:
    v = body.get(key)
    return int(v) if isinstance(v, (int, float)) and not isinstance(v, bool) and abs(v) < 9.2e18 else fallback


def _bool(body: dict, key: str) -> bool:
    return body.get(key) is True


def _string(body: dict, key: str) -> str:
    v = body.get(key)
    return v if isinstance(v, str) else ""


class _Number(float):
    """A number that is written back as it came."""

    def __new__(cls, text: str):
        self = super().__new__(cls, text)
        self.text = text
        return self


def _id_text(value: Any) -> str:
    return value.text if isinstance(value, _Number) else json.dumps(value, ensure_ascii=False)


def reply(body: dict | None, rest: str) -> str:
    """A reply object: the request's id, as it came, and what follows."""
    return f'{{"id":{_id_text(body["id"])},{rest}}}' if body and "id" in body else f"{{{rest}}}"


def status(snapshot: Snapshot, index_path: str) -> str:
    n = snapshot.stats().first()
    built = snapshot.entries.sparkSession.range(1).select(C.rfc3339(F.lit(snapshot.built_at))).first()[0]
    return f'"files":{n.files},"folders":{n.folders},"roots":{json.dumps(list(snapshot.roots), ensure_ascii=False)},"built":{json.dumps(built)},"index":{json.dumps(index_path)}'


def search(snapshot: Snapshot, body: dict) -> str:
    """A result object's fields; limit 0 gives the total alone, a limit under zero all results."""
    began = time.monotonic()
    sort = values.sort_key(_string(body, "sort") or "relevance")
    defaults = parser.Defaults(_bool(body, "regex"), _bool(body, "case"), _bool(body, "whole_word"), _bool(body, "match_path"))
    node = nodes.restrict(parser.parse(_string(body, "query"), defaults), _string(body, "path"), _bool(body, "files"), _bool(body, "dirs"))
    hits = snapshot.hits(node)
    limit, offset = _int(body, "limit", DEFAULT_LIMIT), max(0, _int(body, "offset", 0))
    lines, total, keys = [], None, order_keys(node, sort, _bool(body, "descending"))
    if limit:
        # A top-k scans the hits once. A sort by range reads them for its sample too, so nothing is observed then.
        seen = Observation() if 0 < limit and offset <= DEEP else None
        counted = hits.observe(seen, F.count(F.lit(1)).alias("total")) if seen else hits
        lines = [r.line for r in paged(counted, keys, limit, offset).select(json_line().alias("line")).collect()]
        # Without a line the plan may have been found empty, and nothing observed.
        if lines and limit < 0:
            total = offset + len(lines)
        elif lines and seen:
            total = seen.get["total"]
    if total is None:
        total = hits.count()
    return f'"total":{total},"elapsed_ms":{(time.monotonic() - began) * 1000:.6g},"results":[{",".join(lines)}]'


def handle(line: str, snapshot: Callable[[], Snapshot], index_path: str, cancelled: Callable[[], bool] = lambda: False) -> str:
    """The reply to a request line."""
    try:
        body = json.loads(line, parse_float=_Number)
        if not isinstance(body, dict):
            raise ValueError("a request is an object")
    except ValueError as e:
        return reply(None, f'"error":{json.dumps(f"invalid request: {e}", ensure_ascii=False)}')
    op = _string(body, "op") or "search"
    try:
        if op == "status":
            return reply(body, status(snapshot(), index_path))
        if op != "search":
            return reply(body, f'"error":{json.dumps(f"unknown op {json.dumps(op)}", ensure_ascii=False)}')
        out = search(snapshot(), body)
        return reply(body, '"cancelled":true' if cancelled() else out)
    except QueryError as e:
        return reply(body, f'"error":{json.dumps(str(e), ensure_ascii=False)}')
    except Exception as e:
        if cancelled():
            return reply(body, '"cancelled":true')
        return reply(body, f'"error":{json.dumps(str(e).splitlines()[0] if str(e) else type(e).__name__, ensure_ascii=False)}')


class _Connection(threading.Thread):
    def __init__(self, server: Server, conn: socket.socket):
        super().__init__(daemon=True)
        self.server, self.conn = server, conn
        self.sending = threading.Lock()
        self.request: tuple[threading.Thread, threading.Event, str] | None = None

    def send(self, text: str) -> None:
        with self.sending:
            try:
                self.conn.sendall(text.encode() + b"\n")
            except OSError:
                pass

    def run(self) -> None:
        held = b""
        with self.conn:
            while True:
                data = self.conn.recv(65_536)
                *lines, held = (held + data).split(b"\n")
                for line in lines + ([held] if not data and held else []):
                    if line.strip():
                        self.start_request(line.decode("utf-8", "replace"))
                if not data:
                    break
                if len(held) > LONGEST_LINE:
                    self.send(reply(None, '"error":"request too long"'))
                    break
            self.end_request(cancel=False)

    def start_request(self, line: str) -> None:
        self.end_request(cancel=True)
        cancel, tag = threading.Event(), f"request-{uuid.uuid4().hex}"

        def work() -> None:
            spark = self.server.snapshot().entries.sparkSession
            spark.addTag(tag)
            self.send(handle(line, self.server.snapshot, self.server.index_path, cancel.is_set))

        thread = threading.Thread(target=work, daemon=True)
        self.request = thread, cancel, tag
        thread.start()

    def end_request(self, cancel: bool) -> None:
        if self.request is None:
            return
        thread, event, tag = self.request
        if cancel and thread.is_alive():
            event.set()
            self.server.snapshot().entries.sparkSession.interruptTag(tag)
        thread.join()
        self.request = None


class Server:
    """Serves the snapshot that ``publish`` gave last; requests that are under way keep theirs."""

    def __init__(self, snapshot: Snapshot, socket_path: str, index_path: str = ""):
        self._snapshot, self.index_path, self.socket_path = snapshot, index_path, socket_path
        if running(socket_path):
            raise RuntimeError(f"a server listens on {socket_path} already")
        if os.path.exists(socket_path):
            os.unlink(socket_path)
        os.makedirs(os.path.dirname(socket_path) or ".", exist_ok=True)
        self.listener = socket.socket(socket.AF_UNIX, socket.SOCK_STREAM)
        self.listener.bind(socket_path)
        os.chmod(socket_path, 0o600)
        self.listener.listen()
        self.thread = threading.Thread(target=self._accept, daemon=True)
        self.thread.start()

    def snapshot(self) -> Snapshot:
        return self._snapshot

    def publish(self, snapshot: Snapshot) -> None:
        self._snapshot = snapshot

    def _accept(self) -> None:
        while True:
            try:
                conn, _ = self.listener.accept()
            except OSError:
                return
            _Connection(self, conn).start()

    def stop(self) -> None:
        self.listener.shutdown(socket.SHUT_RDWR)
        self.listener.close()
        if os.path.exists(self.socket_path):
            os.unlink(self.socket_path)


def running(socket_path: str) -> bool:
    """Whether something answers on the socket."""
    try:
        with socket.socket(socket.AF_UNIX, socket.SOCK_STREAM) as s:
            s.connect(socket_path)
        return True
    except OSError:
        return False
