"""The read queries over HTTP: JSON in, JSON out.

Lists are streamed partition by partition, so the driver never holds a whole
one; details are bounded by what one id has.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, unquote, urlsplit

from pyspark.sql import DataFrame, SparkSession

from kinweave.plans import reads
from kinweave.sources.tables import Catalogue

#: Fixed value: the port that clients of the read queries know.
PORT = 5001
Answer = DataFrame | Mapping[str, DataFrame]


class Service:
    """Answers requests from a catalogue; ``POST /api/config`` switches its profile."""

    def __init__(self, spark: SparkSession, catalogue: Catalogue, profile: str = "default"):
        self._spark, self._catalogue, self.profile = spark, catalogue, profile

    def answer(self, method: str, path: str, query: dict[str, str], body: dict) -> Answer:
        """The tables that answer a request; KeyError if nothing is there, ValueError if it makes no sense."""
        t = self._catalogue.tables
        parts = [unquote(p) for p in path.strip("/").split("/")]
        if method == "POST" and parts == ["api", "config"]:
            self._catalogue.switch(body.get("config", ""))
            self.profile = body["config"]
            return reads.configs(self._spark, self.profile)
        plain: dict[tuple[str, ...], Callable[[], Answer]] = {
            ("health",): lambda: reads.health(self._spark, self.profile),
            ("config",): lambda: reads.configs(self._spark, self.profile),
            ("clusters",): lambda: reads.clusters(t),
            ("entities",): lambda: reads.entities(t),
            ("parties",): lambda: reads.parties(t),
            ("dashboard", "stats"): lambda: reads.dashboard(t),
            ("search",): lambda: reads.search(t, query.get("q", "")),
        }
        of_one = {"clusters": reads.cluster_detail, "entities": reads.entity_detail, "parties": reads.party_detail}
        if method == "GET" and parts[:1] == ["api"]:
            rest = tuple(parts[1:])
            if rest in plain:
                return plain[rest]()
            if len(rest) == 2 and rest[0] in of_one:
                return of_one[rest[0]](t, rest[1])
            if len(rest) == 3 and rest[0] == "parties" and rest[2] == "detail":
                return reads.party_context(t, rest[1])
        raise KeyError(path)


def _rows(df: DataFrame) -> Iterator[str]:
    yield "["
    for i, row in enumerate(reads.as_json(df).toLocalIterator()):
        yield ("," if i else "") + row["json"]
    yield "]"


def json_text(answer: Answer) -> Iterator[str]:
    """The JSON of an answer, piece by piece: a list of rows, or an object of such lists."""
    if isinstance(answer, DataFrame):
        yield from _rows(answer)
        return
    yield "{"
    for i, (name, df) in enumerate(answer.items()):
        yield f"{',' if i else ''}{json.dumps(name)}:"
        yield from _rows(df)
    yield "}"


def serve(service: Service, port: int = PORT, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """A server for the service, not started; ``serve_forever`` runs it."""

    class Handler(BaseHTTPRequestHandler):
        def _reply(self, status: int, pieces: Iterator[str]) -> None:
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.end_headers()
            for piece in pieces:
                self.wfile.write(piece.encode())

        def _handle(self, method: str) -> None:
            url = urlsplit(self.path)
            try:
                raw = self.rfile.read(int(self.headers.get("Content-Length") or 0))
                body = json.loads(raw) if raw else {}
                answer = service.answer(method, url.path, {k: v[0] for k, v in parse_qs(url.query).items()}, body)
            except KeyError as e:
                return self._reply(404, iter([json.dumps({"error": f"not found: {e.args[0]}"})]))
            except ValueError as e:
                return self._reply(400, iter([json.dumps({"error": str(e)})]))
            return self._reply(200, json_text(answer))

        def do_GET(self) -> None:
            self._handle("GET")

        def do_POST(self) -> None:
            self._handle("POST")

        def log_message(self, *args: object) -> None:
            """Requests aren't logged."""

    return ThreadingHTTPServer((host, port), Handler)
