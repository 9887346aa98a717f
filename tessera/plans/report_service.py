"""Reports of a cube over HTTP: a GET endpoint and its client, both of the standard library.

The parameters are those of ``parse_query``; the answer is the JSON of ``QueryResult``. A query that
the cube can't answer is a 400 with the reason. Requests are served one after the other by each thread; the work is Spark's.
"""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from threading import Thread
from urllib.error import HTTPError
from urllib.parse import parse_qsl, urlencode, urlsplit
from urllib.request import urlopen

from tessera.plans.cube import Cube, CubeQuery, QueryError, parse_query


class ReportService:
    """Serves the reports of ``cube`` at ``path`` until closed; port 0 takes a free one."""

    def __init__(self, cube: Cube, host: str = "127.0.0.1", port: int = 0, path: str = "/"):
        service = self

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self) -> None:  # noqa: N802
                at = urlsplit(self.path)
                status, body = service.answer(dict(parse_qsl(at.query))) if at.path == path else (404, {"error": "not found"})
                data = (body if isinstance(body, str) else json.dumps(body)).encode()
                self.send_response(status)
                self.send_header("Content-Type", "application/json")
                self.send_header("Content-Length", str(len(data)))
                self.end_headers()
                self.wfile.write(data)

            def log_message(self, *args) -> None:
                pass

        self.cube = cube
        self._server = ThreadingHTTPServer((host, port), Handler)
        self.url = f"http://{host}:{self._server.server_port}{path}"
        self._thread = Thread(target=self._server.serve_forever, daemon=True)
        self._thread.start()

    def answer(self, params: dict) -> tuple[int, str | dict]:
        try:
            return 200, self.cube.query(parse_query(params)).to_json()
        except (QueryError, ValueError, KeyError, TypeError) as e:
            return 400, {"error": str(e)}

    def close(self) -> None:
        self._server.shutdown()
        self._server.server_close()
        self._thread.join()


class ReportClient:
    """Asks a ``ReportService``."""

    def __init__(self, url: str, timeout: float = 60.0):
        self.url, self.timeout = url, timeout

    def query(self, q: CubeQuery) -> dict:
        """The report as a dictionary; ``QueryError`` if the cube can't answer."""
        try:
            with urlopen(f"{self.url}?{urlencode(q.to_params())}", timeout=self.timeout) as answer:
                return json.loads(answer.read())
        except HTTPError as e:
            if e.code == 400:
                raise QueryError(json.loads(e.read())["error"]) from None
            raise
