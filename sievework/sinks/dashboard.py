"""A local page that runs an analysis each time it is loaded and shows the report."""

from __future__ import annotations

from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

TYPES = {"html": "text/html; charset=utf-8", "json": "application/json; charset=utf-8"}


def server(host: str, port: int, render: Callable[[str, str | None], str]) -> HTTPServer:
    """An HTTP server for ``render(format, root)``: / gives the page, /report.json the document; ``?root=`` names another
    tree. What is wrong with a request gives 400, anything else than these paths 404."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            url = urlparse(self.path)
            kind = {"/": "html", "/report.json": "json"}.get(url.path)
            if kind is None:
                return self.send_error(404)
            try:
                body = render(kind, parse_qs(url.query).get("root", [None])[0]).encode("utf-8", "surrogatepass")
            except (ValueError, OSError) as x:
                return self.send_error(400, str(x)[:200])
            self.send_response(200)
            self.send_header("Content-Type", TYPES[kind])
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_: object) -> None:
            pass

    return HTTPServer((host, port), Handler)
