"""A small HTTP front for the codec: encode, decode, check and redirect. Spark is not needed to serve a code."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from linkfold import api
from linkfold.functions import kernels


def answer(method: str, target: str, body: str = "") -> tuple[int, dict[str, str], str]:
    """Status, headers and body of a request."""
    parts = urlsplit(target)
    path, query = parts.path, parse_qs(parts.query)
    if method == "OPTIONS":
        return 204, {"Access-Control-Allow-Origin": "*"}, ""
    if method == "POST" and path in ("/encode", "/shorten", "/decode"):
        try:
            value = json.loads(body or "{}")
            value = value["code" if path == "/decode" else "url"]
        except (ValueError, KeyError, TypeError):
            return 400, {}, json.dumps({"error": "a JSON object with the field is needed"})
        if path != "/decode":
            return 200, {}, json.dumps({"code": kernels.encode(str(value))})
        url, error = kernels.try_resolve(str(value))
        return (200, {}, json.dumps({"url": url})) if error is None else (400, {}, json.dumps({"error": error}))
    if method != "GET":
        return 404, {}, json.dumps({"error": "not found"})
    if path == "/health":
        return 200, {}, json.dumps({"status": "ok"})
    if path == "/check":
        return (200, {}, json.dumps({"state": api.probe(query["target"][0])})) if "target" in query else (400, {}, json.dumps({"error": "target is missing"}))
    if path == "/":
        return 200, {}, json.dumps({"service": "linkfold"})
    url, error = kernels.try_resolve(path[1:])
    return (302, {"Location": url}, "") if error is None and url else (404, {}, json.dumps({"error": "not found"}))


class Handler(BaseHTTPRequestHandler):
    timeout = 5

    def _serve(self) -> None:
        size = int(self.headers.get("Content-Length") or 0)
        status, headers, body = answer(self.command, self.path, self.rfile.read(size).decode("utf-8", "replace"))
        self.send_response(status)
        for k, v in {"Content-Type": "application/json", "Content-Length": str(len(body.encode())), **headers}.items():
            self.send_header(k, v)
        self.end_headers()
        self.wfile.write(body.encode())

    do_GET = do_POST = do_OPTIONS = _serve

    def log_message(self, *args: object) -> None:
        pass


def serve(port: int = 8080) -> None:
    ThreadingHTTPServer(("127.0.0.1", port), Handler).serve_forever()
