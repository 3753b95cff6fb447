"""A web page that takes questions and shows answers with their sources; the conversation is kept by the page, not the server."""

from __future__ import annotations

import json
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.chat import NO_SOURCES, sources_view

PAGE = """<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>weftline</title></head><body>
<div id="turns"></div><form id="form"><input id="query" size="60" autofocus><button>Ask</button> <button type="button" id="clear">Clear</button></form><pre id="sources"></pre>
<script>
const $ = (id) => document.getElementById(id);
const turn = (who, text) => { const p = document.createElement("p"); p.textContent = who + ": " + text; $("turns").append(p); };
$("form").onsubmit = async (e) => {
  e.preventDefault();
  const query = $("query").value;
  if (!query.trim()) return;
  $("query").value = "";
  turn("user", query);
  const got = await (await fetch("/ask", { method: "POST", body: JSON.stringify({ query }) })).json();
  turn("assistant", got.answer);
  $("sources").textContent = got.sources;
};
$("clear").onclick = () => { $("turns").replaceChildren(); $("query").value = ""; $("sources").textContent = ""; };
</script></body></html>"""


def reply(ask: Callable[[str], DataFrame], body: bytes) -> dict[str, str]:
    """``answer`` and ``sources`` of a request ``{"query"}``; a blank question has neither."""
    query = str(json.loads(body or b"{}").get("query") or "").strip()
    if not query:
        return {"answer": "", "sources": ""}
    row = ask(query).select("answer", sources_view(F.col("sources")).alias("sources")).first()
    return {"answer": row.answer, "sources": row.sources} if row else {"answer": "", "sources": NO_SOURCES}


def handler(ask: Callable[[str], DataFrame]) -> type[BaseHTTPRequestHandler]:
    class Handler(BaseHTTPRequestHandler):
        def _send(self, code: int, kind: str, body: bytes) -> None:
            self.send_response(code)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def do_GET(self) -> None:
            self._send(200, "text/html; charset=utf-8", PAGE.encode()) if self.path == "/" else self._send(404, "text/plain", b"not found")

        def do_POST(self) -> None:
            try:
                got, code = reply(ask, self.rfile.read(int(self.headers.get("Content-Length") or 0))), 200
            except Exception as e:  # shown to whoever asked
                got, code = {"answer": f"{type(e).__name__}: {e}", "sources": ""}, 500
            self._send(code, "application/json", json.dumps(got, ensure_ascii=False).encode())

    return Handler


def serve(ask: Callable[[str], DataFrame], port: int, host: str = "127.0.0.1") -> None:
    """Serves the page until interrupted."""
    with ThreadingHTTPServer((host, port), handler(ask)) as server:
        print(f"http://{host}:{server.server_address[1]}/")
        server.serve_forever()
