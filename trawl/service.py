"""Requests and answers as JSON, by a plain function or over HTTP."""

from __future__ import annotations

import json
import time
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as Late
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any

from trawl.api import Engine
from trawl.config import ConfigError
from trawl.errors import RequestError
from trawl.functions import scoring
from trawl.sources.embedders import EmbeddingError

SECRET = ("key",)
SCOPES = ("auto", "all", "path", "subproject")


def search_options(body: dict[str, Any]) -> dict[str, Any]:
    """A search request's fields as options of ``Engine.search``; unset switches leave the configuration's."""
    scope = body.get("scope") or {}
    if not isinstance(scope, dict) or scope.get("mode", "auto") not in SCOPES:
        raise RequestError("INVALID_REQUEST", f"scope has a mode of {SCOPES}")
    mode, value = scope.get("mode", "auto"), scope.get("value")
    if mode in ("path", "subproject") and not value:
        raise RequestError("INVALID_REQUEST", f"scope {mode} needs a value")
    limit, levels = body.get("limit") or 0, body.get("levels") or []
    if not isinstance(limit, int) or limit < 0 or not isinstance(levels, list):
        raise RequestError("INVALID_REQUEST", "limit is a whole number of 0 or more, levels a list")
    out = {"limit": limit, "levels": tuple(levels), "scope": mode, "path_prefix": body.get("path_prefix") or None}
    if mode == "path":
        out["path_prefix"] = value
    elif mode == "subproject":
        out["subproject"] = value
    return out | {k: body[f] for k, f in (("hybrid", "hybrid_enabled"), ("rerank", "rerank_enabled")) if body.get(f) is not None}


class Service:
    """Answers (method, path, body) with (status, document); every failure is an error of the catalogue."""

    def __init__(self, engine: Engine):
        self.engine, self.began = engine, time.time()
        self.routes = {
            ("GET", "/health"): self.health, ("GET", "/status"): self.status, ("POST", "/search"): self.search,
            ("POST", "/reindex"): self.reindex, ("GET", "/config"): self.config, ("GET", "/subprojects"): self.subprojects,
        }

    def handle(self, method: str, path: str, body: str = "") -> tuple[int, dict]:
        try:
            route = self.routes.get((method, path.split("?")[0].rstrip("/") or "/"))
            if not route:
                known = any(p == path for _, p in self.routes)
                raise RequestError("METHOD_NOT_ALLOWED" if known else "NOT_FOUND", f"{method} {path}")
            try:
                asked = json.loads(body) if body.strip() else {}
            except ValueError as e:
                raise RequestError("INVALID_JSON", str(e)) from e
            if not isinstance(asked, dict):
                raise RequestError("INVALID_JSON", "the body is an object")
            return 200, self._timed(route, asked)
        except RequestError as e:
            return e.status, e.as_dict()
        except EmbeddingError as e:
            failed = RequestError("EMBEDDER_UNAVAILABLE" if e.retryable else "EMBEDDING_FAILED", str(e))
            return failed.status, failed.as_dict()
        except ConfigError as e:
            failed = RequestError("CONFIG_INVALID", str(e))
            return failed.status, failed.as_dict()
        except Exception as e:  # a request never ends the server
            failed = RequestError("SEARCH_FAILED" if path == "/search" else "INTERNAL", str(e)[:500])
            return failed.status, failed.as_dict()

    def _timed(self, route, asked: dict) -> dict:
        """The answer, unless it takes longer than a request may; reindexing has no limit."""
        if route == self.reindex:
            return route(asked)
        pool = ThreadPoolExecutor(1)
        try:
            return pool.submit(route, asked).result(self.engine.config.request_ms / 1000)
        except Late as e:
            raise RequestError("TIMEOUT") from e
        finally:
            pool.shutdown(wait=False)

    def health(self, _: dict) -> dict:
        return self.engine.health() | {"timestamp": int(time.time())}

    def status(self, _: dict) -> dict:
        n, progress = self.engine.status(), self.engine.progress()
        index = {"total_files": n["files"], "total_chunks": n["chunks"], "indexing_active": progress is not None}
        at = self.engine.store.metadata().get("last_indexed")
        index |= ({"last_indexed_at": int(at)} if at else {}) | ({"progress": progress} if progress else {})
        return {"service": {"running": True, "uptime_seconds": round(time.time() - self.began, 1)}, "index": index}

    def search(self, asked: dict) -> dict:
        query = asked.get("query")
        if not isinstance(query, str) or not query.strip():
            raise RequestError("QUERY_EMPTY")
        began, options = time.time(), search_options(asked)
        rows = self.engine.search(query, **options).collect()
        return {
            "query": query, "results": [result(r.asDict()) for r in rows], "total_results": len(rows), "search_time_ms": round(1000 * (time.time() - began)),
            "scope": {"mode": options["scope"]} | {k: v for k, v in (("subproject", options.get("subproject")), ("resolved_path", options["path_prefix"])) if v},
            "hybrid_enabled": options.get("hybrid", self.engine.config.hybrid.enabled), "rerank_enabled": options.get("rerank", self.engine.config.rerank.enabled),
        }

    def reindex(self, asked: dict) -> dict:
        if asked.get("force"):
            self.engine.clear()
        return {"status": "completed", "indexed": self.engine.reindex()}

    def config(self, _: dict) -> dict:
        return {"config": {k: "***" if k in SECRET and v else v for k, v in self.engine.config.as_dict().items()}}

    def subprojects(self, _: dict) -> dict:
        rows = [r.asDict() for r in self.engine.subprojects().collect()]
        return {"subprojects": rows, "total": len(rows)}


def result(row: dict) -> dict:
    """One search result; blank fields are left out."""
    signals = {s: round(row[s], 6) for s in scoring.SIGNALS if row.get(s)}
    details = {"vector_score": row.get("vector_score"), "keyword_score": row.get("keyword_score"), "rrf_score": row.get("rrf_score"), "reranker_score": row.get("final_score"), "signal_scores": signals}
    parent = {"id": row.get("parent_id"), "name": row.get("parent_name"), "level": row.get("parent_level")} if row.get("parent_name") else None
    out = {
        "id": row.get("chunk_id"), "file": row.get("path"), "start_line": row.get("start_line"), "end_line": row.get("end_line"), "level": row.get("level"),
        "language": row.get("language"), "name": row.get("name"), "score": row.get("final_score", row.get("score")), "content": row.get("content"), "parent": parent,
        "match_source": row.get("match_source"), "score_details": {k: v for k, v in details.items() if v}, "match_reasons": row.get("match_reasons"), "matched_splits": row.get("matched_splits"),
    }
    return {k: v for k, v in out.items() if v not in (None, [], {})}


def server(service: Service, host: str = "127.0.0.1", port: int = 0) -> ThreadingHTTPServer:
    """An HTTP server of the service; port 0 takes a free one (``server_port`` says which)."""

    class Handler(BaseHTTPRequestHandler):
        def _answer(self) -> None:
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0)).decode("utf-8", "replace")
            status, document = service.handle(self.command, self.path, body)
            raw = json.dumps(document, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        do_GET = do_POST = do_PUT = do_DELETE = _answer

        def log_message(self, *_: object) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
