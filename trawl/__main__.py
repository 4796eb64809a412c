"""Command line: python -m trawl COMMAND [--project DIR]."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from trawl import config as settings
from trawl.errors import RequestError

STATE = ".trawl"
IGNORE = ".trawlignore"
VERSION = "0.2"


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="trawl", description="Hybrid search over a source tree.")
    top.add_argument("--project", default=".", help="the tree's root")
    top.add_argument("--json", action="store_true", help="answer in JSON")
    sub = top.add_subparsers(dest="command", required=True)
    sub.add_parser("init", help="write a configuration").add_argument("--auto", action="store_true", help="include patterns from the languages found")
    sub.add_parser("index", help="index everything").add_argument("--force", action="store_true", help="forget the index first")
    sub.add_parser("update", help="index what changed since")
    find = sub.add_parser("search", help="search")
    find.add_argument("query", nargs="+")
    find.add_argument("--limit", type=int, default=0)
    find.add_argument("--level", action="append", default=[])
    scope = find.add_mutually_exclusive_group()
    scope.add_argument("--path")
    scope.add_argument("--subproject")
    scope.add_argument("--all", action="store_true")
    find.add_argument("--no-hybrid", action="store_true")
    find.add_argument("--no-rerank", action="store_true")
    find.add_argument("--verbose", action="store_true")
    find.add_argument("--metrics", action="store_true")
    sub.add_parser("status", help="what is indexed")
    sub.add_parser("subprojects", help="list subprojects")
    conf = sub.add_parser("config", help="show or change settings")
    conf.add_argument("action", nargs="?", choices=("get", "set", "provider", "model"))
    conf.add_argument("key", nargs="?")
    conf.add_argument("value", nargs="?")
    serve = sub.add_parser("serve", help="answer over HTTP")
    serve.add_argument("--host", default="127.0.0.1")
    serve.add_argument("--port", type=int, default=0)
    sub.add_parser("version", help="print the version")
    return top


def config_path(project: str) -> Path:
    return Path(project) / STATE / settings.CONFIG_NAME


def configure(args: argparse.Namespace) -> str:
    """Shows all settings or one, or changes one in the project's file."""
    path = config_path(args.project)
    if not path.is_file():
        raise RequestError("CONFIG_NOT_FOUND", str(path))
    now = settings.load(str(path))
    if not args.action:
        return json.dumps(now.as_dict(), indent=2)
    key, value = (args.key, args.value) if args.action in ("get", "set") else (args.action, args.key)
    if not key or (args.action == "set" and value is None):
        raise RequestError("INVALID_REQUEST", "name the setting" if not key else "give a value")
    if args.action == "get" or value is None:
        return json.dumps(now.get(key))
    settings.save(now.set(key, value), str(path))
    return f"{key} = {value}"


def initialise(args: argparse.Namespace, spark=None) -> str:
    """Writes the project's configuration, with patterns of the languages found if asked to."""
    if not Path(args.project).is_dir():
        raise RequestError("INVALID_PROJECT_ROOT", args.project)
    path = config_path(args.project)
    if path.exists():
        raise RequestError("PROJECT_ALREADY_INITIALIZED", str(path))
    now = settings.Config()
    if args.auto:
        from trawl.session import local_session
        from trawl.sources import files

        found = files.detect_extensions(files.read_tree(spark or local_session(), str(Path(args.project).resolve())).select("path"))
        patterns = tuple(f"**/*{r['extension']}" for r in found.collect())
        now = now.merge({"include": patterns}) if patterns else now
    settings.save(now, str(path))
    return str(path)


def engine(project: str, spark=None):
    from trawl.api import Engine
    from trawl.session import local_session
    from trawl.sources.embedders import embedder_for

    path, root = config_path(project), Path(project).resolve()
    if not path.is_file():
        raise RequestError("PROJECT_NOT_INITIALIZED", str(root))
    now = settings.load(str(path))
    ignore = (root / IGNORE).read_text().splitlines() if (root / IGNORE).is_file() else ()
    return Engine(spark or local_session(), str(root), str(root / STATE / "index"), now, embedder_for(now.provider, now.model, now.key, now.url), ignore)


def found(args: argparse.Namespace, e) -> str:
    """Search results as JSON, compact lines or blocks, with metrics if asked for."""
    from pyspark.sql import functions as F

    from trawl.functions import display
    from trawl.service import Service

    scope = {"mode": "all"} if args.all else {"mode": "path", "value": args.path} if args.path else {"mode": "subproject", "value": args.subproject} if args.subproject else {}
    asked = {"query": " ".join(args.query), "limit": args.limit, "levels": args.level, "scope": scope}
    asked |= ({"hybrid_enabled": False} if args.no_hybrid else {}) | ({"rerank_enabled": False} if args.no_rerank else {})
    status, answer = Service(e).handle("POST", "/search", json.dumps(asked))
    if status != 200:
        raise RequestError(answer["code"], answer.get("details", ""))
    rows = answer["results"]
    kinds = "n int, file string, start_line int, end_line int, level string, name string, score double, match_source string, match_reasons array<string>, content string"
    table = e.spark.createDataFrame([(i + 1, r["file"], r["start_line"], r["end_line"], r["level"], r.get("name"), float(r.get("score", 0)), r.get("match_source", ""), r.get("match_reasons", []), r.get("content", "")) for i, r in enumerate(rows)], kinds)
    if args.metrics:
        answer["metrics"] = e.savings(table).first().asDict()
    if args.json:
        return json.dumps(answer, indent=2, default=str)
    c = F.col
    about = (c("n"), c("file"), c("start_line"), c("end_line"), c("level"), c("name"), c("score"))
    line = display.verbose_block(*about, display.source_label(c("match_source")), c("match_reasons"), c("content")) if args.verbose else display.compact_line(*about)
    out = [r["line"] for r in table.select("n", line.alias("line")).orderBy("n").collect()] or ["nothing found"]
    if args.metrics:
        out.append(", ".join(f"{k} {v}" for k, v in answer["metrics"].items()))
    return "\n".join(out)


def run(argv: list[str], spark=None) -> str:
    args = parser().parse_args(argv)
    if args.command == "version":
        return f"trawl {VERSION}"
    if args.command == "config":
        return configure(args)
    if args.command == "init":
        return initialise(args, spark)
    e = engine(args.project, spark)
    if args.command == "search":
        return found(args, e)
    if args.command == "index":
        if args.force:
            e.clear()
        return json.dumps(e.reindex())
    if args.command == "update":
        e.update(e.reconcile())
        return json.dumps(e.status())
    from trawl.functions.display import text_table
    from trawl.service import Service, server

    service = Service(e)
    if args.command == "serve":
        http = server(service, args.host, args.port)
        print(f"http://{args.host}:{http.server_port}", flush=True)
        http.serve_forever()
    status, answer = service.handle("GET", f"/{args.command}")
    if status != 200:
        raise RequestError(answer["code"], answer.get("details", ""))
    if args.command == "subprojects" and not args.json:
        return text_table(answer["subprojects"], ["id", "path", "marker_file", "language_hint"])
    return json.dumps(answer, indent=2, default=str)


def main() -> int:
    try:
        print(run(sys.argv[1:]))
    except RequestError as e:
        print(f"{e.code}: {e.details or e.message} ({e.suggestion})", file=sys.stderr)
        return 1
    except settings.ConfigError as e:
        print(f"CONFIG_INVALID: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
