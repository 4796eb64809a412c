"""Stores, the stored keyword index, configuration files, requests over HTTP and the command line."""

import json
import threading
import urllib.error
import urllib.request

import pytest
from pyspark.sql import functions as F

from trawl import __main__ as cli
from trawl import config as settings
from trawl.api import Engine, Progress
from trawl.errors import CATALOGUE, RequestError
from trawl.operators import keyword, postings, rerank, store
from trawl.plans.search import requests
from trawl.service import Service, search_options, server
from trawl.sources import embedders, files, folders, yaml

DOCS = [(f"c{i}", f"alpha beta{' gamma' * (i % 3)} w{i}", f"name{i}", f"src/f{i}.py") for i in range(30)]
CHUNK = "chunk_id string, content string, name string, path string"


def found(index, query):
    return {r.chunk_id: round(r.score, 6) for r in postings.search(index, query, 100).collect()}


def test_keyword_index_changes(spark, tmp_path):
    """After every change the index answers like one built anew."""
    index = postings.KeywordIndex(spark, str(tmp_path / "k"))
    index.add(spark.createDataFrame(DOCS[:10], CHUNK))
    index.add(spark.createDataFrame(DOCS[10:], CHUNK))
    now = {d[0]: d for d in DOCS}
    changed = [("c3", "delta alpha", "n", "p"), ("c40", "gamma delta delta", "n", "p")]

    def same():
        fresh = postings.Unstored(keyword.tokenized(spark.createDataFrame(list(now.values()), CHUNK)))
        for q in ("gamma", "delta OR gamma", '"alpha beta"', "w1* NOT gamma", "path:src AND alpha", "nothing"):
            assert found(index, q) == found(fresh, q), q
        assert index.n == len(now)

    same()
    index.add(spark.createDataFrame(changed, CHUNK))
    now |= {d[0]: d for d in changed}
    same()
    index.remove(spark.createDataFrame([("c5",), ("c40",), ("unknown",)], "chunk_id string"))
    now = {k: d for k, d in now.items() if k not in ("c5", "c40")}
    same()
    again = postings.KeywordIndex(spark, str(tmp_path / "k"))
    assert again.state == index.state
    index.compact()
    same()
    assert index.state["n_dead"] == 0 and len(index.state["segments"]) == 1
    index.rebuild(spark.createDataFrame(DOCS[:4], CHUNK))
    now = {d[0]: d for d in DOCS[:4]}
    same()


def test_keyword_search_reads_its_terms_only(spark, tmp_path):
    index = postings.KeywordIndex(spark, str(tmp_path / "k"))
    index.rebuild(spark.createDataFrame(DOCS, CHUNK))
    plan = index.rows(["alpha"], [])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "EqualTo(term,alpha)" in plan and "content" not in plan.replace("n_content", "").replace("p_content", "")
    batch = postings.search_batch(index, spark.createDataFrame([(1, ["gamma", "w3"]), (2, [])], "query_id int, terms array<string>"), 3).collect()
    assert [r["rank"] for r in sorted(batch, key=lambda r: r["rank"])] == [1, 2, 3] and {r.query_id for r in batch} == {1}


def test_store_changes_only_what_is_touched(spark, tmp_path):
    s = store.IndexStore(spark, str(tmp_path / "s"), buckets=8)
    rows = spark.createDataFrame([(f"p{i}", i) for i in range(40)], "path string, n int")
    s.write("t", rows, by="path")
    before = s._manifest("t")["parts"]
    s.change("t", spark.createDataFrame([("p1", 100)], "path string, n int"), spark.createDataFrame([("p1",), ("p2",)], "path string"))
    after = s._manifest("t")["parts"]
    assert sum(before[b] != after.get(b) for b in before) <= 2
    assert {r.path: r.n for r in s.read("t").collect()} == {f"p{i}": i for i in range(40) if i not in (1, 2)} | {"p1": 100}
    s.append("t", spark.createDataFrame([("q", 7)], "path string, n int"))
    assert s.lookup("t", ["q", "p3", "none"]).count() == 2 and s.lookup("t", [7], "n").count() == 2
    s.change("t", spark.createDataFrame([("q", 8, "x")], "path string, n int, more string"), spark.createDataFrame([("q",)], "path string"))
    assert {r.more for r in s.read("t").collect()} == {None, "x"}
    version = s.version("t")
    with pytest.raises(store.ConflictError):
        s._publish("t", s._manifest("t"), version - 1)


def test_metadata_and_migrations(spark, tmp_path):
    s = store.IndexStore(spark, str(tmp_path / "s"))
    s.set_metadata(a="1", b="2")
    s.set_metadata(a="3")
    s.delete_metadata("b", "none")
    assert s.metadata() == {"a": "3"}
    s.write("files", spark.createDataFrame([("x",)], "path string"), by="path")
    assert s.migrate() == len(store.MIGRATIONS) == s.migrate()
    assert s.read("files").columns == ["path", "language", "size"] and s.metadata()["schema_version"] == str(len(store.MIGRATIONS))
    assert not store.provider_changed({}, "a", "b") and store.provider_changed({"embedding_provider": "a", "embedding_model": "b"}, "a", "c")


def test_two_models_of_one_size_differ():
    a, b = embedders.openai("x", "k"), embedders.openai("y", "k")
    assert a.dimensions == b.dimensions and embedders.model_of(a) != embedders.model_of(b)
    assert embedders.embedder_for("ollama", "v4").dimensions == 1024 and embedders.embedder_for("mock").name == "mock"
    for bad in (("openai",), ("nope",)):
        with pytest.raises(embedders.EmbeddingError):
            embedders.embedder_for(*bad)


def test_publish_replaces_whole(spark, tmp_path):
    path = str(tmp_path / "x" / "CURRENT")
    assert folders.read_text(spark, path) is None
    for text in ("one", "two"):
        folders.publish(spark, path, text)
        assert folders.read_text(spark, path) == text
    assert [p.name for p in (tmp_path / "x").iterdir()] == ["CURRENT"]


def test_locked_files_are_tried_again():
    calls, waits = [], []

    def locked():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("locked")
        return "text"

    assert files.with_retry(locked, sleep=waits.append) == "text" and waits == [0.1, 0.2]
    with pytest.raises(OSError):
        files.with_retry(lambda: (_ for _ in ()).throw(OSError()), sleep=waits.append)


def test_read_files_by_name(spark, tmp_path):
    for name in ("a.py", "b[1].py", "c.py"):
        (tmp_path / name).write_text(name)
    got = files.read_files(spark, str(tmp_path), ["a.py", "b[1].py", "gone.py"])
    assert {(r.path, bytes(r.content).decode()) for r in got.collect()} == {("a.py", "a.py"), ("b[1].py", "b[1].py")}
    assert files.read_files(spark, str(tmp_path), []).count() == 0


def test_fallback_at_execution(spark):
    rows = spark.createDataFrame([("a", "x", "n", "p", "t", 0.5, None)], "chunk_id string, content string, name string, path string, chunk_type string, base_score double, modified_at timestamp")
    fails = lambda d, *_: d.withColumn("final_score", F.raise_error(F.lit("broken")).cast("double"))
    assert rerank.FallbackReranker(fails)(rows, "q", F.current_timestamp()).count() == 1
    slow = lambda d, *_: (threading.Event().wait(1), d)[1]
    assert "signal_scores" in rerank.FallbackReranker(slow, timeout=0.05)(rows, "q", F.current_timestamp()).columns


def test_yaml():
    tree = {"a": 1, "b": {"c": ["x", "**/*.go", 'it: "s'], "d": None, "e": [{"id": "q", "path": "a/b"}, {"id": "r"}]}, "f": True, "g": [], "h": "10", "i": 1.5}
    assert yaml.parse(yaml.dump(tree)) == tree
    assert yaml.parse("a: [1, 'x']  # c\nb:\n- y\n- z: 1\n  w: 2\n") == {"a": [1, "x"], "b": ["y", {"z": 1, "w": 2}]}
    assert yaml.parse("") == {}
    for bad in ("a: 1\n   b: 2\n", "\ta: 1", "- a\nb: 1\n"):
        with pytest.raises(yaml.YamlError):
            yaml.parse(bad)


def test_config_files(tmp_path):
    user, project = tmp_path / "user.yaml", tmp_path / "p" / "config.yaml"
    user.write_text("search:\n  default_limit: 7\n  hybrid:\n    rrf_k: 30\nembedding:\n  ollama_url: http://far:1\n  model: m\n")
    project.parent.mkdir()
    project.write_text("search:\n  default_limit: 5\nwatcher:\n  debounce_ms: 20\nsubprojects:\n  projects:\n    - id: api\n      path: src/api\n")
    c = settings.load(str(project), str(user))
    assert (c.default_limit, c.hybrid.rrf_k, c.debounce_ms, c.provider, c.model, c.url) == (5, 30, 20, "ollama-remote", "m", "http://far:1")
    assert c.subprojects == (("api", "src/api", ""),)
    settings.save(c, str(project))
    assert settings.load(str(project)) == c
    assert settings.migrated({"embedding": {"model": "m"}})["embedding"]["provider"] == "ollama"
    assert c.set("hybrid.enabled", "false").hybrid.enabled is False and c.set("include", "*.x").include == ("*.x",)
    for key, value in (("default_limit", "x"), ("nope", "1"), ("default_limit", "0")):
        with pytest.raises(settings.ConfigError):
            c.set(key, value)


@pytest.mark.parametrize("body", [{"scope": {"mode": "x"}}, {"scope": {"mode": "path"}}, {"limit": -1}, {"levels": "file"}])
def test_bad_requests(body):
    with pytest.raises(RequestError, match="INVALID_REQUEST"):
        search_options(body)


def test_request_table(spark):
    lines = ['{"query": "a", "limit": 3, "levels": ["file"], "scope": {"mode": "path", "value": "src"}, "more": 1}', '{"query": " "}', "{broken"]
    rows = requests(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert (rows[0].limit, rows[0].levels, rows[0].scope.value, rows[0].error) == (3, ["file"], "src", None)
    assert [r.error for r in rows[1:]] == ["QUERY_EMPTY"] * 2


def test_catalogue():
    assert all(400 <= s < 600 and m and h for s, m, h in CATALOGUE.values())
    assert RequestError("TIMEOUT", "x").as_dict()["details"] == "x"


@pytest.fixture(scope="module")
def project(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("project")
    (root / "api").mkdir()
    (root / "api" / "go.mod").write_text("module x\n")
    (root / "api" / "auth.py").write_text("class Auth:\n    def login(self, user):\n        return user\n\n    def logout(self):\n        return None\n")
    (root / "main.py").write_text("def main():\n    print('login')\n")
    (root / ".trawlignore").write_text("skipped/\n")
    cli.run(["--project", str(root), "init"], spark)
    return root


def test_command_line_and_http(spark, project):
    run = lambda *a: cli.run(["--project", str(project), *a], spark)
    with pytest.raises(RequestError, match="PROJECT_ALREADY"):
        run("init")
    with pytest.raises(RequestError, match="NOT_INDEXED"):
        run("search", "x")
    assert json.loads(run("index"))["files"] == 2
    lines = run("search", "login", "--limit", "2", "--metrics").splitlines()
    assert len(lines) == 3 and "auth.py" in lines[0] and "tokens_saved" in lines[2]
    assert "Preview:" in run("search", "login", "--verbose", "--path", "api")
    answer = json.loads(cli.run(["--project", str(project), "--json", "search", "login", "user", "--level", "method", "--no-rerank"], spark))
    assert answer["rerank_enabled"] is False and {r["level"] for r in answer["results"]} == {"method"}
    assert any(r.get("parent", {}).get("name") == "Auth" for r in answer["results"])
    assert run("subprojects").splitlines()[2].split() == ["api", "api", "go.mod", "go"]
    assert json.loads(run("config", "get", "default_limit")) == 10
    run("config", "set", "default_limit", "4")
    assert json.loads(run("config", "get", "default_limit")) == 4 and run("version").startswith("trawl")
    (project / "late.py").write_text("def late():\n    return 'logout'\n")
    (project / "main.py").unlink()
    assert json.loads(run("update"))["files"] == 2
    e = cli.engine(str(project), spark)
    assert {r.path for r in e.search("late logout").collect()} >= {"late.py"} and e.file("main.py").count() == 0
    assert e.chunks_of("late.py").count() == 2 and e.chunks_by_id([e.chunks_of("late.py").first().chunk_id]).count() == 1
    e.put_subproject("web", "web", "Web")
    assert [r.id for r in e.subprojects().collect()] == ["api", "web"]
    e.delete_subproject("web")
    assert e.subprojects().count() == 1 and e.progress() is None
    with Progress(spark, e.root) as p:
        p.step("embeddings")
        assert e.progress()["percent"] == 25
        with pytest.raises(RequestError, match="IN_PROGRESS"):
            Progress(spark, e.root).__enter__()

    http = server(Service(e))
    threading.Thread(target=http.serve_forever, daemon=True).start()

    def ask(method, path, body=None):
        r = urllib.request.Request(f"http://127.0.0.1:{http.server_port}{path}", body.encode() if body else None, method=method)
        try:
            with urllib.request.urlopen(r, timeout=60) as got:
                return got.status, json.load(got)
        except urllib.error.HTTPError as x:
            return x.code, json.load(x)

    assert ask("GET", "/health")[1]["status"] == "healthy" and ask("GET", "/status")[1]["index"]["total_files"] == 2
    assert ask("POST", "/search", '{"query": "login"}')[1]["results"]
    assert ask("POST", "/search", "{")[0] == 400 and ask("POST", "/search", '{"query": ""}')[1]["code"] == "QUERY_EMPTY"
    assert ask("GET", "/search")[0] == 405 and ask("GET", "/none")[0] == 404
    assert ask("GET", "/config")[1]["config"]["default_limit"] == 4 and ask("GET", "/subprojects")[1]["total"] == 1
    http.shutdown()


def test_provider_change_embeds_anew(spark, project, tmp_path):
    class Named(embedders.MockEmbedder):
        model = "other"

    a = Engine(spark, str(project), str(tmp_path / "i"), embedder=embedders.MockEmbedder(8))
    a.reindex()
    b = Engine(spark, str(project), str(tmp_path / "i"), embedder=Named(8))
    before = b.store.version("vectors")
    b.reindex()
    assert b.store.version("vectors") <= before and b.store.metadata()["embedding_model"] == "other"
