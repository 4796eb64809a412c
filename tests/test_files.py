"""Globs, ignore rules, chunking, subprojects, scans, stores and streams."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from trawl.api import Engine
from trawl.functions import identity, paths, scoring
from trawl.operators import chunking, metrics, scan, store, subprojects
from trawl.sources import embedders, languages
from trawl.streaming import changes

GLOBS = [
    (["internal/**/*.go"], [], ["internal/api/handler.go", "internal/deep/nested/path/file.go", "internal/file.go"], ["external/api/handler.go", "main.go"]),
    (["*.go", "src/*.js"], [], ["main.go", "src/app.js"], ["nested/main.go", "src/nested/app.js"]),
    (["**/*.go"], ["vendor/**"], ["main.go", "pkg/util.go"], ["vendor/lib.go", "vendor/pkg/deep.go"]),
    (["**/*_test.go"], [], ["main_test.go", "pkg/handler_test.go"], ["main.go", "test.go"]),
    (["Makefile", "go.mod"], [], ["Makefile", "go.mod"], ["main.go"]),
    ([], [], [], ["a.go"]),
]


def passing(spark, names, condition):
    df = spark.createDataFrame([(n,) for n in names], "path string")
    return {r.path for r in df.filter(condition(F.col("path"))).collect()}


@pytest.mark.parametrize(("include", "exclude", "yes", "no"), GLOBS)
def test_globs(spark, include, exclude, yes, no):
    assert passing(spark, yes + no, lambda p: paths.included(p, include, exclude)) == set(yes)


def test_ignore_rules(spark):
    rules = paths.ignore_rules(["# no", "", "*.log", "build/", "**/.venv/**", "docs/api", "!keep.log"], ["secret.txt"])
    yes = ["a.log", "x/b.log", "build/x", "x/build/y", "x/.venv/lib/a", "docs/api/x", "secret.txt", ".trawl/state"]
    no = ["keep.log", "a.txt", "building/x", ".venv", "src/main.go"]
    assert passing(spark, yes + no, lambda p: paths.ignored(p, rules)) == set(yes)


def test_scanner_rule_is_different(spark):
    assert passing(spark, ["a/b.go", "b.go", "a/c.js"], lambda p: paths.scanner_included(p, ["**/*.go", "src/**/*.js"])) == {"a/b.go", "b.go"}


def test_prefixes(spark):
    names = ["src/a.go", "src", "srcs/a.go", "SRC/b.go"]
    assert passing(spark, names, lambda p: paths.has_prefix(p, "src/")) == {"src/a.go", "src"}
    assert passing(spark, names, lambda p: paths.like_prefix(p, "s_c/")) == {"src/a.go", "SRC/b.go"}


@pytest.mark.parametrize("name", ["app.min.js", "styles.min.css", "dist/js/vendor.min.js", "app.min.js.map", "APP.MIN.JS"])
def test_minified_names(spark, name):
    assert passing(spark, [name, "app.js", "minimum.js", "admin.js"], lambda p: chunking.is_minified(p, F.lit("a b\n"))) == {name}


@pytest.mark.parametrize(("content", "want"), [("", False), ("x" * 500, False), ("x" * 501, True), ("x y " * 100 + "\n", False), ("ab\n" * 400, False), ("abcdefghijklmnopqrstuvwxyz\n" * 50, True)])
def test_minified_contents(spark, content, want):
    assert spark.range(1).select(chunking.is_minified(F.lit("a.js"), F.lit(content)).alias("m")).first().m is want


@pytest.mark.parametrize(
    ("sizes", "most", "want"),
    [
        ([9] * 200, 1000, [(0, 82), (53, 135), (106, 188), (159, 200), (171, 200)]),
        ([7] * 100, 500, [(0, 34), (34, 68), (68, 100)]),
        ([0] * 5000, 1000, [(0, 5000)]),
        ([1142], 1000, [(0, 1)]),
        ([], 1000, []),
    ],
)
def test_windows(sizes, most, want):
    assert chunking.window_ranges(sizes, most) == want


def test_split_and_truncate(spark):
    rows = [("id", "p", "method", 5, "a\nb\nc"), ("long", "p", "method", 1, "\n".join(["x" * 33] * 200))]
    out = chunking.split_methods(spark.createDataFrame(rows, "chunk_id string, path string, level string, start_line int, content string"), 1000).collect()
    assert (out[0].chunk_id, out[0].parent_chunk_id, out[0].end_line, out[0].is_partial) == ("id", "", 7, False)
    assert all(r.is_partial and r.parent_chunk_id == "long" for r in out[1:]) and len(out) == 6
    text = "é" * 40 + "\n" + "y" * 400
    got = spark.range(1).select(chunking.truncate(F.lit(text), 30).alias("t")).first().t
    assert got == "é" * 40 + chunking.TRUNCATED
    got = spark.range(1).select(chunking.truncate(F.lit("a" + "é" * 100), 30).alias("t")).first().t
    assert got == "a" + "é" * 47 + chunking.TRUNCATED


@pytest.mark.parametrize(("name", "largest"), [("file_chunk_policy", 2000), ("class_chunk_policy", None)])
def test_chunk_policy_covers_all_rows(spark, name, largest):
    """Byte cuts by brute force, within multi-byte text too."""
    import hashlib

    from tests.conftest import TINY
    from trawl.plans import catalogue
    from trawl.sources.corpus import corpus

    def want(text):
        b = text.encode()
        if int(len(b) / 3.5) <= 100:
            return False, hashlib.sha256(b).hexdigest()
        head = b[:320]
        at = head.rfind(b"\n")
        cut = head[:at] if at > 0 else head.decode("utf-8", "ignore").encode()
        return True, hashlib.sha256(cut + b"\n// ... [truncated]").hexdigest()

    rows = [(r.path, r.content) for r in corpus(spark, TINY).select("path", "content").collect()]
    multi = [t for _, t in rows if len(t[:320].encode()) > len(t[:320])]
    assert multi
    expected = sorted((p, *want(t)) for p, t in rows if largest is None or len(t.encode()) <= largest)
    assert sorted(map(tuple, catalogue.QUERIES[name](spark, TINY).collect())) == expected


def test_declarations(spark):
    from trawl.plans.file_queries import SNIPPETS

    rows = chunking.chunk_files(spark.createDataFrame(list(SNIPPETS.items()), "path string, content string")).collect()
    found = {(r.path, r.level, r.name, r.start_line, r.end_line) for r in rows if r.level != "file"}
    assert {("calc.py", "class", "Calculator", 1, 7), ("calc.py", "method", "zero", 6, 7), ("calc.py", "method", "main", 10, 11)} <= found
    assert {("auth.js", "class", "Auth", 1, 8), ("auth.js", "method", "login", 5, 7), ("auth.js", "method", "logout", 9, 11)} <= found
    assert {("cache.go", "class", "Cache", 3, 5), ("cache.go", "method", "New", 7, 9), ("cache.go", "method", "Get", 11, 13)} <= found
    assert {("App.java", "class", "App", 1, 9), ("App.java", "method", "twice", 6, 8)} <= found
    assert {("lib.rs", "class", "Point", 1, 3), ("lib.rs", "method", "x", 6, 8)} <= found
    by_id = {r.chunk_id: r for r in rows}
    assert all(r.parent_id in by_id for r in rows if r.parent_id)
    zero = next(r for r in rows if r.name == "zero")
    assert by_id[zero.parent_id].name == "Calculator" and zero.signature == "def zero():"


DECLARED = {
    "go": ("package x\n\ntype (\n\tA struct {\n\t\tx int\n\t}\n\tB interface {\n\t\tF()\n\t}\n\tC int\n)\n\ntype D struct {\n\ty string // }\n}\n\nfunc (d *D) Get(k string) int {\n\treturn 1\n}\n", "class A 4 6, class B 7 9, class D 13 15, method Get 17 19"),
    "php": ("<?php\nclass Foo extends Bar {\n  public function go($x) { # }\n    if ($x) { return 1; }\n  }\n  abstract function no();\n}\nfunction main() {\n  return 0;\n}\n", "class Foo 2 7, method go 3 5 Foo, method no 6 6 Foo, method main 8 10"),
    "ruby": ("module M\n  class Foo < Bar\n    def go(x)\n      if x\n        1\n      end\n    end\n\n    def self.make?\n      new\n    end\n\n    def sq(x) = x * x\n    def one; 1; end\n  end\nend\n", "class M 1 16, class Foo 2 15, method go 3 7 Foo, method make? 9 11 Foo, method sq 13 13 Foo, method one 14 14 Foo"),
    "lua": ("local M = {}\nfunction M.go(a)\n  if a then\n    return 1\n  end\nend\nlocal function bar()\n  return 2\nend\n", "method M.go 2 6, method bar 7 9"),
    "bash": ("foo() {\n  echo \"${x}\" # }\n}\nfunction bar {\n  if true; then echo; fi\n}\n", "method foo 1 3, method bar 4 6"),
    "c": ("static int *add(int a,\n    int b) {\n  if (a) { return b; }\n  return 0;\n}\nint main(void)\n{\n  return 0;\n}\nstruct S { int x; };\n", "method add(int a,\n    int b) 1 5, method main(void) 6 9"),
    "cpp": ("namespace n {\nclass A {\n public:\n  int get() const { return x; }\n};\nint A::put(int y) {\n  return y;\n}\n}\n", "method get() const 4 4, method A::put(int y) 6 8"),
    "swift": ("public class Foo: Bar {\n  init(x: Int) {\n    self.x = x\n  }\n  func go(\n    a: Int\n  ) -> Int {\n    return 1\n  }\n}\nprotocol P {\n  func q()\n  func r() -> Int\n}\n", "class Foo 1 10, method init 2 4 Foo, method go 5 9 Foo, class P 11 14, method q 12 12 P, method r 13 13 P"),
    "scala": ("object Main extends App {\n  def go(x: Int): Int = {\n    x + 1\n  }\n  def two = 2\n  class In(a: Int)\n}\n", "class Main 1 7, method go 2 4 Main, method two 5 5 Main, class In 6 6"),
    "groovy": ("class A {\n  def go(x) {\n    return x\n  }\n  String s() { 'x}' }\n}\n", "class A 1 6, method go 2 4 A, method s 5 5 A"),
    "rust": ("pub struct P {\n  x: i32,\n}\nimpl<'a> P {\n  pub fn x(&'a self) -> i32 {\n    self.x\n  }\n}\nfn main() {}\n", "class P 1 3, method x 5 7, method main 9 9"),
    "javascript": ("export default class A {\n  async go(x) {\n    if (x) { return `}`; }\n  }\n  get y() { return 1; }\n}\nexport function f(a) {\n  return a;\n}\nfunction long(" + "parameter, " * 400 + "z) {\n  return 2;\n}\nclass B {\n  m(" + "parameter,\n" * 300 + "z) {\n  }\n}\n", "class A 1 6, method go 2 4 A, method y 5 5 A, method f 7 9, method long 10 12, class B 13 316, method m 14 315 B"),
    "typescript": ("export interface I {\n  x: number;\n}\ntype T = { a: string };\nexport class A<T> {\n  go(x: number): string {\n    return '';\n  }\n}\n", "class I 1 3, class T 4 4, class A 5 9, method go 6 8 A"),
    "java": ("@X\npublic class A<T> extends B {\n  public A(int n) {\n    this.n = n;\n  }\n  public <R> List<R> go(Map<K, V> m) throws E {\n    for (int i = 0; i < 1; i++) { }\n    return null;\n  }\n  enum E { A, B }\n}\n", "class A 2 11, method A 3 5 A, method go 6 9 A, class E 10 10"),
    "csharp": ("namespace N {\n  public record struct R(int X);\n  public class A {\n    public int P { get; set; }\n    public A() : base(1) {\n    }\n    public async Task<int> Go(int x) {\n      return 1;\n    }\n  }\n}\n", "class R 2 2, class A 3 10, method P 4 4 A, method A 5 6 A, method Go 7 9 A"),
    "python": ("@dec\nclass A:\n    @x\n    def é(self): return 'é'\n    async def b(self):\n        pass\ntry:\n    def c(): pass\nexcept E:\n    class D: pass\n", "class A 2 6, method é 4 4 A, method b 5 6 A, method c 8 8, class D 10 10"),
}


@pytest.mark.parametrize("language", DECLARED)
def test_declarations_by_language(language):
    text, want = DECLARED[language]
    found = chunking.declarations(text, language)
    line = lambda at: text.count("\n", 0, at) + 1
    got = [f"{x.level} {x.name} {line(x.start)} {line(x.end - 1)}" + (f" {found[x.parent].name}" if x.parent >= 0 else "") for x in found]
    assert ", ".join(got) == want
    assert all(not text[x.start].isspace() and not text[x.end - 1].isspace() for x in found)


@pytest.mark.parametrize("text", ["foo(\n" * 30_000, "foo (bar\n" * 30_000, "a b c d e f g h i j k l m n o p q\n" * 20_000, "{" * 200_000, "x" * 500_000, "/*" * 20_000])
def test_declarations_take_linear_time(text):
    import time

    began = time.process_time()
    for language in ("javascript", "java", "c", "typescript", "swift", "ruby"):
        chunking.declarations(text, language)
    assert time.process_time() - began < 20


def test_broken_source_falls_back_to_its_file():
    assert chunking.declarations("def broken(:\n", "python") == [] and chunking.declarations("x", "cobol") == []


def test_ids(spark):
    import hashlib

    want = hashlib.sha256(b"a.go:method:3:9").hexdigest()[:32]
    assert spark.range(1).select(identity.chunk_id(F.lit("a.go"), F.lit("method"), F.lit(3), F.lit(9)).alias("i")).first().i == want


def test_recency(spark):
    now = datetime.datetime(2024, 1, 31)
    rows = [(n, now - datetime.timedelta(hours=h) if h is not None else None) for n, h in (("a", 1), ("b", 30), ("c", 200), ("d", 1000), ("e", -5), ("f", None))]
    got = spark.createDataFrame(rows, "n string, at timestamp").select(scoring.recency(F.col("at"), F.lit(now)).alias("s")).collect()
    assert [r.s for r in got] == [0.1, 0.05, 0.02, 0, 0, 0]


def test_subprojects(spark):
    names = ["backend/go.mod", "services/api/go.mod", "packages/frontend/package.json", "packages/frontend/x.sln", "node_modules/y/package.json", "go.mod", "a/readme.md"]
    got = {r.path: (r.id, r.marker_file, r.language_hint) for r in subprojects.detect(spark.createDataFrame([(n,) for n in names], "path string")).collect()}
    assert got == {"backend": ("backend", "go.mod", "go"), "services/api": ("api", "go.mod", "go"), "packages/frontend": ("frontend", "x.sln", "csharp")}


def test_scan(spark):
    at = datetime.datetime(2024, 1, 1)
    disk = spark.createDataFrame([("new1", at), ("new2", at), ("same", at), ("touched", at)], "path string, modified_at timestamp")
    index = spark.createDataFrame([("same", at), ("touched", at - datetime.timedelta(hours=1)), ("gone", at)], "path string, modified_at timestamp")
    assert {r.path: r.change for r in scan.scan_diff(disk, index).collect()} == {"new1": "added", "new2": "added", "touched": "modified", "gone": "deleted"}


def test_embedding_reuse(spark):
    chunks = spark.createDataFrame([("a", "h1", "x"), ("b", "h1", "x"), ("c", "h2", "y")], "chunk_id string, content_hash string, content string")
    vectors = spark.createDataFrame([("h2", [1.0])], "content_hash string, embedding array<float>")
    fresh = []

    def embed(rows):
        fresh.append(rows.count())
        return embedders.embed_column(rows, embedders.MockEmbedder(4))

    out, known = store.embed_missing(chunks, vectors, embed)
    assert (out.count(), known.count(), fresh) == (3, 2, [1])
    store.embed_missing(chunks, known, embed)
    assert fresh == [1, 0]


def test_embedders():
    m = embedders.MockEmbedder()
    a, b = m.embed(["x", "x"])
    assert a == b and len(a) == 768 and abs(sum(v * v for v in a) - 1) < 1e-9
    c = embedders.Cached(embedders.MockEmbedder(4), 2)
    c.embed(["a", "b", "a"])
    c.embed(["a"])
    c.embed(["c", "d"])
    assert (c.hits, c.misses) == (1, 5)
    waits, calls = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise embedders.EmbeddingError("busy", True, 7.0 if len(calls) == 1 else None)
        return ["ok"]

    assert embedders.with_retry(flaky, sleep=waits.append) == ["ok"] and waits == [7.0, 2.0]
    with pytest.raises(embedders.EmbeddingError):
        embedders.with_retry(lambda: (_ for _ in ()).throw(embedders.EmbeddingError("no")), sleep=waits.append)


def test_language_configs(tmp_path):
    (tmp_path / "go.yaml").write_text("# c\nlanguage: go\nextensions:\n  - .go\n\ntree_sitter:\n  grammar: go\n\nchunk_mappings:\n  class:\n    - type_spec   # x\n  method:\n    - function_declaration\n\nextraction:\n  name_field: name\n")
    (tmp_path / "bad.yaml").write_text("language: x\n")
    good, bad = languages.load(str(tmp_path))
    assert bad == ["bad.yaml"] and good[0].extensions == (".go",) and good[0].class_nodes == ("type_spec",) and good[0].matches(".GO")
    assert len(languages.builtin()) == 33 and len({c.language for c in languages.builtin()}) == 33


def test_debounce(spark):
    t = datetime.datetime(2024, 1, 1)
    ms = lambda n: t + datetime.timedelta(milliseconds=n)
    rows = [("a", "modify", ms(0)), ("a", "create", ms(300)), ("a", "delete", ms(600)), ("a", "modify", ms(2000)), ("b", "delete", ms(0)), ("b", "create", ms(100))]
    df = spark.createDataFrame(rows, "path string, op string, ts timestamp")
    got = sorted((r.path, r.op, r.n_events) for r in changes.debounce(df).collect())
    assert got == [("a", "create", 3), ("a", "modify", 1), ("b", "delete", 2)]
    assert {(r.path, r.action) for r in changes.plan_changes(changes.debounce(df)).collect()} == {("a", "index"), ("b", "delete")}
    raw = spark.createDataFrame([("CREATE|WRITE",), ("REMOVE",), ("chmod",), ("x",)], "r string")
    assert [r.o for r in raw.select(changes.operation(F.col("r")).alias("o")).collect()] == ["create", "delete", "modify", None]


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("user_id").cast("string").alias("path"), F.lit("modify").alias("op"), F.date_trunc("millisecond", F.col("ts").cast("timestamp")).alias("ts"))
    events.write.json(str(tmp_path / "in"))
    stream = changes.debounce(changes.read_events(spark, str(tmp_path / "in")), "1 hour", "1 hour")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("bursts").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    key = lambda df: sorted((r.path, r.started, r.n_events) for r in df.collect())
    assert key(spark.table("bursts")) == key(changes.debounce(events, "1 hour"))


def test_progress(spark):
    rows = [(i, 10, 1.0) for i in range(1, 13)] + [(13, 5, 0.0)]
    out = metrics.index_progress(spark.createDataFrame(rows, "seq int, chunks int, seconds double"), F.lit(200)).orderBy("seq").collect()
    assert out[0].eta_seconds == 0 and out[1].eta_seconds == 18 and out[12].completed == 125 and out[11].rate == 10


def test_engine_end_to_end(spark, tmp_path):
    from trawl.plans.file_queries import SNIPPETS

    tree = tmp_path / "tree"
    for name, text in SNIPPETS.items():
        (tree / "src").mkdir(parents=True, exist_ok=True)
        (tree / "src" / name).write_text(text)
    (tree / "src" / "go.mod").write_text("module x\n")
    (tree / "empty.py").write_text("")
    e = Engine(spark, str(tree), str(tmp_path / "index"), embedder=embedders.MockEmbedder(16))
    assert e.health() == {"status": "empty"}
    first = e.reindex()
    assert first["files"] == 5 and first["chunks"] == first["embeddings"] > 10 and first["subprojects"] == 1
    top = e.search("user login store", limit=3).collect()
    assert top[0].path == "src/auth.js" and top[0].match_reasons
    assert e.reconcile().count() == 0
    vectors = e.status()["vectors"]
    assert e.reindex() == first and e.status()["vectors"] == vectors
    (tree / "src" / "auth.js").unlink()
    (tree / "src" / "more.py").write_text("def more():\n    return 1\n")
    e.update(e.reconcile())
    seen = {r.path for r in e.store.read("files").collect()}
    assert "src/auth.js" not in seen and "src/more.py" in seen
    folder = tmp_path / "events"
    folder.mkdir()
    (tree / "src" / "late.py").write_text("def late():\n    return 2\n")
    at = "2024-01-01T00:00:00.000Z"
    (folder / "1.json").write_text(json.dumps({"path": "src/late.py", "op": "create", "ts": at}))
    (folder / "2.json").write_text(json.dumps({"path": "x", "op": "modify", "ts": "2024-01-01T01:00:00.000Z"}))
    e.watch(changes.read_events(spark, str(folder), 1), str(tmp_path / "cp"), once=True).awaitTermination(120)
    assert "src/late.py" in {r.path for r in e.store.read("chunks").collect()}
    assert e.savings(e.search("late", limit=2)).first().tokens_saved >= 0
