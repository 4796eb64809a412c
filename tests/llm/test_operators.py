"""The corpus operators against brute force, held-out accuracy and SQL, and on awkward input."""

import collections
import itertools
import random
import re
import uuid

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.conftest import SF, TINY, compare
from trawl.llm import backoff, decontaminate, htmlmain, langid, linededup, minhash, mixing, quality, queries, runs, simhash, toxicity, urlfilter
from trawl.llm import base
from trawl.llm import components as components_
from trawl.llm.base import Scratch
from trawl.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i % 997}" for i in range(30_000))
AWKWARD = [
    (1, None, "en", "a", 0),
    (2, "", None, None, 0),
    (3, " \t\n \x0b", "en", "a", 4),
    (None, "a text without an id that has a dozen words in it all told", "en", None, 1),
    (4, LONG, "en", "a", len(LONG)),
    (5, "same text twice over with a few words more than ten in it", "en", "b", 1),
    (5, "same text twice over with a few words more than ten in it", "en", "b", 1),
    (5, "another text under the same id with a few words more than that", "en", "b", 1),
    (6, "x" * 20_000, "fr", "b", 20_000),
    (7, "12345 !!! ???", "fr", "b", 13),
]


def table(spark, rows, schema=DOCS):
    """Rows with extra columns that clash with the operators' own names."""
    df = spark.createDataFrame(rows, schema)
    return df.withColumns({c: F.lit("clash") for c in ("id", "h", "kept", "score", "weight", "fp", "n_lines", "words", "first")})


@pytest.fixture(scope="module")
def awkward(spark):
    return table(spark, AWKWARD).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return table(spark, [])


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{TINY}/documents.parquet")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, name):
    compare(queries.QUERIES[name](spark, TINY), queries.ORACLES[name], TINY)


# --- 1 -------------------------------------------------------------------------------------


def repeats(words, size=5):
    n = collections.Counter(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    hit = {i + k for i in range(len(words) - size + 1) if n[tuple(words[i : i + size])] > 1 for k in range(size)}
    return len(hit)


def test_quality_counts(spark, awkward):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice("ab#") for _ in range(rng.randint(0, 60))), "en", "s", 0) for i in range(60)]
    out = {r.doc_id: r for r in quality.judge(table(spark, rows), spark).collect()}
    for i, text, *_ in rows:
        w = WORD.findall(text)
        assert (out[i].n_words, out[i].word_chars, out[i].n_repeat_words) == (len(w), sum(map(len, w)), repeats(w))
    got = quality.judge(awkward, spark).collect()
    assert len(got) == len(AWKWARD) and all(r.base_failed and not r.kept for r in got if r.doc_id in (1, 2, 3, 6, 7))


@pytest.mark.parametrize("bound", [100_000, 0])
def test_quality_every_rule_rejects(spark, bound, monkeypatch):
    """Thresholds of each source: what is usual in one is an outlier in the other; every rate rejects by itself."""
    monkeypatch.setattr(quality, "BROADCAST_GROUPS", bound)
    rng, rows = random.Random(4), []
    word = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))

    def text(length=5, symbols=0, twice=0, again=0):
        w = [word(length + rng.randint(-1, 1)) for _ in range(90)] + ["#*$%"[: rng.randint(2, 4)] for _ in range(symbols)]
        lines = [" ".join(w[i : i + 4]) for i in range(0, len(w), 4)]
        # words that come again on other lines, and lines that come again
        lines[1 : 1 + 2 * twice] = [x for line in lines[1 : 1 + 2 * twice] for x in ("same", line)]
        return "\n".join([*lines, " ".join(w[: 6 * again]) + (" end" if again else "")])

    for i in range(300):
        rows.append((i, text(), "en", "plain", 0))
        rows.append((1000 + i, text(length=9, symbols=20 + i % 7, twice=i % 3), "en", "other", 0))
    odd = {2000: text(length=9), 2001: text(symbols=25), 2002: text(twice=4), 2003: text(again=1)}
    rows += [(i, t, "en", "plain", 0) for i, t in odd.items()]
    rows += [(3000 + i, text(length=9, symbols=22, twice=1), "en", "other", 0) for i in range(4)]
    out = {r.doc_id: r for r in quality.judge(table(spark, rows), spark).collect()}
    assert not any(out[i].base_failed for i in out) and not any(out[i].kept for i in odd)
    assert all(out[3000 + i].kept for i in range(4)) and sum(out[i].kept for i in range(300)) > 290 and sum(out[1000 + i].kept for i in range(300)) > 285


def test_quality_empty(spark, empty):
    assert quality.judge(empty, spark).count() == 0


def test_quality_sketches_merge(spark, docs):
    whole = quality.sketch(quality._rates(quality.base_features(docs)))
    parts = [quality.sketch(quality._rates(quality.base_features(docs.filter(f"doc_id % 2 = {k}")))) for k in (0, 1)]
    keys = ["lang", "source", "rate", "bucket"]
    merged = parts[0].union(parts[1]).groupBy(*keys).agg(F.sum("n").alias("n"))
    assert merged.exceptAll(whole.select(*keys, "n")).count() == 0 == whole.select(*keys, "n").exceptAll(merged).count()


# --- 2 and 4: held-out accuracy ------------------------------------------------------------


def test_toxicity_held_out(spark):
    out = queries.op2_toxicity(spark, "/root/testdata/sf0.1").filter("held_out")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    n = {(r.toxic, r.predicted): r["count"] for r in out.join(labels, "doc_id").groupBy("toxic", "predicted").count().collect()}
    assert n[1, 1] / (n[1, 1] + n.get((1, 0), 0)) > 0.8
    assert n.get((0, 1), 0) / (n[0, 0] + n.get((0, 1), 0)) < 0.02


def test_toxicity_awkward(spark, awkward, empty):
    labels = spark.createDataFrame([(5, 1), (4, 0), (None, 1), (6, None)], "doc_id long, toxic int")
    out = toxicity.detect(awkward, labels).collect()
    assert len(out) == len(AWKWARD) and all(0 <= r.score <= 1 for r in out)
    assert toxicity.detect(empty, labels).count() == 0
    none = toxicity.detect(awkward, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.0} and {r.predicted for r in none} == {0}


def test_nnpu_ignores_negative_risk():
    rng = np.random.default_rng(0)
    p = (rng.random((200, 6)) < [0.9, 0.8, 0.1, 0.1, 0.1, 0.1]).astype(np.float32)
    n = (rng.random((800, 6)) < 0.1).astype(np.float32)
    u = np.concatenate([p[:100], n])
    w, b = toxicity.nnpu(p[100:], u, 100 / 900)
    assert (p @ w + b > 0).mean() > 0.6 and (n @ w + b > 0).mean() < 0.05


def test_language_held_out(spark):
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    out = queries.op4_language_id(spark, SF).filter("held_out").join(truth, "doc_id")
    assert out.filter("lang = lang_pred").count() / out.count() > 0.97


def test_language_awkward(spark, awkward, empty):
    out = langid.identify(awkward).collect()
    assert len(out) == len(AWKWARD)
    assert all(r.lang_pred == "und" and r.score == 0.0 for r in out if r.doc_id in (1, 2, 3, 7))
    assert langid.identify(empty).count() == 0
    assert {r.lang_pred for r in langid.identify(awkward.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_toxicity_scores_by_brute_force(spark):
    """Scores of given weights: the bias and each distinct word's weight once, over whole texts."""
    import math

    rng = np.random.default_rng(3)
    texts = ["Bad bad WORD, word2 été", "x" * 50 + " word " * 5000, "12 !!", "", None, "ein wort und noch ein wort"]
    words = sorted({w for t in texts for w in re.findall(r"[^\W\d_]+", (t or "").lower())})
    weight = dict(zip(words, rng.normal(size=len(words)), strict=True))
    table_ = np.zeros(1 << toxicity.BITS, np.float32)
    for w, v in weight.items():
        (h,) = toxicity.features(w)
        table_[h] = v
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    got = {r.doc_id: r for r in toxicity.score(docs, {"prior": 0.1, "weights": table_, "bias": -0.3}).collect()}
    for i, t in enumerate(texts):
        z = -0.3 + sum(np.float64(np.float32(weight[w])) for w in set(re.findall(r"[^\W\d_]+", (t or "").lower())))
        assert abs(got[i].score - 1 / (1 + math.exp(-z))) < 1e-6 and got[i].predicted == (got[i].score >= 0.5)


def test_network_by_brute_force():
    """Filters of every width at every position, their maxima, softmax, and the mean over windows."""
    import math

    model = {k: v for k, v in langid._start(3).items() if k != "mask"}
    text = "Ein kurzer Satz é " * 30
    raw = langid.to_bytes(text)
    stride, total, n = langid.WINDOW - (langid.WIDEST - 1), np.zeros(3), 0
    while n == 0 or n * stride < len(raw) - (langid.WIDEST - 1):
        window = raw[n * stride : n * stride + langid.WINDOW].ljust(langid.WINDOW, b"\0")
        h = np.full(model["conv"].shape[1], -np.inf)
        for at in range(langid.WINDOW - langid.WIDEST + 1):
            x = np.concatenate([model["embed"][b] for b in window[at : at + langid.WIDEST]])
            h = np.maximum(h, x @ model["conv"])
        z = np.maximum(h + model["bias"], 0) @ model["out"] + model["out_bias"]
        total += z - math.log(sum(math.exp(v) for v in z))
        n += 1
    p = np.exp(total / n)
    assert np.allclose(langid.predict(model, [text])[0], p / p.sum(), atol=1e-4)


def test_samples_are_bounded(spark, monkeypatch):
    """However the ids fall: one id for all rows, and more rows than the bound."""
    monkeypatch.setattr(toxicity, "POSITIVES", 5)
    monkeypatch.setattr(toxicity, "UNLABELLED", 10)
    texts = spark.createDataFrame([(1, f"text number {i} of them") for i in range(500)], "doc_id long, text string").withColumn("th", F.xxhash64("text"))
    assert len(toxicity._sample(texts, 10)) == 10
    monkeypatch.setattr(langid, "PER_LANGUAGE", 5)
    monkeypatch.setattr(langid, "MOST_LANGUAGES", 2)
    rows = [(i, "ein text auf deutsch oder so", ("de", "en", "fr")[i % 7 % 3]) for i in range(400)]
    langs, model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert langs == ["de", "en"] and model["out"].shape[1] == 2


def test_windows_cover_the_text():
    for n in (0, 1, 5, 255, 256, 257, 509, 5000):
        raw = bytes(i % 250 + 1 for i in range(n))
        x = langid.windows(raw)
        assert bytes(x[0][: min(n, langid.WINDOW)]) == raw[: langid.WINDOW]
        stride = langid.WINDOW - (langid.WIDEST - 1)
        joined = b"".join(bytes(w[:stride]) for w in x[:-1]) + bytes(x[-1])
        assert joined[:n] == raw and not any(joined[n:])


# --- 3 -------------------------------------------------------------------------------------


def plain_backoff(texts):
    import math

    words = [[w.decode() for w in (t or "").encode().lower().split()] for t in texts]
    one = collections.Counter(itertools.chain.from_iterable(words))
    two = collections.Counter(p for w in words for p in itertools.pairwise(w))
    n = sum(one.values())

    def score(w):
        s = 0.0
        for i, x in enumerate(w):
            c = two[w[i - 1], x] if i else 0
            s += math.log(c / one[w[i - 1]] if c >= 2 else one[x] / n * (0.4 if i else 1))
        return s

    return [score(w) for w in words]


def test_backoff(spark, awkward, empty, monkeypatch):
    monkeypatch.setattr(backoff, "BUCKET", 3000)
    monkeypatch.setattr(backoff, "CHUNK", 2000)
    out = sorted((r.n_words, round(r.score, 6)) for r in backoff.score(awkward, spark).collect())
    want = plain_backoff([r[1] for r in AWKWARD])
    assert out == sorted((len(WORD.findall(r[1] or "")), round(s, 6)) for r, s in zip(AWKWARD, want, strict=True))
    assert backoff.score(empty, spark).count() == 0


@pytest.mark.parametrize("share", [0.002, 0.5, 2.0])
def test_backoff_does_not_depend_on_what_is_frequent(spark, docs, share, monkeypatch):
    monkeypatch.setattr(backoff, "HOT_SHARE", share)
    monkeypatch.setattr(backoff, "BUCKET", 20_000)
    rows = {r.doc_id: r.score for r in backoff.score(docs, spark).collect()}
    texts = docs.collect()
    assert all(abs(rows[r.doc_id] - s) < 1e-6 for r, s in zip(texts, plain_backoff([r.text for r in texts]), strict=True))


# --- 5 -------------------------------------------------------------------------------------


@pytest.mark.parametrize("bound", [mixing.DRIVER_CELLS, 0])
def test_mixing_meets_margins(spark, docs, bound, monkeypatch):
    """At the driver and as sums and joins of tables."""
    monkeypatch.setattr(mixing, "DRIVER_CELLS", bound)
    if not bound:
        monkeypatch.setattr(mixing, "TOLERANCE", 1e-4)
    out = mixing.mix(docs, spark)
    cells = out.groupBy("source", "lang", "topic").agg(F.sum("n_tokens").alias("t"), F.max("weight").alias("w")).toPandas().fillna("-")
    cells["f"] = cells.t * cells.w
    total = cells.t.sum()
    for m, power in mixing.TEMPER.items():
        actual = cells.groupby(m).t.sum() ** power
        assert np.allclose(cells.groupby(m).f.sum() / total, actual / actual.sum(), rtol=1e-6 if bound else 1e-3)
    expected = out.agg(F.sum(F.col("n_tokens") * F.col("probability"))).first()[0]
    assert abs(expected / total - mixing.BUDGET) < 1e-9


@pytest.mark.parametrize("bound", [mixing.DRIVER_CELLS, 0])
def test_mixing_targets(spark, bound, monkeypatch):
    """Given targets and a topic of the caller's; a value without a target vanishes, impossible targets are an error."""
    monkeypatch.setattr(mixing, "DRIVER_CELLS", bound)
    rows = [(i, "one two three four " * (1 + i % 5), ("en", "fr", None)[i % 3], "abc"[i // 3 % 3], 0) for i in range(180)]
    docs = spark.createDataFrame(rows, DOCS)
    share = lambda **k: spark.createDataFrame(list(k.items()), "value string, share double")
    topic = F.when(F.col("n_chars") > 0, "x").otherwise("y")
    out = mixing.mix(docs, spark, {"source": share(a=3.0, b=1.0, unknown=9.0), "lang": share(en=0.5, fr=0.5)}, topic).toPandas()
    f = (out.n_tokens * out.weight).groupby(out.source).sum() / out.n_tokens.sum()
    assert np.allclose(f, [0.75, 0.25, 0]) and set(out.topic) == {"y"} and not out.kept[out.lang.isna()].any()
    crossed = spark.createDataFrame([(1, "w w", "en", "a", 0), (2, "w w", "fr", "b", 0)], DOCS)
    monkeypatch.setattr(mixing, "MOST_ROUNDS", 5)
    with pytest.raises(mixing.NoFit):
        mixing.mix(crossed, spark, {"source": share(a=0.9, b=0.1), "lang": share(en=0.1, fr=0.9)}).count()


def test_mixing_awkward(spark, awkward, empty):
    out = mixing.mix(awkward, spark).collect()
    assert len(out) == len(AWKWARD) and not any(r.kept for r in out if r.n_tokens == 0)
    assert mixing.mix(empty, spark).count() == 0


# --- 6 -------------------------------------------------------------------------------------


def test_clashing_names(spark, awkward):
    """Columns named like any that operators add for themselves."""
    names = [f"{'_' * k}{n}" for n in ("weight", "source", "gone", "text", "doc", "th", "letter", "judged", "lang", "topic", "odds", "d", "t", "at", "key", "line") for k in (1, 2)]
    docs = awkward.withColumns({n: F.lit("x") for n in [*names, "gone", "TOPIC", "N_lines", "Kept"]} | {"TOPIC": F.lit("x")})
    for out in (mixing.mix(docs, spark), linededup.dedup_lines(docs, spark), langid.identify(docs)):
        assert set(names) <= set(out.columns) and out.count() == len(AWKWARD) and {r["_weight"] for r in out.collect()} == {"x"}
    bench = spark.createDataFrame([(1, "a benchmark item of several words that nobody else holds")], "item_id long, text string")
    assert set(names) <= set(decontaminate.clean(docs, bench, spark).columns) & set(simhash.keep_one(docs, spark).columns)


def test_urls(spark):
    rules = spark.createDataFrame([("com", "/", "allow"), ("a.com", "/p", "block"), ("a.com", "/p/q/", "allow"), ("b.org", "", "block"), ("x.b.org", "", "allow")], "host string, path string, verdict string")
    want = {
        "http://A.com/page": "block", "http://w.a.com/p/q/r?x": "allow", "http://a.com/p/q": "block", "http://ba.com/p": "allow", "http://c.com": None,
        "https://b.org": "block", "https://y.x.b.org/z": "allow", "no-scheme.com/x": None, "": None, None: None, "http://" + "l." * 500 + "com/" + "d/" * 500: "allow", "http://net/#/x": None,
    }
    rows = [(i, u, "x") for i, u in enumerate(want)] * 2 + [(None, "http://a.com/p", "x")]
    out = urlfilter.filter_urls(spark.createDataFrame(rows, "page_id long, url string, host string"), rules, "none").collect()
    assert len(out) == len(rows)
    urls = list(want)
    assert all(r.verdict == (want[urls[r.page_id]] or "none") for r in out if r.page_id is not None)
    assert urlfilter.filter_urls(spark.createDataFrame([], "page_id long, url string"), rules).count() == 0
    assert urlfilter.filter_urls(spark.createDataFrame(rows, "page_id long, url string, host string"), rules.limit(0)).filter("rule is not null").count() == 0


# --- 7 -------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def model():
    return htmlmain.train()


LOREM = "Lorem ipsum dolor sit amet consectetur adipiscing elit sed do. " * 4
PROSE = LOREM.strip()
LAYOUTS = [
    ("<html><body><div class='container'><div class='row'><div class='col-md-8'><h1>A title here</h1><p>{p}</p><p>{p}</p></div><div class='col-md-4'><ul><li><a href=/a>One</a></li><li><a href=/b>Two</a></li><li><a href=/c>Three</a></li></ul></div></div></div></body></html>", "A title here\n{p}\n{p}"),
    ("Some <b>text</b> here that is long enough to be an article of its own.", "Some text here that is long enough to be an article of its own."),
    ("<body><nav><a href=/>Home</a></nav><main><h1>Prices</h1><p>{p}</p><table><tr><th>Item</th><th>Price</th></tr><tr><td>Bread</td><td>2</td></tr></table><p>{p}</p></main><footer>c</footer></body>", "Prices\n{p}\nItem\nPrice\nBread\n2\n{p}"),
    ("<body><div id='zx81'><h2>About it</h2><figure><img src=x><figcaption>A picture of it.</figcaption></figure><p>{p}</p><p>{p}</p></div><div id='q2'><a href=1>x</a> <a href=2>y</a> <a href=3>z</a></div></body>", "About it\nA picture of it.\n{p}\n{p}"),
    ("<body><header>My site</header><article><h1>Steps</h1><p>{p}</p><ol><li>Take it out of the box.</li><li>Plug it in and wait a minute.</li></ol></article><aside><h3>More</h3><ul><li><a href=1>a</a></li><li><a href=2>b</a></li></ul></aside></body>", "Steps\n{p}\nTake it out of the box.\nPlug it in and wait a minute."),
    ("<body><div class='hd'><a href=1>Home</a><a href=2>Shop</a></div><div class='bd'><div class='t7'><h1>News today</h1><p>{p}</p><p>{p}</p></div></div><div class='ft'>Copyright 2020 Someone</div></body>", "News today\n{p}\n{p}"),
    ("<body><article><p title='a>b' don't>{p}</p><p>Two words</p></article>", "{p}\nTwo words"),
    *((f"<body><article><h1>A title</h1><p>{{p}}</p></article><a href='{'x' * n}", "A title\n{p}") for n in (1_000, 3_000, 300_000)),
]


@pytest.mark.parametrize(("html", "text"), LAYOUTS)
def test_html_layouts_by_hand(model, html, text):
    assert htmlmain.main_texts(model, [html.replace("{p}", PROSE)]) == [text.replace("{p}", PROSE)]


@pytest.mark.parametrize("html", ["<a " * 100_000 + "<p>x", "<p title=\"" * 50_000, "<" * 300_000, "<!--" * 80_000, "<div>" * 5_000 + "</p>" * 80_000 + "x", "<p a='" * 50_000 + ">x", "<script>" * 40_000])
def test_html_takes_linear_time(model, html):
    import time

    began = time.process_time()
    htmlmain.main_texts(model, [html])
    assert time.process_time() - began < 6


PAGES = [
    ("<html><body><nav><a href=/>Home</a></nav><article><h1>T &amp; U</h1><p>One  two\n three<p>Four <b>five</b>.</article><footer>(c)</footer></body></html>", "T & U\nOne two three\nFour five."),
    (None, ""),
    ("", ""),
    ("<body><script>var x='<p>no</p>';</script><style>p{}</style></body>", ""),
    ("<body><div class='ad'>buy</div><article><p>Long enough text of an article that goes on for a while.</p><p>And more &eacute; &#65;.", "Long enough text of an article that goes on for a while.\nAnd more é A."),
]


@pytest.mark.parametrize(("html", "text"), PAGES)
def test_html(model, html, text):
    assert htmlmain.main_texts(model, [html]) == [text]


def test_html_layouts(model):
    rng, wrong = random.Random(77), 0
    for _ in range(150):
        page, y = htmlmain.labelled(htmlmain.layout(rng))
        got = htmlmain.decode(page.parent, htmlmain.log_odds(model, htmlmain.node_features(page)))
        wrong += page.text(got) != page.text(y)
    assert wrong <= 9


def test_decoding_is_the_best_consistent_labelling():
    rng = np.random.default_rng(3)
    for _ in range(40):
        n = 6
        parent = [-1] + [int(rng.integers(0, i)) for i in range(1, n)]
        logp = rng.normal(size=(n, 3))

        def fine(y, parent=parent):
            below = {0: (0, 1, 2), 1: (1, 2), 2: (2,)}
            return all(y[i] in below[y[parent[i]]] for i in range(1, len(y)))

        best = max((y for y in itertools.product(range(3), repeat=n) if y[0] == 0 and fine(y)), key=lambda y: sum(logp[i][k] for i, k in enumerate(y)))
        assert tuple(htmlmain.decode(parent, logp.copy())) == best


def test_html_query(spark):
    import html as h

    def want(s):
        body = re.sub(r"</?(?:b|br)>", lambda k: " " if "br" in k[0] else "", re.search(r"<article>(.*?)</article>", s, re.S)[1])
        return "\n".join(x for x in (" ".join(h.unescape(b).split()) for b in re.split(r"</?(?:p|h1)>", body)) if x)

    source = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in queries.op7_html_extraction(spark, SF).collect():
        assert r.text == want(source[r.page_id]) and r.n_chars == len(r.text)
    deep = "<div>" * 5000 + "deep" + "</div>" * 5000
    rows = [(1, "u", deep), (None, None, None), (1, "u", deep)]
    assert htmlmain.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).count() == 3


# --- 8 -------------------------------------------------------------------------------------


def windows_like(text, item):
    clean = lambda t: WORD.findall("".join(c for c in t.lower() if c.isalnum() or WORD.sub("", c)))
    w, v = clean(text or ""), clean(item)
    size = min(5, len(v))
    sh = lambda x: [tuple(x[i : i + size]) for i in range(len(x) - size + 1)]
    target, best = collections.Counter(sh(v)), 0.0
    for a in range(max(1, len(w) - len(v) + 1)):
        c = collections.Counter(sh(w[a : a + len(v)]))
        shared = sum((c & target).values())
        best = max(best, shared / (sum(c.values()) + sum(target.values()) - shared)) if target else 0.0
    return best


def test_decontamination(spark, empty):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(4))
    items = [(i, " ".join(word() for _ in range(rng.choice((3, 5, 12, 30, 55))))) for i in range(25)] + [(90, None), (91, ""), (7, "again again again again again again again again")]
    docs = []
    for i in range(150):
        w = [word() for _ in range(rng.randint(0, 80))]
        if i % 2:
            passage = rng.choice(items[:25])[1].upper().split()
            for _ in range(rng.choice((0, 0, 1, 1, 2))):
                k = rng.randrange(len(passage))
                passage[k : k + 1] = rng.choice(([], [word()], [passage[k], word()]))
            at = rng.randint(0, len(w))
            w[at:at] = [x + rng.choice(("", ",", "!")) for x in passage]
        docs.append((1000 + i, " ".join(w), "en", "s", 0))
    docs += [(500, "again " * 9, "en", "s", 0), *AWKWARD]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.matches(table(spark, docs), bench, spark).collect()}
    want = {(d[0], i): s for d in docs for i, t in items if t and (s := windows_like(d[1], t)) >= 0.8}
    assert set(got) == set(want) and (500, 7) in got
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)
    kept = decontaminate.clean(table(spark, docs), bench, spark)
    assert kept.count() == len(docs) - sum(any((d[0], i) in want for i, _ in items) for d in docs)
    assert decontaminate.matches(empty, bench, spark).count() == 0
    assert decontaminate.matches(table(spark, docs), bench.limit(0), spark).count() == 0


def test_decontamination_by_every_window(spark):
    """The best window lies between the alignments of single shingles; texts shorter than their item."""
    items, docs, rng = [], [], random.Random(8)
    for i, (n, ends, middle) in enumerate(((60, 1, 2), (99, 3, 6), (120, 4, 8))):
        v = [f"i{i}w{k}" for k in range(n)]
        w = ["x"] * ends + v[ends : n // 2] + ["y"] * middle + v[n // 2 : n - ends] + ["z"] * ends
        items.append((i, " ".join(v)))
        docs.append((i, " ".join([*(f"a{k}" for k in range(40)), *w, *(f"b{k}" for k in range(40))]), "en", "s", 0))
    for i in range(10, 30):
        v = [f"i{i}w{k}" for k in range(54)]
        items.append((i, " ".join(v)))
        docs.append((i, " ".join(v[(a := rng.randint(0, 10)) : a + 44]), "en", "s", 0))
    # every shingle but the text's is rarer than it: six items share the text
    same = [f"s{k}" for k in range(44)]
    for i in range(40, 46):
        items.append((i, " ".join([f"i{i}w{k}" for k in range(5)] + same + [f"i{i}v{k}" for k in range(5)])))
    docs.append((40, " ".join(same), "en", "s", 0))
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.matches(table(spark, docs), spark.createDataFrame(items, "item_id long, text string"), spark).collect()}
    want = {(d[0], i): s for d in docs for i, t in items if (s := windows_like(d[1], t)) >= 0.8}
    assert set(got) == set(want) and {(0, 0), (1, 1), (2, 2), (40, 40)} <= set(want)
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_native_simhash(spark):
    rng = random.Random(2)
    rows = [(i, [rng.getrandbits(64) - (1 << 63) for _ in range(n)]) for i, n in enumerate((1, 2, 3, 30, 31, 200))]
    got = {r.i: r.s for r in spark.createDataFrame(rows, "i int, h array<long>").select("i", decontaminate.simhash(F.col("h")).alias("s")).collect()}
    for i, h in rows:
        bits = [sum((x >> b) & 1 for x in h) * 2 > len(h) for b in range(64)]
        assert got[i] & ((1 << 64) - 1) == sum(1 << b for b in range(64) if bits[b])


def test_blocks_find_all_within_radius(spark):
    rng = random.Random(4)
    pairs = []
    for r in range(25):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), r):
            y ^= 1 << b
        pairs.append((simhash._signed(x), simhash._signed(y)))
    shares = F.arrays_overlap(decontaminate.blocks(F.col("x"), 24), decontaminate.blocks(F.col("y"), 24))
    assert spark.createDataFrame(pairs, "x long, y long").filter(~shares).count() == 0


# --- 9 -------------------------------------------------------------------------------------


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    sh = [b" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum((x >> b) & 1 for x in h) > len(h))


def groups(ids, linked):
    par = {i: i for i in ids}

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    for a, b in linked:
        x, y = find(a), find(b)
        par[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash_query(spark, docs):
    rows = docs.collect()
    fp = {r.doc_id: plain_fingerprint(r.text) for r in rows}
    want = groups(fp, [(a, b) for a, b in itertools.combinations(fp, 2) if (fp[a] ^ fp[b]).bit_count() <= 4])
    got = queries.op9_simhash_near_dedup(spark, TINY).collect()
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {(i, f"{fp[i]:016x}", want[i]) for i in fp}


@pytest.mark.parametrize("tile", [20_000, 7])
def test_simhash_links_all(spark, tile, monkeypatch):
    """Dense balls, chains and strangers; small tiles split the cells."""
    monkeypatch.setattr(simhash, "TILE", tile)
    rng = random.Random(9)
    fps = {0, (1 << 64) - 1}
    for _ in range(4):
        x = rng.getrandbits(64)
        for _ in range(40):
            fps.add(x ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))))
        for _ in range(25):
            x ^= sum(1 << b for b in rng.sample(range(64), 4))
            fps.add(x)
    fps = sorted({simhash._signed(x) for x in fps | {rng.getrandbits(64) for _ in range(60)}})
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    want = groups(fps, [(a, b) for a, b in itertools.combinations(fps, 2) if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 4])
    links = [(r.a, r.b) for r in simhash.near_links(df, len(fps)).collect()]
    assert groups(fps, links) == want
    roots = {r.node: r.root for r in components(simhash.near_links(df, len(fps)), Scratch(spark)).collect()}
    assert {x: roots.get(x, x) for x in fps} == want


def test_manhattan_bound():
    rng = np.random.default_rng(5)
    x, y = (rng.integers(0, 1 << 63, 500, dtype=np.uint64) for _ in range(2))
    count = lambda v: np.array([[(int(a) >> (2 * s) & 3).bit_count() for s in range(32)] for a in v])
    distance = np.abs(count(x) - count(y)).sum(axis=1)
    assert (np.bitwise_count(simhash.embedding(x) ^ simhash.embedding(y)) == distance).all() and (distance <= np.bitwise_count(x ^ y)).all()


def test_simhash_awkward(spark, awkward, empty):
    out = simhash.near_duplicates(awkward, spark).collect()
    assert len(out) == len(AWKWARD)
    assert {r.component_id for r in out if r.fp == 0} == {1}
    assert simhash.near_duplicates(empty, spark).count() == 0 == simhash.keep_one(empty, spark).count()
    kept = simhash.keep_one(awkward, spark).collect()
    assert len(kept) == len({(r.component_id, r.fp if r.component_id is None else 0) for r in out})


# --- 10 ------------------------------------------------------------------------------------


def line_fixture(seed=6):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    base = [[word() for _ in range(rng.choice((1, 3, 9, 20, 45)))] for _ in range(25)]
    rows = []
    for i in range(160):
        lines = []
        for _ in range(rng.randint(0, 6)):
            w = list(rng.choice(base))
            for _ in range(rng.choice((0, 0, 0, 1, 1, 2, 5))):
                w[rng.randrange(len(w))] = word()
            lines.append(rng.choice(("", " ")) + " ".join(w))
        rows.append((i, "\n".join([*lines, ""][: rng.randint(1, 8)]), "en", "s", 0))
    return rows


def character_runs(line):
    return {line} if len(line) < 10 else {line[i : i + 10] for i in range(len(line) - 9)}


@pytest.mark.parametrize("all_pairs", [16, 2])
def test_lines_by_characters(spark, all_pairs, monkeypatch):
    """All lines are compared by the characters at every position, whatever their words."""
    monkeypatch.setattr(linededup, "ALL_PAIRS", all_pairs)
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    phrases = " ".join(word(30) for _ in range(8))
    plain = " ".join(word(12) for _ in range(20))
    close = [(phrases, phrases[:100] + "X" + phrases[101:]), (plain, plain.replace(" ", "\t", 1)), (word(300), None)]
    close[2] = (close[2][0], close[2][0][:150] + "X" + close[2][0][151:])
    rows = [(1000 + 2 * i + k, x, "en", "s", 0) for i, pair in enumerate(close) for k, x in enumerate(pair)] + line_fixture()
    out = linededup.dedup_lines(table(spark, rows), spark).collect()
    lines = sorted({x for r in rows for x in r[1].split("\n") if x.strip()})
    runs = {x: character_runs(x) for x in lines}
    want = groups(lines, [(a, b) for a, b in itertools.combinations(lines, 2) if 5 * len(runs[a] & runs[b]) >= 4 * len(runs[a] | runs[b])])
    kept = collections.Counter(want[x] for r in out for x in r.text.split("\n") if x.strip())
    assert all(want[a] == want[b] for a, b in close)
    assert set(kept) == set(want.values()) and set(kept.values()) == {1}
    first = {}
    for r in rows:
        for x in r[1].split("\n"):
            if x.strip():
                first.setdefault(want[x], r[0])
    assert all(first[want[x]] == r.doc_id for r in out for x in r.text.split("\n") if x.strip())
    assert all(r.n_lines == sum(bool(x.strip()) for x in t[1].split("\n")) for r in out for t in rows if t[0] == r.doc_id)


def test_line_recall(spark):
    """Pairs of 20-word lines with two one-character edits."""
    rng, rows, similar = random.Random(12), [], 0
    for i in range(600):
        a = " ".join("".join(rng.choice("abcdefghijklm") for _ in range(9)) for _ in range(20))
        b = list(a)
        for k in rng.sample(range(len(a)), 2):
            b[k] = "X"
        x, y = character_runs(a), character_runs("".join(b))
        if 5 * len(x & y) >= 4 * len(x | y):
            similar += 1
            rows += [(2 * i, a, "en", "s", 0), (2 * i + 1, "".join(b), "en", "s", 0)]
    out = linededup.dedup_lines(spark.createDataFrame(rows, DOCS), spark)
    assert out.filter("n_kept = 0").count() >= 0.99 * similar and similar > 300


@pytest.mark.parametrize("bands", [minhash.COARSE, minhash.FINE])
def test_band_recall(bands):
    """Pairs of similarity 0.8 to 0.85."""
    rng, xs, ys = random.Random(2), [], []
    while len(xs) < 1000:
        x = "".join(rng.choice("abcdefghijklm ") for _ in range(rng.randint(100, 400)))
        y = list(x)
        for k in rng.sample(range(len(x)), max(1, len(x) // 90)):
            y[k] = "X"
        a, b = character_runs(x), character_runs("".join(y))
        if 0.8 <= len(a & b) / len(a | b) < 0.85:
            xs.append(x)
            ys.append("".join(y))
    (kx, rx), (ky, ry) = (minhash.signatures(t, linededup.CHARACTERS, bands) for t in (xs, ys))
    assert sum(bool(set(a[~p]) & set(b[~q])) for a, p, b, q in zip(kx, rx, ky, ry, strict=True)) >= 990


@pytest.mark.parametrize("piece", [1 << 20, 64])
def test_overlaps_and_signatures(piece, monkeypatch):
    """Long texts are handled in pieces: sets and keys are the same."""
    rng = random.Random(1)
    xs = ["".join(rng.choice("abcdefg hi\u00e9") for _ in range(rng.choice((0, 1, 5, 9, 10, 11, 30, 300, 900)))) for _ in range(200)]
    ys = [x[: len(x) // 2] + rng.choice(("", "X", "XY")) + x[len(x) // 2 :] for x in xs]
    once = [minhash.signatures(xs, linededup.CHARACTERS, b) for b in (minhash.COARSE, minhash.FINE)]
    monkeypatch.setattr(minhash, "PIECE", piece)
    monkeypatch.setattr(minhash, "ELEMENTS", min(piece, 1 << 16))
    for (keys, repeat), b in zip(once, (minhash.COARSE, minhash.FINE), strict=True):
        again = minhash.signatures(xs, linededup.CHARACTERS, b)
        assert (keys == again[0]).all() and (repeat == again[1]).all()
    shared, union = minhash.overlaps(xs, ys, linededup.CHARACTERS)
    for x, y, n, m in zip(xs, ys, shared, union, strict=True):
        a, b = (character_runs(t) if t else set() for t in (x, y))
        assert (n, m) == (len(a & b), len(a | b))


def test_lines_without_python(spark, monkeypatch):
    """No plan of line dedup, prefix filtering included, runs Python on the executors."""
    plans, save = [], linededup.Scratch.save

    def noted(self, df, name, options=None):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return save(self, df, name, options)

    monkeypatch.setattr(linededup.Scratch, "save", noted)
    monkeypatch.setattr(linededup, "ALL_PAIRS", 2)
    out = linededup.dedup_lines(table(spark, line_fixture()), spark)
    plans.append(("out", out._jdf.queryExecution().executedPlan().toString()))
    assert {"lines", "links", "dropped", "out"} <= {name for name, _ in plans}
    assert not [name for name, plan in plans if re.search("InArrow|InPandas|Python|ArrowEval", plan)]


@pytest.mark.parametrize("long", [1 << 16, 20])
def test_runs(spark, long, monkeypatch):
    """Lines in pieces, compared by arrays or by exploded digests: as by brute force."""
    monkeypatch.setattr(runs, "PIECE", 7)
    monkeypatch.setattr(runs, "LONG", long)
    rng = random.Random(4)
    xs = ["".join(rng.choice("ab \u00e9\U0001f600") for _ in range(rng.choice((0, 1, 9, 10, 11, 17, 60, 200)))) for _ in range(150)]
    ys = [x[: len(x) // 2] + rng.choice(("", "", "X", "XY")) + x[len(x) // 2 :] for x in xs]
    both = spark.createDataFrame([(i, -i, x, y) for i, (x, y) in enumerate(zip(xs, ys, strict=True))], "a long, b long, x string, y string")
    sets = [(character_runs(x), character_runs(y)) for x, y in zip(xs, ys, strict=True)]
    want = {(i, -i) for i, (x, y) in enumerate(sets) if 5 * len(x & y) >= 4 * len(x | y)}
    assert {(r.a, r.b) for r in linededup.RUNS.similar(both).collect()} == want
    found = linededup.RUNS.shingles(both.select("a", F.col("x").alias("line")), "a").groupBy("a").count().collect()
    assert {r.a: r["count"] for r in found} == {i: len(x) for i, (x, _) in enumerate(sets)}


@pytest.mark.parametrize("bands", [runs.COARSE, runs.FINE])
@pytest.mark.parametrize("least, most", [(30, 100), (100, 400)])
def test_key_recall(spark, bands, least, most):
    """Pairs of similarity 0.8 to 0.85 share a key, short ones too."""
    rng, rows, n = random.Random(2), [], 0
    while n < 2000:
        x = "".join(rng.choice("abcdefghijklm ") for _ in range(rng.randint(least, most)))
        y = list(x)
        for k in {0} if least < 100 else rng.sample(range(len(x)), max(1, len(x) // 90)):
            y[k if least >= 100 else rng.randrange(-3, 3)] = "X"
        a, b = character_runs(x), character_runs("".join(y))
        if 0.8 <= len(a & b) / len(a | b) < 0.85:
            rows += [(n, 0, x), (n, 1, "".join(y))]
            n += 1
    lines = spark.createDataFrame(rows, "d1 long, d2 long, line string").select(F.struct("d1", "d2").alias("id"), F.lit(1).cast("long").alias("n"), "line")
    keyed = linededup.RUNS.keyed(lines, bands, Scratch(spark), "keys")
    keys = keyed.select("id.*", F.explode(F.array(*[f"k{i}" for i in range(bands[0])])).alias("key")).filter("key is not null").distinct()
    met = keys.groupBy("d1", "key").count().filter("count = 2").select("d1").distinct().count()
    assert met >= 0.99 * n, met


@pytest.mark.parametrize("long", [False, True])
def test_lines_are_not_written(spark, long, monkeypatch):
    """Of the lines only those that meet others are written, and none of the others is exchanged."""
    saved, save = {}, linededup.Scratch.save

    def noted(self, df, name, options=None):
        out = save(self, df, name, options)
        saved[name] = out.filter("line is not null").count() if "line" in out.columns else 0
        return out

    monkeypatch.setattr(linededup.Scratch, "save", noted)
    rng = random.Random(7)
    rows = [(i, "\n".join(rng.randbytes(40).hex() * (1 + 3 * long) for _ in range(20)), "en", "s", 0) for i in range(20)]
    rows += [(20, rows[0][1].split("\n")[0] + "\n" + rows[1][1].split("\n")[0][:-1] + "X", "en", "s", 0)]
    out = {r.doc_id: r for r in linededup.dedup_lines(table(spark, rows), spark).collect()}
    assert (out[20].n_lines, out[20].n_kept) == (2, 0) and sum(r.n_kept for r in out.values()) == 400
    assert saved["lines"] <= 4 and max(saved.values()) <= 4


def test_similar_runs_its_joins_once(spark):
    """Where no line is long, pairs are compared in one pass over what was joined; where one may be, in two."""
    both = spark.createDataFrame([(1, 2, "a" * 30 + "b" * 30, "a" * 30 + "b" * 29), (3, 4, "abcdefghijk", "zyxwvutsrqp")], "a long, b long, x string, y string")
    plans = {longest: linededup.RUNS.similar(both, longest) for longest in (None, 60, runs.LONG + 1)}
    assert [[(r.a, r.b) for r in df.collect()] for df in plans.values()] == [[(1, 2)]] * 3
    unions = [df._jdf.queryExecution().optimizedPlan().toString().count("Union") for df in plans.values()]
    assert unions[1] == 0 and unions[0] and unions[2]


def test_lines_are_made_distinct_without_a_sort(spark):
    """Their texts are grouped by hash; the union of two sets of runs is found only where their sizes don't tell."""
    rows = [(1, 1, "a b"), (2, 2, "c"), (1, 1, "a b"), (1, 1, "a b"), (1, 2, "d")]
    out = linededup.distinct(spark.createDataFrame(rows, "d1 long, d2 long, line string").select(F.struct("d1", "d2").alias("id"), "line"))
    assert {(*r.id, r.line, r.n) for r in out.collect()} == {(1, 1, "a b", 3), (2, 2, "c", 1), (1, 2, "d", 1)}
    assert "SortAggregate" not in out._jdf.queryExecution().executedPlan().toString()
    # sets that agree, in lines of other lengths; sets that don't, for all their repeats
    x, y = "abcdefghijkl" * 3, "abcdefghijkl" * 9
    both = spark.createDataFrame([(1, 2, x, y), (3, 4, y, x + "XYZ" * 20), (5, 6, y + "X" * 9, y)], "a long, b long, x string, y string")
    assert {r.a for r in linededup.RUNS.similar(both, 200).collect()} == {1}
    assert 5 * len(character_runs(y)) < 4 * len(character_runs(y + "X" * 9))


def test_written_tables_need_no_job_to_be_counted(spark, monkeypatch):
    """Counts come with the write: asking for them runs no job, and components run none but their writes."""
    group, jobs = spark.sparkContext.setJobGroup, spark.sparkContext.statusTracker().getJobIdsForGroup
    saved = [Scratch(spark).save(spark.range(n).toDF("x"), "t") for n in (0, 5)]
    monkeypatch.setattr(base, "BROADCAST_ROWS", 4)
    name = uuid.uuid4().hex
    group(name, "")
    assert [base.rows(t) for t in saved] == [0, 5]
    hinted = ["ResolvedHint" in base.small(t)._jdf.queryExecution().analyzed().toString() for t in saved]
    assert hinted == [True, False] and not list(jobs(name))
    group(uuid.uuid4().hex, "")
    with monkeypatch.context() as m:
        for action in ("count", "first", "collect", "isEmpty"):
            m.delattr(type(saved[0]), action)
        found = [components(spark.createDataFrame(e, "a long, b long"), Scratch(spark)) for e in ([], [(1, 2), (3, 2), (5, 5), (7, 8)])]
    assert [base.rows(f) for f in found] == [f.count() for f in found] == [0, 3]
    assert {tuple(r) for r in found[1].collect()} == {(2, 1), (3, 1), (8, 7)}


def test_sketches_lose_no_pair(spark, monkeypatch):
    """A pair of similarity 0.8 or more is never ruled out, full sketches and odd lines included; most others are."""
    rng, lines = random.Random(5), ["", "a", "ab", "a" * 500, "ab" * 300, "é" * 9 + "x"]
    for n in (12, 40, 200, 900, 9000):
        for k in (1, 2, 3, 5, 9):
            x = "".join(rng.choice("abcdefgh ") for _ in range(n))
            y = list(x)
            for i in rng.sample(range(n), max(1, n * k // 200)):
                y[i] = "X"
            lines += [x, "".join(y)]
    table_ = spark.createDataFrame([(i, 0, x) for i, x in enumerate(lines)], "d1 long, d2 long, line string").select(F.struct("d1", "d2").alias("id"), "line")
    pairs = table_.alias("l").join(table_.alias("r"), F.col("l.id.d1") < F.col("r.id.d1")).select(F.col("l.id").alias("a"), F.col("r.id").alias("b"))
    runs_ = [character_runs(x) for x in lines]
    near = {(a, b) for a, b in itertools.combinations(range(len(lines)), 2) if 5 * len(runs_[a] & runs_[b]) >= 4 * len(runs_[a] | runs_[b])}
    found = {(r.a.d1, r.b.d1) for r in linededup.RUNS.possible(pairs, linededup.RUNS.sketched(table_)).collect()}
    assert near <= found and len(near) > 5
    # lines of 200 and 900 characters that have nothing in common
    assert all(a // 2 == b // 2 for a, b in found if 26 <= a < b < 46)


def test_long_lines_of_few_digests_meet(spark):
    """Beyond ``SHORT`` runs, but with few or no digests in the sample."""
    rng, rows = random.Random(9), []
    for i in range(60):
        x = "".join(rng.choice("abc") for _ in range(12)) * 40
        rows += [(2 * i, x, "en", "s", 0), (2 * i + 1, x[12:], "en", "s", 0)]
    rows += [(200, "-" * 300, "en", "s", 0), (201, "-" * 400, "en", "s", 0)]
    out = linededup.dedup_lines(table(spark, rows), spark).collect()
    assert [r.n_kept for r in sorted(out, key=lambda r: r.doc_id)] == [1, 0] * 61


def test_lines_awkward(spark, awkward, empty):
    out = linededup.dedup_lines(awkward, spark).collect()
    assert len(out) == len(AWKWARD) and [r.text for r in out if r.doc_id == 1] == [None]
    assert [r.n_kept for r in out if r.doc_id == 5] == [1, 1, 1]
    assert linededup.dedup_lines(empty, spark).count() == 0


@pytest.mark.parametrize("bound", [1_000_000, 0])
def test_components(spark, bound, monkeypatch):
    """With and without broadcasts."""
    monkeypatch.setattr(components_, "BROADCAST_ROWS", bound)
    monkeypatch.setattr(base, "BROADCAST_ROWS", bound)
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(60)] + [(100, x) for x in range(101, 160)] + [(rng.randint(200, 400), rng.randint(200, 400)) for _ in range(150)] + [(5, 5), (1, 0), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark)).collect()}
    ids = {x for e in edges for x in e if x is not None}
    want = groups(ids, [e for e in edges if None not in e])
    assert {i: got.get(i, i) for i in ids} == want
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark)).count() == 0


def test_scratch_uses_the_shared_folder(spark):
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    s = Scratch(spark)
    df = s.save(spark.range(3).toDF("x"), "t")
    assert df.count() == 3 and (root is None or s.root.startswith(root))
    s.drop("t")
    assert not s.paths
