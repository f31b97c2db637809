"""Whitening, ranked search and HTML extraction against plain versions, also on odd input."""

from __future__ import annotations

import html
import math
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gevel.llm import boosting, dom, html_text, lexical, layouts, queries, whitening

SF = "/root/testdata/sf0.001"


def plainly_whitened(vectors: np.ndarray, most: int = 32):
    x = np.floor(64 * vectors.astype(np.float64)).astype(np.int64) + 1_000_000
    n = len(x)
    far = n * x.astype(object) - x.sum(0).astype(object)
    c = (far / n).astype(np.float64)
    values, axes = np.linalg.eigh(c.T @ c / n)
    values, axes = values[::-1], axes[:, ::-1]
    k = min(most, (values > 1e-12 * values.sum()).sum())
    return c @ axes[:, :k] / np.sqrt(values[:k]), values[:k] / values.sum(), (far**2).sum(1)


def same_up_to_sign(ours: np.ndarray, theirs: np.ndarray) -> bool:
    return np.allclose(ours * np.sign((ours * theirs).sum(0)), theirs, atol=1e-8)


def by_row(df, key="vec_id"):
    rows = df.toPandas().sort_values([key, "component"])
    return rows, rows.whitened.to_numpy().reshape(-1, rows.component.max())


@pytest.mark.parametrize("block", [8192, 7])
def test_whitening_equals_whole_decomposition(spark, monkeypatch, block):
    monkeypatch.setattr(whitening, "BLOCK", block)
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows, ours = by_row(queries.op11_embedding_whitening(spark, SF))
    plain, shares, deviations = plainly_whitened(np.array([r.embedding for r in table.orderBy("vec_id").collect()]))
    assert same_up_to_sign(ours, plain)
    assert np.allclose(rows.explained[:32], shares, rtol=1e-9)
    assert rows.deviation[rows.component == 1].tolist() == deviations.tolist()
    assert set(rows.n) == {table.count()} and rows.identity_error.nunique() == 1 and rows.identity_error.iloc[0] < 1e-9


@pytest.mark.parametrize("fall", [1.0, 0.9, 0.7])
def test_basis_is_widened_only_where_it_must_be(fall):
    random = np.random.default_rng(0)
    axes = np.linalg.qr(random.normal(size=(200, 200)))[0]
    values = 100 * fall ** np.arange(200) + np.linspace(0.2, 0, 200)
    matrix = axes * values @ axes.T
    asked = []
    found, vectors = whitening.principal(lambda b: (asked.append(b.shape[1]), matrix @ b)[1], 200, 10)
    assert np.allclose(found, values[:10], rtol=1e-12) and np.allclose(np.abs((vectors * axes[:, :10]).sum(0)), 1, atol=1e-9)
    assert (max(asked) < 200) == (fall < 1)


def test_whitening_of_odd_rows(spark):
    random = np.random.default_rng(1)
    good = random.normal(size=(60, 5)) * 3
    rows = [(k, [float(v) for v in x], "a") for k, x in enumerate(good)]
    odd = [(100, None, "a"), (101, [1.0, None, 1.0, 1.0, 1.0], "a"), (102, [1.0, float("nan"), 1.0, 1.0, 1.0], "a"), (103, [float("inf")] * 5, "a"), (104, [], "a"), (105, [1.0] * 4, None)]
    schema = "vec_id long, embedding array<double>, n string"
    df = spark.createDataFrame([*rows, rows[0], (None, rows[1][1], None), *odd], schema).repartition(3)
    out = whitening.whiten(df)
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    got = out.toPandas()
    assert len(got) == 62 * 5 and set(got.n) == {62} and got.vec_id.isna().sum() == 5 and (got.vec_id == 0).sum() == 10
    plain, _, _ = plainly_whitened(np.concatenate([good, good[:2]]))
    ours = got[got.vec_id.between(1, 59)].sort_values(["vec_id", "component"]).whitened.to_numpy().reshape(-1, 5)
    assert same_up_to_sign(ours, plain[1:60])
    for none in (df.where("vec_id < 0"), df.where("vec_id >= 100"), df.where("vec_id = 3")):
        assert whitening.whiten(none).count() == 0
    flat = whitening.whiten(spark.createDataFrame([(k, [float(k), 2.0 * k, 7.0], "") for k in range(9)], schema)).toPandas()
    assert set(flat.component) == {1}


def test_whitening_of_large_numbers(spark):
    random = np.random.default_rng(2)
    vectors = np.floor(random.normal(size=(40, 3)) * 2.0**40) / 64
    rows, ours = by_row(whitening.whiten(spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(vectors)], "vec_id long, embedding array<double>")))
    plain, _, deviations = plainly_whitened(vectors)
    assert same_up_to_sign(ours, plain)
    assert rows.deviation.isna().all() and max(deviations) >= 2**63


def plainly_ranked(docs, items, k):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n_docs, n_terms = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        found = []
        for doc, c in held:
            m = 75 + 25 * c.total() * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if c[t])
            found += [(-score, doc is None, doc)] if score > 0 else []
        out += [(item, rank, doc, -s) for rank, (s, _, doc) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=str)


ODD_TEXTS = ["", None, " .,; ", "a", "A a-B_b b", "Ünï é É ﬁ", "x" * 9000, "word " * 7000, "日本語 text 123,456", "🙂🙂 é", "one\x00two", "la de la que", "la de la que"]


@pytest.mark.parametrize(("window", "chunk"), [(16_384, 4 << 20), (7, 100)])
def test_ranked_search(spark, monkeypatch, window, chunk):
    monkeypatch.setattr(lexical, "WINDOW", window)
    monkeypatch.setattr(lexical, "CHUNK", chunk)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()][:120] + [(1000 + k, t) for k, t in enumerate(ODD_TEXTS)] + [(1011, "la de la que"), (None, "la de la que"), (-5, "la de la que")]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()][:10] + [(100 + k, t) for k, t in enumerate(ODD_TEXTS)] + [(3, "la la é"), (None, "que de x")]
    got = lexical.ranked_search(spark.createDataFrame([(a, b, 1) for a, b in docs], "doc_id long, text string, rank int").repartition(3), spark.createDataFrame(items, "item_id long, text string"), k=6)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plainly_ranked(docs, items, 6)


def test_ranked_search_in_blocks_of_queries(spark, monkeypatch):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    whole = sorted(map(tuple, lexical.ranked_search(docs, items).collect()))
    monkeypatch.setattr(lexical, "QUERIES", 40_000)
    assert len(list(lexical.blocks(items, "item_id", "text"))) > 2
    assert sorted(map(tuple, lexical.ranked_search(docs, items).collect())) == whole
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    assert sorted(con.execute(lexical.oracle_sql()).fetchall()) == whole
    assert lexical.ranked_search(docs.where("doc_id < 0"), items).count() == lexical.ranked_search(docs, items.where("item_id < 0")).count() == 0


def article(page: str) -> str:
    """The text of the one article element that the test pages have."""
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    parts = re.split(r"</?(?:h1|p)>", inner)
    return "\n".join(s for x in parts if (s := " ".join(html.unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))).split())))


@pytest.fixture(scope="module")
def extractor(spark):
    return html_text.train(spark.read.parquet(f"{SF}/pages.parquet"))


def test_sample_of_pages(spark, monkeypatch):
    df = spark.read.parquet(f"{SF}/pages.parquet")
    monkeypatch.setattr(html_text, "SAMPLE", 4)
    several = df.unionByName(df.where("page_id = 3").crossJoin(spark.range(200)).select(df.columns))
    assert 0 < html_text.sample(several, "html").count() <= 4
    assert html_text.sample(several, "html").distinct().count() == html_text.sample(several, "html").count()


def test_main_text_of_pages(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = queries.op13_html_text(spark, SF).collect()
    assert sorted(r.page_id for r in got) == sorted(pages)
    assert all(r.text == article(pages[r.page_id].html) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url for r in got)


def test_layouts_never_seen(extractor):
    pages = [p for made in [layouts.Layouts([], [], seed=78)] for p in (made.page() for _ in range(250))]
    forest, kinds, _ = html_text.labelled([dom.parse(p) for p in pages])
    keep, size = extractor.kept(forest), np.bincount(forest.run_nodes, [len(r) for r in forest.runs], len(kinds))
    right = (size * (keep & (kinds == html_text.OURS))).sum()
    assert right / (size * keep).sum() > 0.95 and right / (size * (kinds == html_text.OURS)).sum() > 0.95


SITE = """<body><div class="cookie-banner"><p>We use cookies to improve this site. By going on you agree to this use.</p><button>OK</button></div>
<div id="top"><a href="/">Site</a> <a href="/b">Blog</a></div><div id="content"><h1>Title &amp; more</h1><p>One longer paragraph with some text, that goes on
for a while. And more&nbsp;text follows here.</p><p>Two.</p><div class="promo">Buy now and save ten percent!</div><p>Three paragraphs of <b>text</b> are here, and it ends.</p></div>
<div id="sidebar"><h3>Related</h3><ul><li><a href=1>Something else</a></li><li><a href=2>Other</a></li></ul></div><form class="newsletter">Your mail <input></form>
<div id="comments"><h3>2 comments</h3><div class="comment"><b>joe</b><p>I really like this article. It is great and well written.</p></div></div><div id="footer">&copy; 2020 Someone.</div>"""


def test_site_without_article_element(extractor):
    want = "Title & more\nOne longer paragraph with some text, that goes on for a while. And more text follows here.\nTwo.\nThree paragraphs of text are here, and it ends."
    assert html_text.main_texts([SITE, "", SITE], extractor) == [want, "", want]


def test_kinds_never_contradict(extractor):
    made = layouts.Layouts([], [], seed=5)
    forest = dom.Forest.of([dom.parse(made.page()) for _ in range(40)])
    random = np.random.default_rng(0)
    costs = random.exponential(size=(len(forest.parents), 3))
    kinds = html_text.decoded(forest, costs)
    up = forest.parents
    inner = up >= 0
    assert ((kinds[up[inner]] == html_text.MIXED) | (kinds[up[inner]] == kinds[inner])).all()


def test_decoding_is_the_best_of_all():
    tree = dom.parse("<div>a<p>b<p>c</div><ul><li>d<li>e</ul>")
    forest = dom.Forest.of([tree])
    random, n = np.random.default_rng(4), len(tree.tags)

    def best(costs):
        found = []
        for code in range(3**n):
            kinds = [code // 3**k % 3 for k in range(n)]
            if all(kinds[p] in (html_text.MIXED, kinds[k]) for k, p in enumerate(tree.parents) if p >= 0) and all(kinds[k] != html_text.MIXED for k in set(range(n)) - set(tree.parents)):
                found.append((sum(costs[k, kinds[k]] for k in range(n)), kinds))
        return min(found)[1]

    for _ in range(5):
        costs = random.exponential(size=(n, 3))
        assert html_text.decoded(forest, costs).tolist() == best(costs)


def test_broken_html():
    tree = dom.parse('<title>x</title><p>a &lt; b<p>c <script>"<p>no</p>"</script>d<table><tr><td>1<td>2<tr><td>3</table><!-- <p>no --> x < y <img alt="a>b"> <style>p{}</style>end <li>f<textarea>no</textarea></section></b>')
    assert tree.run_texts == ["a < b", "c d", "1", "2", "3", "x < y end", "f"]
    assert dom.parse("no tags & none").run_texts == ["no tags & none"]
    assert dom.parse("<!-- never ends <p>x").run_texts == dom.parse("<script>x").run_texts == []
    for long in ('<a "' * 20_000, "<div>" * 20_000 + "</section>" * 20_000, "<!--" * 20_000, "<li>" * 20_000 + "x", "<" * 50_000, "<p>word " * 50_000):
        dom.Forest.of([dom.parse(long)]).features({})


def test_odd_pages(spark, extractor):
    rows = [(1, "u", None, "x"), (2, None, "", "x"), (None, "u", SITE, None), (3, "v", SITE, "x"), (3, "v", SITE, "x"), (4, "w", "<nav><a href=1>A</a></nav>", "x"), (5, "l", f"<article>{'<p>Many words are here.</p>' * 30_000}</article><footer>f</footer>", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = html_text.html_text(df, extractor=extractor)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    got = sorted(((r.page_id, r.url, r.n_chars) for r in out.collect()), key=str)
    n = len(html_text.main_texts([SITE], extractor)[0])
    assert got == sorted([(1, "u", 0), (2, None, 0), (None, "u", n), (3, "v", n), (3, "v", n), (4, "w", 0), (5, "l", 30_000 * 21 - 1)], key=str)
    assert html_text.html_text(df.where("page_id < 0")).count() == 0


def test_trees_learn_steps_and_products():
    random = np.random.default_rng(3)
    x = random.normal(size=(4000, 6)).astype(np.float32)
    classes = np.where(x[:, 0] > 0.5, 2, (x[:, 1] * x[:, 2] > 0).astype(int))
    model = boosting.fit(x[:3000], classes[:3000], 3, np.ones(3000))
    assert (model.log_shares(x[3000:]).argmax(1) == classes[3000:]).mean() > 0.93
