import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from meridia.llm import html_text, quality, topk_search, warc
from meridia.llm.html_pages import labelled_page
from tests.llm.helpers import empty, hard, hard_rows


# quality classifier


def test_quality_on_held_out_rows(spark):
    data = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    out = quality.score_quality(docs, quality.train(docs, labels))
    assert out.count() == docs.count()
    rows = out.join(labels, "doc_id").filter("held_out").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in rows) and len(rows) > 40
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.95
    kept = quality.keep_good(docs, quality.train(docs, labels))
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r in out.filter("predicted = 1").collect())


def test_quality_hard_rows(spark):
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 16)] + [(None, 1), (3, None)], "doc_id long, quality int")
    for given in (labels, labels.limit(0), labels.filter("quality = 1")):
        model = quality.train(hard(spark), given)
        out = quality.score_quality(hard(spark), model).collect()
        assert len(out) == len(hard_rows()) and all(0 <= r["score"] <= 1 for r in out)
        assert quality.keep_good(hard(spark), model).columns == hard(spark).columns
        assert quality.score_quality(empty(spark), model).count() == 0
    assert quality.train(empty(spark), labels).score(np.zeros((1, quality.N_FEATURES)))[0] == pytest.approx(0.5)


def test_flat_trees_equal_a_walk():
    r = np.random.default_rng(0)
    x = r.normal(size=(600, 5))
    y = ((x[:, 0] > 0.2) ^ (x[:, 1] > 0)).astype(float)
    model = quality.fit(x, y)
    assert ((model.score(x) > 0.5) == y).mean() > 0.97
    bins = model.bins(x[:40])
    for row, score in zip(bins, model.score(x[:40]), strict=True):
        total = model.base
        for feature, bound, leaf in zip(model.feature, model.bound, model.leaf, strict=True):
            node = 0
            while node < len(feature):
                node = 2 * node + (1 if row[feature[node]] <= bound[node] else 2)
            total += leaf[node - len(feature)]
        assert score == pytest.approx(1 / (1 + np.exp(-total)))


# top-k search


def brute_top(rows, k=5):
    good = {}
    for at, (i, v) in enumerate(rows):
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            good[at] = (i, [int(np.floor(256.0 * float(x))) for x in v])
    out = []
    for q, (i, a) in good.items():
        if i % 50 == 0:
            found = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), j) for at, (j, b) in good.items() if at != q and len(a) == len(b))
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(found[:k])]
    return sorted(out)


@pytest.mark.parametrize("sample", [3, 500])
def test_top_k_equals_brute_force(spark, sample, monkeypatch):
    monkeypatch.setattr(topk_search, "BLOCK", (6000, 6000))
    monkeypatch.setattr(topk_search, "GROUP", (200, 200))
    r = random.Random(1)
    rows = [(k, [float(np.float32(r.gauss(0, 0.1))) for _ in range(12)]) for k in range(260)]
    rows += [(1000 + k, [0.5] * 12) for k in range(40)]  # ties
    rows += [(50, [0.25] * 12), (300, None), (350, [0.1] * 11 + [None]), (400, [float("nan")] * 12), (450, [float("inf")] * 12), (None, [0.1] * 12)]
    rows += [(500, []), (501, []), (550, [1.0, 2.0]), (551, [3.0, -4.0]), (600, [1e7, 1e7]), (601, [-1e7, 2e6])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1)).repartition(3)
    got = topk_search.top_k(df, F.col("vec_id") % 50 == 0, sample=sample)
    assert sorted((x["query_id"], x["rank"], x["vec_id"], x["score"]) for x in got.collect()) == brute_top(rows)
    assert topk_search.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def share_scored(monkeypatch, x, queries):
    """Share of all (query, vector) pairs that are multiplied; results equal brute force."""
    p = topk_search.Pivots(x[:: max(1, len(x) // 500)])
    norms = (x.astype(float) ** 2).sum(axis=1)
    facts = p.facts(p.distances(x), norms)
    seen = []
    plain = topk_search._scores
    monkeypatch.setattr(topk_search, "_scores", lambda q, v: seen.append(len(v)) or plain(q, v))
    for q in queries:
        bound = p.bounds(facts[q : q + 1], facts)[0] + topk_search._slack(norms[q], norms, p)
        assert (bound >= x @ x[q]).all()
        best = topk_search.search_block(x[q], bound, -np.inf, q, x, np.arange(len(x)), np.arange(len(x)), 5)
        assert best == [(-s, k) for s, k in sorted(((-int(x[q] @ v), k) for k, v in enumerate(x) if k != q))[:5]]
    return sum(seen) / len(queries) / len(x)


def test_bounds_eliminate(monkeypatch):
    """Most vectors of other clusters are never multiplied, and many of vectors without any structure."""
    r = np.random.default_rng(2)
    centres = r.normal(size=(8, 16)) * 800
    assert share_scored(monkeypatch, np.concatenate([c + r.normal(size=(400, 16)) * 20 for c in centres]).astype(np.int64), [5, 999]) < 0.1
    assert share_scored(monkeypatch, (r.normal(size=(8000, 64)) * 32).astype(np.int64), [0, 50, 4000]) < 0.4


def test_blocks_of_other_clusters_go_before_the_shuffle(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "BLOCK", (8000, 8000))
    monkeypatch.setattr(topk_search, "GROUP", (800, 800))
    pairs = []
    plain = topk_search.materialize
    monkeypatch.setattr(topk_search, "materialize", lambda df, name: pairs.append(plain(df, name)) or pairs[-1])
    r = np.random.default_rng(4)
    centres = np.eye(16)[:8] * 30
    rows = [(k, (centres[k % 8] + r.normal(size=16) * 0.2).tolist()) for k in range(2000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk_search.top_k(df, F.col("vec_id") % 50 == 0)
    assert sorted((x["query_id"], x["rank"], x["vec_id"], x["score"]) for x in got.collect()) == brute_top(rows)
    met = pairs[-1].agg(F.count_distinct("block").alias("b"), F.count_distinct("group").alias("g"), F.count(F.lit(1)).alias("n")).first()
    assert met["n"] < 0.4 * met["b"] * met["g"]


# web pages


def test_html_model_on_held_out_pages():
    model, wrong, total = html_text.default_model(), 0, 0
    for seed in range(9000, 9100):
        page = html_text.parse(labelled_page(seed), marks=True)
        odds, mark = model.marginals(page), [0] * len(page.name)
        for k in range(1, len(page.name)):
            mark[k] = page.mark[k] if page.mark[k] >= 0 else mark[page.parent[k]]
            if page.name[k] == "#text" and page.text[k].strip():
                total += 1
                wrong += (odds[k] > 0) != mark[k]
    assert total > 1000 and wrong / total < 0.01


def test_marginals_are_exact():
    """Sum-product equals the sum over all markings of a small page."""
    import itertools
    import math

    model = html_text.default_model()
    page = html_text.parse("<body><nav><a>x</a></nav><article><p>some words here</p></article></body>")
    n = len(page.name)
    unary = [sum(model.weights.get(f, 0) for f in found) for found in html_text.node_features(page)]
    weight = np.zeros((n, 2))
    for y in itertools.product((0, 1), repeat=n):
        w = math.exp(sum(u for u, s in zip(unary, y, strict=True) if s))
        for k in range(1, n):
            w *= model.edge(page.name[k], page.words[k])[2 * y[page.parent[k]] + y[k]]
        for k in range(n):
            weight[k, y[k]] += w
    assert model.marginals(page) == pytest.approx(np.log(weight[:, 1] / weight[:, 0]).tolist(), abs=1e-6)


def test_html_text_of_pages(spark):
    import html
    import re

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r for r in html_text.extract_text(pages).collect()}
    for p in pages.collect():
        inner = re.search("<article>(.*)</article>", p["html"], re.S)[1]
        inner = re.sub("<[^>]*>", "", re.sub("</?(p|h1|br)>", " ", inner))
        want = " ".join(html.unescape(inner).split())
        assert got[p["page_id"]]["text"] == want and got[p["page_id"]]["n_chars"] == len(want)


def test_html_hard_rows(spark):
    pages = [
        (1, "u", None), (2, None, ""), (None, "u", "<p>a"), (4, "u", "plain &lt;b&gt; text"), (4, "u", "<"),
        (5, "u", "<article><h1>T</h1><p>one<!-- <p>no</p> -->two<br>three&nbsp;&amp;<p>next<script>var a = '</p>';</script> end</article>"),
        (6, "u", "<div class=content><p>" + "word " * 60_000 + "</p></div>"), (7, "u", "<b>" * 5000 + "deep"), (8, "u", "<a href='x>broken <p>y"),
        (9, "u", "<body><form><p>type here</p><input></form><div class='comments'><p>first!</p></div></body>"),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("text", F.lit("clash")).repartition(2)
    out = html_text.extract_text(df).collect()
    assert len(out) == len(pages) and all(r["n_chars"] == len(r["text"]) for r in out)
    text = {r["page_id"]: r["text"] for r in out}
    assert text[1] == text[2] == text[9] == "" and text[5] == "T onetwo three & next end"
    assert html_text.extract_text(df.limit(0)).count() == 0


# revisits

CAPTURES = "record_id long, url string, ts long, kind string, etag string, last_modified string, headers map<string,string>, digest string"


def test_revisits(spark):
    h = {"ETag": '"a"', "Content-Type": "text/html"}
    rows = [
        (1, "http://www.x.org/a/?utm_source=z&b=2&a=1#top", 10, "response", '"a"', "mon", h, "d1"),
        (2, "https://X.org/a?a=1&b=2", 20, "response", '"b"', None, {"etag": '"b"', "ETAG": '"B"'}, "d2"),
        (3, "http://x.org/a?a=1&b=2", 15, "revisit", 'W/"a"', None, {"Date": "15", "Set-Cookie": "no"}, "x"),
        (4, "http://x.org/a?a=1&b=2", 20, "revisit", '"b"', None, {"Date": "20"}, "x"),
        (5, "http://x.org/a?a=1&b=2", 100_000_000, "revisit", '"a"', None, {}, "x"),
        (6, "http://x.org/a?a=1&b=2", 5, "revisit", None, None, None, "x"),
        (7, "http://y.org/", 1, "response", None, None, None, "d7"), (8, "http://www.y.org", 9_000_000, "revisit", '"q"', None, {"Date": "9"}, "x"),
        (9, None, 3, "revisit", None, None, None, None), (10, "http://y.org", None, "response", None, None, None, "d10"),
    ]
    df = spark.createDataFrame(rows, CAPTURES).withColumn("status", F.lit("clash")).repartition(3)
    got = {r["record_id"]: r for r in warc.resolve_revisits(df).collect()}
    assert {k: (r["status"], r["source_id"], r["digest"]) for k, r in got.items()} == {
        1: ("full", 1, "d1"), 2: ("full", 2, "d2"), 3: ("resolved", 1, "d1"), 4: ("resolved", 2, "d2"), 5: ("stale", None, None),
        6: ("missing", None, None), 7: ("full", 7, "d7"), 8: ("unchecked", None, None), 9: ("invalid", None, None), 10: ("invalid", 10, "d10"),
    }
    assert got[3]["headers"] == {"etag": '"a"', "content-type": "text/html", "date": "15"}
    assert got[8]["headers"] == {"date": "9"}
    trusted = warc.resolve_revisits(df, trust_unchecked=True).filter("record_id = 8").first()
    assert (trusted["status"], trusted["source_id"], trusted["digest"]) == ("unchecked", 7, "d7")
    longer = df.unionByName(df.withColumn("url", F.concat(F.regexp_replace("url", "/$", ""), F.lit("/" + "p" * 100_000)))).filter("record_id IN (7, 8)")  # long addresses, repeated rows
    assert warc.resolve_revisits(longer.unionByName(longer)).filter("status = 'unchecked'").count() == 4
    assert warc.resolve_revisits(df.limit(0)).count() == 0


@pytest.mark.parametrize("most", [100_000, 3])
def test_revisits_equal_brute_force(spark, most):
    r = random.Random(3)
    rows = [(k, f"http://h{r.randrange(4)}.org/", r.randrange(400), r.choice(["response", "revisit"]), r.choice(['"a"', '"b"', None]), None, {}, f"d{k}") for k in range(300)]
    got = {x["record_id"]: (x["status"], x["source_id"]) for x in warc.resolve_revisits(spark.createDataFrame(rows, CAPTURES), bucket=30, most=most).collect()}
    for k, url, ts, kind, tag, *_ in rows:
        full = [(t, j, e) for j, u, t, kk, e, *_ in rows if kk == "response" and u == url and t <= ts]
        if kind == "response":
            want = ("full", k)
        elif not full:
            want = ("missing", None)
        else:
            _, j, e = max(full, key=lambda x: x[:2])
            want = ("unchecked", None) if tag is None or e is None else ("resolved", j) if tag == e else ("stale", None)
        assert got[k] == want


@pytest.mark.parametrize(
    "before",
    [
        "<svg/>", "<svg width=1 />", '<svg viewBox="0 0 9 9"/>', "<math/>", "<svg><path d='M0'/><circle r=1 /></svg>", "<svg><title/><style/><path d='M0'/></svg>",
        "<math><mi>x</mi><mspace/><mo>=</mo></math>", "<svg><path d='M0'>", "<svg><g><path d='M0'/>", "<math><mrow>", "<object data=a.pdf></object>", "<object data=a.pdf>",
        "<noscript><img src=a.png></noscript>", "<noscript>", "<template></template>", "<select></select>", "<script>var a = '<p>';</script>", "<style>p {}</style>",
    ],
)
def test_article_after_foreign_elements_stays(before):
    model = html_text.default_model()
    for k in range(1000, 1006):
        page = labelled_page(k)
        start = page.index(">", page.index("<body")) + 1
        want = html_text.main_text(page, model)
        assert want and html_text.main_text(page[:start] + before + page[start:], model) == want


P = "<p>Some words of a paragraph that is long enough here.</p>"
T = "Some words of a paragraph that is long enough here."


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<article>{P}{P}</article>", f"{T} {T}"),
        (f"<body><nav><ul><li><a href=/>home</a></li><li><a href=/b>b</a></li></ul></nav><article>{P}{P}</article><footer>&copy; x</footer></body>", f"{T} {T}"),
        (f"<div id='main'>{P * 3}</div>", f"{T} {T} {T}"),
        (f"<body><header><h1>Site</h1></header><article>{P * 2}</article></body>", f"{T} {T}"),
        (f'<article><h1>T</h1><p data-y="12px">one two</p><p data-y>three</p><p data-y="0">four</p>{P}</article>', f"T one two three four {T}"),
        (f'<article><h1>T</h1>{P}<p hidden>secret hidden words</p><p style="display:none">more secret words here</p></article>', f"T {T}"),
        (f"<body><table><tr><td><ul><li><a href=/a>menu a</a></li><li><a href=/b>menu b</a></li></ul></td><td><h1>T</h1>{P * 3}</td></tr></table></body>", f"T {T} {T} {T}"),
        (f'<article><h1>T</h1><p>see <a href="/x?id=sidebar-ads">this link</a> and more words here</p><p data-id="comments">kept words are here</p>{P}</article>', f"T see this link and more words here kept words are here {T}"),
        (f"<article><h1>T</h1><p>the formula <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds</p>{P}</article>", f"T the formula x=1 holds {T}"),
        (f"<body><nav><a href=/>x</a></nav><svg width=1 /><article><h1>T</h1>{P}</article></body>", f"T {T}"),
    ],
)
def test_main_text_of_layouts(page, want):
    assert html_text.main_text(page, html_text.default_model()) == want


def test_formula_and_fallback_texts_reach_the_model():
    model, plain, found = html_text.default_model(), 0, 0
    for k in range(1000, 1030):
        page = labelled_page(k)
        starts = [at.end() for at in re.finditer(r"<p\b[^>]*>", page)]
        at = starts[len(starts) // 2]
        told = [f in html_text.main_text(page[:at] + f"{a}formula{b}" + page[at:], model) for f, a, b in (("formula", "<i>", "</i>"), ("formula", "<math><mi>", "</mi></math>"))]
        plain, found = plain + told[0], found + all(told)
    assert plain > 10 and found >= 0.9 * plain
    for inner in ("<object data=a.pdf>formula</object>", "<noscript>formula</noscript>", "<svg><text>formula</text></svg>"):
        assert "formula" in html_text.parse(f"<p>{inner}</p>").text


def test_repeated_ids_teach_once_whatever_the_order(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "fit", lambda x, y: seen.append((x, y)))
    docs = [(0, f"copy number {k} of the hot id with some words") for k in range(300)] + [(k, f"text {k} of an id that is there once") for k in range(1, 60)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, quality int")
    taught = labels.filter(~quality.held_out(F.col("doc_id"))).count()
    hot = labels.filter("doc_id = 0").filter(~quality.held_out(F.col("doc_id"))).count()
    assert hot == 1
    for k, parts in ((0, 1), (1, 7), (2, 4)):
        mixed = random.Random(k).sample(docs, len(docs))
        quality.train(spark.createDataFrame(mixed, "doc_id long, text string").repartition(parts), labels, sample=60)
    assert all(len(y) == taught for _, y in seen)
    assert all((x == seen[0][0]).all() and (y == seen[0][1]).all() for x, y in seen)


def test_html_text_alone_is_main_text():
    model = html_text.default_model()
    assert html_text.main_text("just  text", model) == "just text"
    assert html_text.main_text("<html><body>Straight &amp; in <b>the</b> <a href=x>body</a><script>no</script><br>more</body></html>", model) == "Straight & in the body more"
    assert html_text.main_text("   ", model) == "" and html_text.main_text("<!-- x -->", model) == ""
    assert html_text.main_text("shown <span hidden>not</span>", model) != "shown not"


def test_html_of_any_depth_in_linear_time():
    import time

    n = 40_000
    pages = ["<div>" * n + "x" + "</div>" * n, "<div>" * n + "</x>" * n, "<p><table><tr><td>" + "<div>" * n, "<svg>" * n + "<p>a" * n, "<ul><li>" * n, "<b><p>" * n, "<svg><desc>" * n + "<script/>" * n]
    for page in pages:
        began = time.process_time()
        html_text.main_text(page, html_text.default_model())
        assert time.process_time() - began < 20
