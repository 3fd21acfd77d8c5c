"""Pages, urls and vectors."""

import html
import re

import numpy as np
import pytest

from checks.compare import differences, oracle_connection
from lotbook.llm import html_text, urls, vectors
from lotbook.llm.queries import ORACLES, QUERIES, RULES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, sf_dir, name):
    assert differences(QUERIES[name](spark, sf_dir), oracle_connection(sf_dir), ORACLES[name]) is None


def test_main_text_of_given_pages(spark, sf_dir):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for row in QUERIES["op7_main_text"](spark, sf_dir).collect():
        inside = re.search(r"<article>(.*)</article>", pages[row["page_id"]], re.S).group(1)
        assert row["text"] == " ".join(html.unescape(re.sub("<[^>]*>", " ", inside)).split())
        assert row["n_chars"] == len(row["text"])


def test_field_on_unseen_layouts():
    """Trained on layouts of some texts, tried on pages written by hand."""
    made = [[b for b in html_text.blocks(p) if b.label is not None] for p in html_text.layouts(html_text.STOCK)]
    field = html_text.fit_field(made)
    right = sum(m == (b.label == 1) for p in made for b, m in zip(p, field.decode(p)))
    assert right / sum(map(len, made)) > 0.97
    page = """<body><nav><a href=x>Home</a></nav><header>My site</header><main><article><h1>Heading</h1><p>Text &amp; more  text of
        the article, with <b>bold</b>words.</p><div class="ad">Buy now</div><p>The last one of all.</p><section class="comments"><h3>Comments</h3>
        <p>Great article by the way, I think.</p></section></article></main><aside><p>Aside text goes here.</p></aside>
        <script>var t = "</p><p>no";</script><footer>&copy; 2020</footer></body>"""
    assert field.main_text(page) == "Heading Text & more text of the article, with boldwords. The last one of all."


@pytest.mark.parametrize("page, text", [
    ('<p>One <svg class="i"/> two.</p><p>Three.</p>', "One two.|Three."),
    ("<article><svg-icon name=x></svg-icon><select-box>All</select-box> <p>of it.</p></article>", "All|of it."),
    ("<p>So <math><mi>x</mi> = 1<annotation>x=1</annotation></math> holds.</p><math/><p>Yes.</p>", "So x = 1 holds.|Yes."),
    ("<div><p>a<svg><g>no</p><p>b</p></div><p>c <svg>no</svg></p>", "a|b|c"),
    ("<p>a<span><object>no</span>b</p><svg><svg>no</svg>no</svg><p>c</p>", "a b|c"),
    ("<head><title>no</head><body><p>a<canvas/>no</canvas></p><script>x</div>", "a"),
    ("<div><script>'</div>no'</SCRIPT >a</div><style/>no</style><p>b<noscript><p>no</noscript>", "a|b"),
])
def test_what_is_left_out(page, text):
    assert "|".join(b.text for b in html_text.blocks(page)) == text


def test_learns_from_whole_pages(spark):
    long = "<body><article>" + "".join(f"<p>Sentence {i} of the article, with a few words.</p>" for i in range(600)) + "</article><div class=onlyhere><p>Out of it.</p></div></body>"
    field = html_text.fit(spark.createDataFrame([(1, "u", long)], "page_id bigint, url string, html string"))
    assert len(long) > 20_000 and "c:onlyhere" in field.weight


def test_odd_pages(spark):
    rows = [(1, None, None), (2, "u", ""), (3, "u", "<p>cut off <a href="), (None, "u", "<!-- never closed <p>x"), (5, "u", "a < b & c"), (5, "u", "a < b & c")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 as text", "2 as row")
    field = html_text.Field({"all": 1.0}, np.zeros(2), np.zeros((2, 2)))
    got = [r["text"] for r in html_text.main_texts(pages, field).collect()]
    assert got == ["", "", "cut off", "", "a < b & c", "a < b & c"]
    assert html_text.main_texts(pages.limit(0), field).count() == 0
    judged = urls.judge(pages, RULES).collect()
    assert len(judged) == 6 and {r["verdict"] for r in judged} == {"allow"} and {r["host"] for r in judged} == {""}
    assert urls.judge(pages.limit(0), RULES).count() == 0


def test_rules(spark):
    rows = [("http://EXAMPLE.com/en/1", "block"), ("http://www.example.com/en/?q", "allow"), ("http://a.www.example.com/en/x#y", "allow"),
            ("http://badexample.com/en/", "allow"), ("https://x.net/es/1", "block"), ("x://net/fr/", "block"), ("http://com", None), ("http://com/", "allow")]
    pages = spark.createDataFrame([(i, u, "") for i, (u, _) in enumerate(rows)], "page_id bigint, url string, html string")
    got = {r["row"]["url"]: r["verdict"] for r in urls.judge(pages, RULES).where("rule is not null").collect()}
    assert got == {u: v for u, v in rows if v}


def test_recall_and_scores(spark, sf_dir):
    data = spark.read.parquet(f"{sf_dir}/embeddings.parquet").toPandas().sort_values("vec_id")
    x, ids = np.stack(data["embedding"]).astype(float), data["vec_id"].to_numpy()
    got = QUERIES["op10_nearest_vectors"](spark, sf_dir).toPandas()
    hits = total = 0
    for query, rows in got.groupby("query_id"):
        at = int(np.flatnonzero(ids == query)[0])
        scores = x @ x[at]
        rows = rows.sort_values("rank")
        assert rows["rank"].tolist() == list(range(1, len(rows) + 1)) and query not in rows["vec_id"].tolist()
        assert np.allclose(rows["score"], scores[np.searchsorted(ids, rows["vec_id"])], rtol=0, atol=1e-12)
        scores[at] = -np.inf
        hits += len(set(rows["vec_id"]) & set(ids[np.lexsort((ids, -scores))[:20]].tolist()))
        total += 20
    assert got["query_id"].nunique() == (ids % 20 == 0).sum() and hits / total >= 0.9


def test_every_code_within_the_radius():
    rng = np.random.default_rng(4)
    codes = rng.integers(0, 2**63, (500, 4), dtype=np.uint64)
    codes[:50] = codes[0] ^ (np.uint64(1) << rng.integers(0, 60, (50, 4)).astype(np.uint64))
    index = vectors.MultiIndex(codes)
    distance = np.bitwise_count(codes ^ codes[0]).sum(1)
    for radius in (0, 3, 8, 40, 110, 256):
        for masks in (None, vectors.few_bits(radius // 16)):
            assert index.within(codes[0], radius, masks).tolist() == np.flatnonzero(distance <= radius).tolist()


def test_odd_vectors(spark):
    one = [1.0, 0.0, 2.0]
    rows = [(0, one), (20, one), (40, [0.0, 1.0, 0.0]), (60, None), (80, [0.0, 0.0, 0.0]), (100, [1.0, None, 1.0]), (120, [float("nan"), 1.0, 1.0]),
            (140, [float("inf"), 1.0, 1.0]), (160, []), (None, one), (1, one), (1, one), (2, [5.0, 0.0, 5.0]), (3, [1.0, 2.0])]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").selectExpr("*", "1 as rank")
    got = {}
    for r in vectors.nearest(table, k=3).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert {q: sorted(v) for q, v in got.items()} == {
        0: [(1, 2, 15.0), (2, 1, 5.0), (3, 20, 5.0)], 20: [(1, 2, 15.0), (2, 0, 5.0), (3, 1, 5.0)], 40: [(1, 0, 0.0), (2, 1, 0.0), (3, 2, 0.0)]}
    assert vectors.nearest(table.limit(0)).count() == 0
