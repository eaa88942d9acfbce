"""Main text: the cut against all labellings, the pages' articles, pages of other make."""

import html
import itertools
import random
import re

import duckdb
import pytest

from revana.llm import main_text, queries
from revana.llm.main_text import Page, label_blocks, minimum_cut
from tests.llm.test_llm import SF, read


def text_of(page, model=None):
    page = Page(page)
    return " ".join(t for t, kept in zip(page.texts, label_blocks(page, model or {})) if kept)


@pytest.fixture(scope="module")
def model(spark):
    return main_text.train(spark.read.parquet(f"{SF}/pages.parquet"))


# ---- the cut ------------------------------------------------------------------

def test_cut_equals_the_best_of_all_labellings():
    rng = random.Random(4)
    for _ in range(300):
        n = rng.randint(1, 9)
        costs = [rng.randint(-9, 9) * rng.choice([0, 1, 1, 3]) for _ in range(n)]
        joined = [(a, b, rng.randint(0, 7)) for a, b in itertools.combinations(range(n), 2) if rng.random() < 0.5]
        joined += joined[:1]

        def cost(side):
            return (sum(c for c, s in zip(costs, side) if c > 0 and not s) - sum(c for c, s in zip(costs, side) if c < 0 and s)
                    + sum(w for a, b, w in joined if side[a] != side[b]))

        best = min(map(cost, itertools.product([False, True], repeat=n)))
        largest = [any(s[v] for s in itertools.product([False, True], repeat=n) if cost(s) == best) for v in range(n)]
        assert minimum_cut(costs, joined) == largest
        assert main_text._flow_side(costs, joined) == largest


def test_long_chains_are_cut():
    rng = random.Random(5)
    costs = [rng.randint(-2000, 2000) for _ in range(20_000)]
    side = minimum_cut(costs, [(i, i + 1, 1000) for i in range(len(costs) - 1)])
    # Dynamic program over the chain.
    keep, drop = 0, 0
    for i, c in enumerate(costs):
        keep, drop = (min(keep, drop + 1000 * (i > 0)) + max(-c, 0), min(drop, keep + 1000 * (i > 0)) + max(c, 0))
    got = sum(abs(c) for c, s in zip(costs, side) if (c > 0) != s and c) + 1000 * sum(a != b for a, b in zip(side, side[1:]))
    assert got == min(keep, drop)


# ---- pages --------------------------------------------------------------------

def article(page):
    inner = re.search(r"<article>(.*)</article>", page, re.S)[1]
    return " ".join(html.unescape(re.sub(r"<[^>]*>", " ", inner)).split())


def test_query_returns_each_article_whole(spark):
    got = {r.page_id: r for r in queries.op12_main_text(spark, SF).collect()}
    pages = read("pages")
    assert len(got) == len(pages)
    for page_id, url, page in pages:
        assert tuple(got[page_id]) == (page_id, url, article(page), len(article(page)))


PARTS = {
    "header": "<header><a href=/>Logo</a> Daily site</header>",
    "menu": "<div class='main-menu'><ul><li><a href=/a>Home<li><a href=/b>World</ul></div>",
    "notice": "<div id=cookieNotice>We use cookies. <button>Fine</button></div>",
    "advert": "<div class='ad-slot'>Buy now, it is cheap.</div>",
    "form": "<form action=/s><label>Mail</label> <input> <select><option>One<option>Two</select> Subscribe.</form>",
    "sidebar": "<aside><h3>Read on</h3><p>Another long story about something else entirely, with commas, and more.</p></aside>",
    "comments": "<section class=comments><article><p>What a long and good comment, I did like the text, said one.</p></article></section>",
    "script": "<script>if (a < b) { document.write('<p>no</p>') }</script><style>p > b {}</style>",
    "noscript": "<noscript>Turn it on.</noscript>",
    "footer": "<footer><p>&copy; All rights.</p></footer>",
    "hidden": "<div style='display: none'>Not seen.</div><p hidden>Nor this.</p>",
}
BODY = "<h1>A &amp; B &lt;c&gt;</h1><p>First <b>part</b>,\n  second&nbsp;part.<p>Next<br>line <a href=x>with a link</a>.<ul><li>One<li>Two</ul>" \
       "<table><tr><td>Cell<td>Other</table><pre>a  b</pre><blockquote>Said &eacute;.</blockquote>"
TEXT = "A & B <c> First part, second part. Next line with a link. One Two Cell Other a b Said é."


@pytest.mark.parametrize("wrap", ["<article>%s</article>", "<main>%s</main>", "<main><article class='has-sidebar'>%s</article></main>",
                                  "<form><article>%s</article></form>", "<div role=main>%s</div>",
                                  "<div class=page><article><header>%s</header></article></div>".replace("<header>%s</header>", "%s")])
@pytest.mark.parametrize("seed", range(3))
def test_every_kind_of_boilerplate_goes(model, wrap, seed):
    parts = list(PARTS.values())
    random.Random(seed).shuffle(parts)
    cut = len(parts) // 2
    page = ("<!doctype html><html><head><title>T</title><body class='with-sidebar'>" + "".join(parts[:cut])
            + wrap % (BODY.replace("<ul>", PARTS["advert"] + PARTS["sidebar"] + "<ul>") + PARTS["comments"])
            + "<!-- <p>no</p> -->" + "".join(parts[cut:]) + "</body></html>")
    assert text_of(page, model) == TEXT
    assert text_of(page) == TEXT


def test_form_labels_pages_without_named_elements(spark):
    """The articles of the pages with every naming element made a plain one."""
    model = main_text.train(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))
    kept = lost = menus = others = 0
    for _, _, page in duckdb.sql("SELECT * FROM '/root/testdata/sf0.01/pages.parquet'").fetchall():
        plain = Page(re.sub(r"<(/?)(nav|article|footer|div)[^>]*>", r"<\1div>", page))
        assert plain.texts == Page(page).texts
        for text, owner, a, b in zip(plain.texts, plain.owners, label_blocks(Page(page), model), label_blocks(plain, model)):
            kept += len(text) * (a and b)
            lost += len(text) * (a and not b)
            menus += len(text) * (b and plain.tags[owner] == "li")
            others += len(text) * (b and not a)
    # Nothing of the article and no menu; a line of advert or footer beside it looks like a short paragraph.
    assert lost == 0 and menus == 0 and others <= 0.06 * kept


@pytest.mark.parametrize("page, expected", [
    (None, ""), ("", ""), (" \n ", ""), ("<p>", ""), ("<article>", ""), ("<article>a", "a"),
    ("<article><p>a<p>b</article>c", "a b"), ("<article>1 < 2 && 3 <4</article>", "1 < 2 && 3 <4"),
    ("<article>a<!-- never ends", "a"), ("<article>a<script>never ends", "a"), ("<article>a<p class='x>b</p>c</article>", "a b c"),
    ("<article>a</b></div></p>b</article>", "a b"), ("<article><b>a<p>b</b>c</p></article>", "a bc"),
    ("<ARTICLE>a<BR/>b<HR>c</ARTICLE>", "a b c"), ("<article>&#xD800;&amp;amp;&bogus;&#65;</article>", "�&amp;&bogus;A"),
    ("<article><header><h1>T</h1><p>By me</p></header><p>x</p></article>", "T x"),
    ("<article>a<span class=ad>b</span>c</article>", "a c"), ("<html><head><title>t</title><p>x", "x"),
])
def test_odd_markup(page, expected):
    assert text_of(page or "") == expected


def test_odd_rows_and_columns(spark, model):
    long = "<article>" + "<p>word word &amp; word.</p>" * 30_000 + "</article>"
    rows = [(None, "u", None), (1, None, ""), (1, "v", "<article>x</article>"), (1, "v", "<article>x</article>"),
            (2, "w", long), (3, "z", "<div>" * 50_000 + "x"), (4, "y", "<a \"'>" * 20_000 + "<b>" * 20_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr(
        "*", "'t' AS text", "0 AS n_blocks", "0 AS n_content", "'f' AS feature")
    got = main_text.extract_main_text(pages, model, ["page_id", "url"]).collect()
    assert sorted((r.page_id or 0, r.n_content, len(r.text)) for r in got)[:4] == [(0, 0, 0), (1, 0, 0), (1, 1, 1), (1, 1, 1)]
    assert {r.page_id: len(r.text) for r in got}[2] == 30_000 * 18 - 1
    assert main_text.extract_main_text(pages.limit(0), {}, ["page_id"]).count() == 0
    assert main_text.train(pages.limit(0)) == {}
