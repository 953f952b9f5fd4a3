import math
import random
import re
import time
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberlens.llm.html_extract import Page, extract_pages
from emberlens.llm.impact_search import top_k
from emberlens.llm.mixing import mix, source_targets


# ---- exact search


def brute_top(rows, k, scale=64, kind=np.float32):
    """A counter, as rows that repeat ask and answer once each."""
    fine = [(i, [math.floor(scale * float(kind(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = Counter()
    for a, (q, w) in enumerate(fine):
        if q % 20 == 0:
            scored = sorted((-sum(x * y for x, y in zip(w, v)), i) for b, (i, v) in enumerate(fine) if a != b)[:k]
            out.update((q, r + 1, i, min(max(-s, -(2**63)), 2**63 - 1)) for r, (s, i) in enumerate(scored))
    return out


@pytest.mark.parametrize("blocks", [(16_384, 8_192), (37, 3)])
def test_top_k_is_exact(spark, blocks):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(0, 0.12, 16)]) for i in range(300)]
    rows += [(i, rows[7][1]) for i in range(300, 340)] + [(400, None), (401, [0.1, None] + [0.0] * 14), (420, [float("nan")] * 16), (440, [float("inf")] * 16), (None, [0.1] * 16), (460, []), (480, [0.5, 0.5]), (480, [0.5, 0.25]), (500, [0.0] * 16)]
    rows += [rows[20]] * 3 + [rows[7]] * 2 + [(20, rows[8][1])]
    d = spark.createDataFrame([(i, v, 3, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, score string")
    for k in (20, 1, 500):
        got = top_k(d, F.col("id") % 20 == 0, k, index_block=blocks[0], query_block=blocks[1])
        assert Counter(tuple(r) for r in got.collect()) == brute_top(rows, k)
    assert top_k(d.limit(0), F.col("id") % 20 == 0).count() == 0


@pytest.mark.parametrize("size", [4e7, 3e12, 1e30, 1e200])
def test_large_components_stay_exact(spark, size):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(0, 1, 4) * (size if i % 3 else 1)]) for i in range(60)] + [(60, [size, 1.0]), (80, [-size, 1.0, 0.5])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = top_k(d, F.col("id") % 20 == 0, 9, index_block=25, query_block=2)
    assert Counter(tuple(r) for r in got.collect()) == brute_top(rows, 9, kind=float)


# ---- mixing


def test_targets_stop_at_three_times_the_size(spark):
    sizes = [("b", 10), (None, 1000), ("a", 100), ("é", 5), ("z", 0)]
    got = {r.source: r.target for r in source_targets(spark.createDataFrame(sizes, "source string, source_size long")).collect()}
    order = ["a", "b", "z", "é", None]
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    size, total = dict(sizes), sum(n for _, n in sizes)
    capped: set = set()
    while True:
        free = [s for s in order if s not in capped]
        level = (total - sum(3 * size[s] for s in capped)) / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if 3 * size[s] < level * weight[s]}
        if not over:
            break
        capped |= over
    assert got == pytest.approx({s: 3 * size[s] if s in capped else level * weight[s] for s in order})
    assert sum(got.values()) == pytest.approx(total)


def test_mix_reaches_its_targets(spark):
    rng = random.Random(5)
    rows = [(i, " ".join("w" * rng.randint(1, 3) for _ in range(rng.choice([1, 5, 50, 300]))), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(400)]
    rows += [(900, None, "a"), (901, "", "b"), (None, "x y", "c"), (7, "again here", "a"), (7, "again here", "a"), (902, "word " * 5000, "b")]
    d = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "doc_id long, text string, source string, taken int, target double")
    quality = spark.createDataFrame([(i, i % 2) for i in range(0, 400, 3)] + [(5, 1), (5, 0)], "doc_id long, quality int")
    a, b = (sorted(map(tuple, mix(d, quality).collect()), key=str) for _ in range(2))
    assert a == b and len(a) == len(rows)
    by: dict = {}
    for _, size, source_size, target, taken, source in a:
        assert 0 <= taken <= 3 * size
        t = by.setdefault(source, [0, 0, target, source_size])
        t[0] += taken
        t[1] += size
    for taken, size, target, source_size in by.values():
        assert size == source_size and abs(taken - target) <= 1
    assert mix(d.limit(0), quality).count() == 0 and mix(d.limit(0)).count() == 0


def test_quality_is_preferred(spark):
    d = spark.createDataFrame([(i, "w " * 10, "a" if i < 2000 else "b") for i in range(2400)], "doc_id long, text string, source string")
    q = spark.createDataFrame([(i, i % 2) for i in range(2400)], "doc_id long, quality int")
    got = mix(d, q).where("source = 'a' and taken > 0").join(q, "doc_id").groupBy("quality").count().collect()
    n = {r.quality: r["count"] for r in got}
    assert n[1] > 1.5 * n[0]


# ---- extraction

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var x="</p><article>";</script></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><!-- <p>no</p> -->
<div id="wrap"><div class="{cls}"><h2>Head &amp; line</h2><p>First   part<br>goes on.<p>Second <a href="#">link</a> &lt;b&gt; &#233;</p><form><p>mail</p></form>
<div class="ad-box">Buy</div><ul><li>one<li>two</ul><p hidden>gone</p></div><aside>side</aside><div id="comments"><p>{noise}</p></div></div>
<div class="cookie-notice">ok</div><footer>foot</footer></body></html>"""
BODY = "Head & line\nFirst part goes on.\nSecond link <b> é\none\ntwo"


def test_page_without_article():
    page = Page(PAGE.format(cls="post-12", noise="first! " * 200))
    assert page.text(page.best()) == BODY
    assert page.path(page.best()) == "body.has-sidebar/div/div.post-#"


def test_states_in_class_names_drop_nothing():
    html = '<body><div class="wrap has-sidebar no-comments"><article class="post comments-open"><p>kept</p></article><article class="comment"><p>said</p></article></div>'
    page = Page(html)
    assert page.text(page.best()) == "kept"


def test_broken_and_odd_pages():
    for html in ("", "plain text", "<p>", "<<<", "</div></p>", "<div><p>a", "<a href='x>y'>z", "<script>never closed", "<!-- open", "&amp", "<p>a<p>b</article></body>", "<table><tr><td>x<td>y</table>", "<b" * 3000):
        page = Page(html)
        page.text(page.best())
    assert (p := Page("plain &amp; text")).text(p.best()) == "plain & text"
    assert (p := Page("<article><p>a\u00a0 b<p>c</article><p>d")).text(p.best()) == "a b\nc"


def test_hosts_agree_on_a_path(spark):
    pages = [(i, f"http://h.org/{i}", PAGE.format(cls="post", noise="x")) for i in range(6)]
    # more text beside the post than in it, in a container that no other page of the host prefers
    decoy = PAGE.format(cls="post", noise="x").replace("<aside>", '<div class="promo-free"></div><section class="teaserless"><p>' + "decoy " * 300 + "</p></section><aside>")
    rows = [*pages, (50, "http://h.org/d", decoy), (51, None, "<article>alone</article>"), (52, "http://h.org/n", None), (53, "http://h.org/e", ""), (54, "http://h.org/o", "<main><p>other</p></main>"), (50, "http://h.org/d", decoy)]
    d = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    for limit in (10, 0):
        got = extract_pages(d, broadcast_hosts=limit).collect()
        by = {r.page_id: r.text for r in got}
        assert len(got) == len(rows)
        assert all(by[i] == BODY for i in range(6)) and by[50] == BODY
        assert (by[51], by[52], by[53], by[54]) == ("alone", "", "", "other")
        assert all(r.n_chars == len(r.text) for r in got)
    assert extract_pages(d.limit(0)).count() == 0


def test_text_beside_the_largest_child_stays():
    page = Page('<body><nav>site</nav><h1>Title</h1><p>lead</p><div class="body"><p>' + "text " * 100 + "</p></div><footer>foot</footer></body>")
    assert page.text(page.best()) == "Title\nlead\n" + ("text " * 100).strip()


def test_all_elements_at_the_winning_path(spark):
    one = '<body><div class="wrap"><div class="section"><p>{}</p></div></div></body>'
    three = '<body><div class="wrap">' + "".join(f'<div class="section"><p>{t}</p></div>' for t in ("first part", "second", "the third of them")) + "</div></body>"
    rows = [(i, f"http://s.org/{i}", one.format("alone " * 50)) for i in range(3)] + [(9, "http://s.org/9", three)]
    got = extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).where("page_id = 9").first()
    assert got.text == "first part\nsecond\nthe third of them"


def test_words_decide_only_where_they_say_all():
    kept = ["social-history", "legal-analysis", "search-results-study", "notice-of-appeal", "ad-hoc-query", "cookie-recipe", "menuHistory", "byline", "meta", "tags", "copyright", "share-of-market"]
    gone = ["ad", "ad-300x250", "cookie-notice", "siteNav", "comment-list", "comments", "newsletter-signup", "post-comments", "article-sidebar", "search-box", "site-footer"]
    html = "<article>" + "".join(f'<section class="{c}"><p>text of {c}</p></section>' for c in kept + gone) + "<p>Let <math>x</math> be <button>pressed</button></p></article>"
    page = Page(html)
    assert page.text(page.best()) == "\n".join([f"text of {c}" for c in kept] + ["Let x be pressed"])


def test_long_quoted_values_leak_nothing():
    for n in (1, 1999, 2000, 2001, 70_000):
        page = Page(f'<article><p data-x="{"a" * n}> leaked text" class=\'b"c>d\'>kept</p></article>')
        assert page.text(page.best()) == "kept"
    for broken in ("<a \"'" * 30_000, '<a "' * 40_000, "<a b='" * 40_000, "<" * 100_000):
        began = time.perf_counter()
        Page(broken)
        assert time.perf_counter() - began < 10


def test_weak_words_need_evidence(spark):
    page = '<article><p>{}</p><div class="byline">{}</div><div class="share"><a href="#">post it</a></div><p class="tags">{}</p></article>'
    rows = [(i, f"http://a.org/{i}", page.format(f"story {i}", "By our staff", f"tags of {i}")) for i in range(4)]
    rows += [(10 + i, f"http://b.org/{i}", page.format(f"tale {i}", f"By writer {i}", "news")) for i in range(2)]
    got = {r.page_id: r.text for r in extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"story {i}\ntags of {i}" for i in range(4)} | {10 + i: f"tale {i}\nBy writer {i}\nnews" for i in range(2)}


class Plain(HTMLParser):
    """A second extractor for well-formed pages: blocks of the article outside of what is left out."""

    def __init__(self, drop):
        super().__init__(convert_charrefs=True)
        self.stack, self.blocks, self.drop = [], [""], drop

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.blocks[-1] += " "
            return
        self.stack.append((tag, self.drop(tag, dict(attrs))))
        if tag not in ("b", "i", "a", "span", "math"):
            self.blocks.append("")

    def handle_endtag(self, tag):
        if self.stack.pop()[0] not in ("b", "i", "a", "span", "math"):
            self.blocks.append("")

    def handle_data(self, data):
        if any(t == "article" for t, _ in self.stack) and not any(d for _, d in self.stack):
            self.blocks[-1] += data


def test_extraction_agrees_with_a_plain_extractor_and_with_what_was_written(spark):
    rng = random.Random(9)
    noise = ['<nav><a href="/">home</a></nav>', '<div class="ad">buy &amp; save</div>', '<aside class="x">side</aside>', '<form><p>name</p></form>', "<script>var a='<p>no</p>';</script>", '<div class="cookie-notice">ok</div>', '<section class="comments"><p>first!</p></section>', '<p hidden="hidden">unseen</p>', "<footer>end</footer>", "<style>p{}</style>"]
    left_out = lambda tag, attrs: tag in ("nav", "aside", "form", "script", "style", "footer") or attrs.get("class") in ("ad", "cookie-notice", "comments") or "hidden" in attrs
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 8)))
    rows, want = [], {}
    for i in range(60):
        body, truth = [], []
        for _ in range(rng.randint(1, 8)):
            words = [word() for _ in range(rng.randint(1, 30))]
            if rng.random() < 0.4:
                body.append(rng.choice(noise))
            marked = [f"<b>{w}</b>" if rng.random() < 0.1 else f"{w} &lt; {w}<br>" if rng.random() < 0.05 else w for w in words]
            truth.append(" ".join(" ".join(re.sub("<[^>]*>", "", m).replace("&lt;", "<") for m in marked).split()))
            body.append(rng.choice(["<p>{}</p>", "<div class='body'><p>{}</p></div>", "<ul><li>{}</li></ul>", "<h2>{}</h2>", "<p class=\"legal-analysis\">{}</p>"]).format("  \n".join(marked)))
        rows.append((i, f"http://h{i % 3}.org/{i}", "<html><body>" + rng.choice(noise) + "<article>" + "".join(body) + "</article>" + rng.choice(noise) + "</body></html>"))
        want[i] = "\n".join(truth)
        plain = Plain(left_out)
        plain.feed(rows[-1][2])
        assert "\n".join(b for b in (" ".join(x.split()) for x in plain.blocks) if b) == want[i]
    got = {r.page_id: r.text for r in extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want
