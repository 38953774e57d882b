"""HTML extraction: the block reader by cases, the labeller's gradients, and accuracy on pages held out."""

import time

import numpy as np
import pytest

from quarry.llm import html


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("", []),
        ("<p>a &amp; b<br>c</p><p>d\n  e", ["a & b c", "d e"]),
        ("<script>var a = '<p>no</p>'</script><p>yes<!-- <p>no --></p>", ["yes"]),
        ("<p>one<script>", ["one"]),
        ("<p>one<!-- never ends <p>two", ["one"]),
        ("<div>a<b>b</b>c<p>d</div>e", ["abc", "d", "e"]),
        ("<ul><li>a<li>b</ul>", ["a", "b"]),
        ("<a title='x > y'>link</a> text", ["link text"]),
        ("a &lt;p&gt; b &#233; &unknown; c", ["a <p> b é &unknown; c"]),
        ("1 < 2 and 3 > 2", ["1 < 2 and 3 > 2"]),
        ("<table><tr><td>a<td>b<tr><td>c</table>", ["a", "b", "c"]),
        ("<p>a<a href=\"x>b</a>c</p><p title='>'>d", ["abc", "d"]),
        ("<p>one</p>two <b three", ["one", "two <b three"]),
        ("<p>one <b <!-- no > --> two", ["one --> two"]),
        ("<p>a</p><SCRIPT src='x>'>no</Script ><p>b<!doctype no><?no?></p>", ["a", "b"]),
    ],
)
def test_blocks(page, want):
    assert [t for _, t, _ in html.blocks(page)] == want


def test_paths():
    (path, _, linked), *_ = html.blocks('<body><div class="Side Bar" id=x><p>in <a href="/">link</a></div>')
    assert path == ("body", "div side bar x", "p") and linked == 4


@pytest.mark.parametrize("piece", ['<a href="', "<script", "<a \"> \"", "<a<a", "<!-", "<div>", "<p>x</p>", "<li><div>", "</x>", "<a '\">", "<p class='a'>x<b "])
def test_time_is_in_proportion_to_length(piece):
    def took(n):
        page = piece * (n // len(piece)) + "'"
        began = time.perf_counter()
        html.blocks(page)
        return time.perf_counter() - began

    took(1000)
    assert took(400_000) < 5  # a hundredth of what it is if time grows with the square


def test_long_pages_are_labelled_as_whole_ones(model, monkeypatch):
    rng = np.random.default_rng(5)
    pages = [html.made_up(rng)[0] for _ in range(12)]
    want = model.label(pages)
    monkeypatch.setattr(html, "SEGMENT", 7)
    assert all((a == b).all() for a, b in zip(model.label(pages), want, strict=True))


def test_gradients():
    rng = np.random.default_rng(0)
    model = html.Labeller()
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    x, keep, y = rng.normal(0, 1, (4, 3, html.SIZE)), np.ones((4, 3), bool), rng.integers(0, 2, (4, 3)).astype(float)
    keep[2:, 1] = False

    def loss():
        z = model.logits(x, keep)
        return float((np.logaddexp(0, z) - y * z)[keep].sum() / keep.sum())

    grad = model.gradients(x, keep, y)
    for name, g in grad.items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old = model.p[name][at]
        model.p[name][at] = old + 1e-3
        up = loss()
        model.p[name][at] = old - 1e-3
        down = loss()
        model.p[name][at] = old
        assert g[at] == pytest.approx((up - down) / 2e-3, rel=2e-2, abs=1e-5)


@pytest.fixture(scope="module")
def model():
    return html.trained()


def test_accuracy_on_pages_held_out(model):
    rng = np.random.default_rng(77)
    pages = [html.made_up(rng) for _ in range(150)]
    found = model.label([p for p, _ in pages])
    right = np.concatenate([f == np.array(y, bool) for f, (_, y) in zip(found, pages, strict=True)])
    assert right.mean() >= 0.97


def test_extract(spark, sf_dir, model):
    from quarry.sources.tables import table

    pages = table(spark, sf_dir, "pages")
    got = {r.page_id: r for r in html.extract(pages, model).collect()}
    for r in pages.collect():
        inside = r.html.split("<article>", 1)[1].split("</article>")[0]
        want = "\n\n".join(t for _, t, _ in html.blocks(inside))
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want)


def article_by_force(page):
    """The article's blocks by the standard library's parser: text between tags that aren't inline, white space as one space."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.blocks, self.text, self.inside = [], "", False

        def flush(self):
            if text := " ".join(self.text.split()):
                self.blocks.append(text)
            self.text = ""

        def handle_starttag(self, tag, attrs):
            if tag == "br":
                self.text += " "
            elif tag not in ("b", "i", "a", "em", "strong", "span", "u"):
                self.flush()
            self.inside |= tag == "article"

        def handle_endtag(self, tag):
            if tag not in ("b", "i", "a", "em", "strong", "span", "u", "br"):
                self.flush()
            if tag == "article":
                self.inside = False

        def handle_data(self, data):
            if self.inside:
                self.text += data

    r = Reader()
    r.feed(page)
    r.flush()
    return "\n\n".join(r.blocks)


def test_extract_is_an_independent_parsers_text(spark, sf_dir, model):
    from quarry.sources.tables import table

    pages = table(spark, sf_dir, "pages")
    got = {r.page_id: r.text for r in html.extract(pages, model).collect()}
    assert got == {r.page_id: article_by_force(r.html) for r in pages.collect()} and len(got) == 50


def test_columns_with_names_of_its_own(spark, model):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, "u", "<html><body><article><h1>A title here</h1><p>Some words of a text that is long enough to be one.</p></article></body></html>")], "page_id long, url string, html string")
    want = html.extract(df, model).first()
    for c in ("text", "n_chars", "blocks", "label", "leaf", "segment"):
        df = df.withColumn(c, F.lit("clash"))
    assert html.extract(df, model).first().text == want.text != ""


def test_extract_cases(spark, model):
    page = (
        '<html><body><header class="site-header"><p>Brand name</p></header><div id="cookie-notice">We use cookies</div><div class="post-content"><h1>A title</h1><p>First words of it, and more of them follow here.</p>'
        '<p>Second part of the text, which is longer than the first one was.</p></div><div class="sidebar"><ul><li><a href="/">Other</a></li></ul></div>'
        '<section class="comments"><p>I say no to that, it is not so.</p></section><form class="newsletter"><label>Mail</label></form><footer>All rights</footer></body></html>'
    )
    rows = [(1, "u", page), (1, "u", page), (2, None, None), (3, "u", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = [(r.page_id, r.text, r.n_chars) for r in html.extract(df, model).orderBy("page_id").collect()]
    want = "A title\n\nFirst words of it, and more of them follow here.\n\nSecond part of the text, which is longer than the first one was."
    assert got == [(1, want, len(want)), (1, want, len(want)), (2, "", 0), (3, "", 0)]
    assert html.extract(df.limit(0), model).count() == 0
