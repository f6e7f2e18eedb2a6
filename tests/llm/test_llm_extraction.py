"""HTML extraction: parsing, the chain against enumeration, held-out pages."""

import random
import re
import time
from itertools import product

import numpy as np
import pytest

from lakefind.llm import extraction as X

WORDS = [f"word{k}" for k in range(400)]


@pytest.fixture(scope="module")
def chain():
    return X.fit_chain(WORDS, pages=250)


def texts(page):
    return [b.text for b in X.leaf_blocks(page)]


def test_leaf_blocks():
    page = ("<!DOCTYPE html><html><head><title>no</title><style>p{}</style></head><body>a &amp; b&nbsp;c<p>one <b>two</b>three"
            "<br>four<p>five<ul><li>x<li>y</ul><script>var t='</p>';</script><!-- no <p> --><td>cell<td>next</table>"
            '<a title="a>b" href=x>link</a> tail<textarea>no</textarea><h1> big\n\t title </h1>&#233;&lt;i&gt;')
    assert texts(page) == ["a & b c", "one twothree four", "five", "x", "y", "cell", "next", "link tail", "big title", "é<i>"]
    assert texts("") == [] and texts("<p></p><br>") == [] and texts("plain") == ["plain"]
    assert texts("<p>open <b>end") == ["open end"] and texts("a < b <> c") == ["a < b <> c"]
    assert texts("<script>never closed <p>x") == []


def test_head_without_end_tag():
    head = "<html><head><meta charset=utf-8><title>t</title><style>p{}</style><script>x</script><template><p>no</p></template>"
    for start in ("<body><article>", "<article>", "<BODY class=a>", "\n<div>", "</head><body>"):
        assert texts(f"{head}{start}<p>Hi</p>") == ["Hi"]
    assert texts(head + "Hi <b>there</b><p>x") == ["Hi there", "x"] and texts(head + "<noscript><link></noscript>") == []


def test_mathematics_and_fallback_text_stay():
    page = ("<article><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be <object>an object</object> <canvas>drawn</canvas> "
            "<audio>heard</audio> <video src=v>seen</video></p><noscript><p>no script</p></noscript><select><option>one</select>")
    assert texts(page) == ["Let x=1 be an object drawn heard seen", "no script", "one"]
    assert texts("<p>a<svg><text>no</text></svg><iframe>no</iframe><textarea>no</textarea>b") == ["ab"]


DIRECT = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<[!?/][^>]*>""", re.S)


def test_tags_against_the_direct_pattern():
    rng = random.Random(4)
    pieces = ["<", ">", '"', "'", "/", "!", "--", "a", "b ", "=", " ", "<a ", "</b", "<!--", "-->", '<p x="', "<i y='"]
    for _ in range(4000):
        page = "".join(rng.choices(pieces, k=rng.randint(1, 40)))
        want = [(m.start(), m.end(), m[1] == "/", m[2].lower(), m[3]) if m[2] else (m.start(), m.end(), False, "", "")
                for m in DIRECT.finditer(page)]
        found, tags, at = [], X.Tags(page), 0
        while (tag := tags.after(at)) is not None:
            found.append(tag)
            at = tag[1]
        assert found == want, page


def test_hostile_pages_take_linear_time():
    n = 200_000  # by the square of the length any of these would take minutes
    pages = ['<a b="' * n, "<a '<b \"" * n, "<a<" * n, "<!" * n, "<b>" * n + "</i>" * n, "<b>" * n + "<hr>" * n,
             "<li><ul>" + "<b>" * n + "<li/>" * n, "<div>x" * n,
             "".join(f"<div class=n{'x' * (k % 40)}>x" for k in range(n))]
    start = time.process_time()
    for page in pages:
        X.features(X.leaf_blocks(page), {"in:div", "name:n"})
    assert time.process_time() - start < 60
    assert texts('<a b="' * 3) == ['<a b="' * 3] and texts("<b>" * 9 + "</i>x" * 9) == ["x" * 9]


def test_decimal_references_of_any_length():
    assert texts("&#" + "9" * 6000 + ";&#" + "0" * 6000 + "65;&#000066 c") == ["\ufffdAB c"]


def test_known_ancestor_features_are_the_same_rows(chain):
    page, _ = X.labelled_page(random.Random(9), WORDS)
    blocks = X.leaf_blocks(page)
    assert chain.rows(X.features(blocks)) == chain.rows(X.features(blocks, chain.index))


def test_links_and_ancestors():
    b = X.leaf_blocks('<div class="Side-Bar x"><p>ab <a href=1>cdef</a></p></div>')[0]
    assert b.linked == 4 and b.path == (("div", ("side", "bar", "x")), ("p", ()))


def test_viterbi_and_sums_match_enumeration(chain):
    page, _ = X.labelled_page(random.Random(8), WORDS)
    blocks = X.leaf_blocks(page)[:9]
    rows = chain.rows(X.features(blocks))

    def score(labels):
        s = sum(chain.emit[ids, y].sum() for ids, y in zip(rows, labels, strict=True))
        return s + sum(chain.step[a, b] for a, b in zip(labels, labels[1:], strict=False))

    best = max(product((0, 1), repeat=len(blocks)), key=score)
    assert score(tuple(chain.decode(blocks))) == pytest.approx(score(best))


def test_gradient_step_raises_the_likelihood():
    rng, pages = random.Random(2), []
    for _ in range(6):
        page, labels = X.labelled_page(rng, WORDS)
        pages.append((X.features(X.leaf_blocks(page)[:7]), labels[:7]))
    names = sorted(set().union(*(f for found, _ in pages for f in found)))

    def likelihood(c):
        total = 0.0
        for found, labels in pages:
            rows = c.rows(found)
            each = [sum(c.emit[ids, y].sum() for ids, y in zip(rows, ys, strict=True))
                    + sum(c.step[a, b] for a, b in zip(ys, ys[1:], strict=False))
                    for ys in product((0, 1), repeat=len(labels))]
            gold = sum(c.emit[ids, y].sum() for ids, y in zip(rows, labels, strict=True)) + sum(
                c.step[a, b] for a, b in zip(labels, labels[1:], strict=False))
            total += gold - np.logaddexp.reduce(each)
        return total

    values = [likelihood(X.Chain(names).fit(pages, rounds=r)) for r in (1, 10, 60)]
    assert values[0] < values[1] < values[2] and values[2] > -0.5


def test_held_out_frames(chain):
    rng, wrong, total = random.Random(123), 0, 0
    for _ in range(200):
        page, labels = X.labelled_page(rng, WORDS)
        blocks = X.leaf_blocks(page)
        assert len(blocks) == len(labels)
        wrong += sum(a != b for a, b in zip(chain.decode(blocks), labels, strict=True))
        total += len(labels)
    assert wrong <= 0.01 * total


def test_odd_pages(spark, chain):
    article = "<body><nav><ul><li><a href=/a>a</a></ul></nav><article><h1>Title</h1><p>Some text here.</p></article><footer>&copy; x</footer>"
    rows = [(1, "u", None), (2, "u", ""), (3, None, article), (3, None, article), (None, "u", article), (4, "u", "<p>" + "word " * 50_000),
            (5, "u", "<article><h1>Title</h1><p>" + "word " * 49_999 + "word.</p></article>")]
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id bigint, url string, html string, row string, text string")
    out = [(r["page_id"], r["text"]) for r in X.extract(pages, chain).select("row.page_id", "text").collect()]
    assert out[:5] == [(1, ""), (2, ""), (3, "Title\n\nSome text here."), (3, "Title\n\nSome text here."),
                       (None, "Title\n\nSome text here.")]
    long = ("word " * 50_000).strip()
    assert out[5:] == [(4, ""), (5, f"Title\n\n{long}.")]  # one bare block without a frame or a full stop is not an article
    assert X.extract(pages.limit(0), X.fit_chain(X.sample_words(pages.limit(0)), pages=20)).count() == 0


@pytest.mark.skipif(not __import__("llm_cases").HAVE_TABLES, reason="no test tables")
def test_given_pages_give_their_articles(spark):
    import html
    import re

    from lakefind.plans.registry import QUERIES

    sf = "/root/testdata/sf0.001"
    want = {}
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        body = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", "", re.sub("<br>", " ", x))).split())
                 for x in re.split("</?(?:p|h1)>", body)]
        want[r["page_id"]] = "\n\n".join(x for x in parts if x)
    got = {r["page_id"]: r for r in QUERIES["op7_html_extraction"](spark, sf).collect()}
    assert {k: r["text"] for k, r in got.items()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())
