import random
import time
from math import e, log

import pytest

from starlace.llm.html_text import Tree, content, densities, extract, extract_pages

PAGE = """<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">one</a></li><li><a href="/b">two</a></li></ul></nav>
<!-- ad --><div class="ad">Buy this now.</div><article><h1>Head</h1><p>First &eacute; paragraph of the article, with words.<p>Second <b>bold</b> one<br>goes on for a while here.</p><ul><li>item one of some length<li>item two of some length</ul></article><footer>&copy; foot</footer></body></html>"""


def test_article():
    assert extract(PAGE) == "Head\nFirst é paragraph of the article, with words.\nSecond bold one\ngoes on for a while here.\nitem one of some length\nitem two of some length"


@pytest.mark.parametrize("page,text", [
    (None, ""), ("", ""), ("<p>", ""), ("plain &lt;b&gt;", "plain <b>"), ("<p></p></div>x", "x"), ("<!-- open", ""), ("<script>a</script>", ""), ("<div>a<div>b", "a\nb"), ("<b>" * 3000 + "deep", "deep"), ("a < b and c", "a < b and c"),
])
def test_odd_pages(page, text):
    assert extract(page) == text


def naive(tree):
    """Each node by itself, all below it counted anew."""
    n = len(tree.tag)
    below = lambda k: [j for j in range(n) if k <= j <= tree.last[k]]

    def linked(j):
        while j > 0:
            if tree.tag[j] == "a":
                return True
            j = tree.parent[j]
        return False

    size = lambda some: sum(len("".join(t.split())) for j, t in tree.pieces if j in some)
    body = tree.tag.index("body") if "body" in tree.tag else 0
    c_b, l_b = size(set(below(body))), size({j for j in below(body) if linked(j)})
    density = []
    for k in range(n):
        some = below(k)
        c, lc = size(set(some)), size({j for j in some if linked(j)})
        t, lt = len(some) - 1, sum(linked(j) for j in some[1:])
        if not c:
            density.append(0.0)
            continue
        base = log(c / max(1, c - lc) * lc + l_b / max(1, c_b) * c + e)
        density.append(max(0.0, c / max(1, t) * log(c / max(1, lc) * max(1, t) / max(1, lt)) / log(base)) if log(base) > 0 else 0.0)
    total = [sum(density[j] for j in range(1, n) if tree.parent[j] == k) for k in range(n)]
    top = max(below(body), key=lambda k: (total[k], -k))
    path = [top]
    while path[-1] != body:
        path.append(tree.parent[path[-1]])
    threshold = min(density[k] for k in path)
    marked = set()

    def visit(k):
        if density[k] >= threshold and density[k] > 0:
            best = max(below(k), key=lambda j: (total[j], -j))
            if total[best] > 0:
                marked.add(best)
            for j in range(1, n):
                if tree.parent[j] == k:
                    visit(j)

    visit(body)
    marked = marked or {body}
    return density, total, sorted(k for k in marked if not any(j != k and j < k <= tree.last[j] for j in marked))


def test_against_brute_force():
    r = random.Random(8)

    def make(depth):
        if depth == 0 or r.random() < 0.3:
            return "w" * r.randint(0, 30) + " "
        tag = r.choice(["div", "div", "span", "a", "section", "b"])
        return f"<{tag}>" + "".join(make(depth - 1) for _ in range(r.randint(0, 4))) + f"</{tag}>"

    for _ in range(60):
        tree = Tree("<body>" + "".join(make(4) for _ in range(4)) + "</body>")
        if not tree.pieces:
            continue
        density, total, body = densities(tree)
        d, t, marked = naive(tree)
        assert density == pytest.approx(d) and total == pytest.approx(t) and content(tree) == marked


def test_table(spark):
    rows = [(1, "u", PAGE), (2, None, None), (None, "u", ""), (1, "u", PAGE), (3, "u", "<p>" + "long " * 200_000)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = extract_pages(pages).collect()
    assert len(got) == 5 and {r.text for r in got if r.page_id == 1} == {extract(PAGE)} and [r.text for r in got if r.page_id == 2] == [""]
    assert len(next(r.text for r in got if r.page_id == 3)) == 999_999
    assert extract_pages(pages.limit(0)).count() == 0
    clash = pages.withColumnRenamed("url", "text")
    assert extract_pages(clash).columns == ["page_id", "html", "text"]


@pytest.mark.parametrize("page", [
    lambda k: "<a " * k, lambda k: "<b>" * k + "</i>" * k, lambda k: '<a "' * (k | 1), lambda k: "<a '\"" * k + ">x", lambda k: "<div>" * k + "<li></li>" * k, lambda k: "<p><td>" + "<b>" * k + "<div></div>" * k, lambda k: "<a" * k + ' ">x', lambda k: "<!" * k,
])
def test_broken_pages_take_time_in_proportion(page):
    def seconds(k):
        began = time.process_time()
        extract(page(k))
        return time.process_time() - began

    small, large = (min(seconds(k) for _ in range(3)) for k in (50_000, 200_000))
    assert large < 2.5**2 * small + 0.1


def test_tags_that_end_silent_ones_end_silence():
    assert extract("<table><tr><select><option>no<tr><td>seen</table>") == "seen"
    assert extract("<a href='x>y") == "<a href='x>y" and extract("a < b <1> c") == "a < b <1> c"
