import random
import time

import pytest

from lakeloom.llm import html_text as ht

CASES = [
    ("<p>a<p>b", "a\n\nb"),
    ("<div>a</div><div>b</div>c", "a\nb\nc"),
    ("<ul><li>a<li>b<ul><li>c</ul></ul>d", "- a\n- b\n  - c\n\nd"),
    ("<ol start=9><li>a</li><li>b<br>c</li></ol>", "9. a\n10. b\n    c"),
    ("<table><tr><td>ab<td>c<tr><td>d<td>efg</table>", "ab  c\nd   efg"),
    ("<table><tr><th colspan=2>wide heading<th>z<tr><td>a<td>b<td>c</table>", "wide heading  z\na  b  c"),
    ("<pre>  x\n    y</pre>z", "  x\n    y\n\nz"),
    ("a<script>var x = '<p>no</p>';</script><style>p{}</style><!-- no -->b", "ab"),
    ('<p hidden>no</p><p style="display: NONE">no</p><input type=hidden value=no>yes', "yes"),
    ("<details><summary>s</summary>no<p>no</p></details><details open><summary>t</summary>yes</details>", "s\nt\nyes"),
    ("1 < 2 &amp;&lt;&eacute;&nbsp;x", "1 < 2 &<é x"),
    ("<head><title>no</title></head><body>yes", "yes"),
    ("a</p>b</div></table>c", "a\n\nbc"),
    ("", ""),
    ("a<unclosed", "a"), ("a<b title='no>no", "a"), ("a</ no>b</>c<>d<1", "abc<>d<1"), ("a<!-->b<!--->c<!no>d<?no>e", "abcde"), ("<p title=it's>yes", "yes"), ("<p title='a>b' data-x=\"c>d\">yes", "yes"),
    ("<table><tr><td colspan=5>a<td>b<tr><td>ccc<td colspan=4>d<td>e</table>", "a       b\nccc  d  e"),
    ("a <b>bold</b><i>it</i> \n c", "a boldit c"),
]


HEADS = [
    ("<html><head><title>T</title><p>text<p>more", "text\n\nmore"),
    ("<head><meta charset=utf-8><link rel=x><script>no</script>\n text <b>b</b>", "text b"),
    ("<head><style>no</style><noscript><img src=x></noscript><template><p>no</p></template><h1>yes</h1>no head", "yes\n\nno head"),
    ("<head>\n<title>no</title>\n</head>yes", "yes"),
    ("<p>a<head>b</head>c", "abc"),
]
FOREIGN = [
    ("a<svg>no<title>no</title><desc>no</desc><g><text x=1>one <tspan>two</tspan></text><path d='M0'/><text>three</text></g></svg>b", "a\none two\nthree\nb"),
    ("<svg><defs/><text>yes</text><defs><text>no</text></defs><style/><text>too</text><text display=none>no</text></svg>", "yes\ntoo"),
    ("<svg><foreignObject><p>in</p><div/>html</foreignObject></svg>", "in\n\nhtml"),
    ("<svg><path><p>broken out", "broken out"),
    ("<svg><text><![CDATA[a<b & c>]]></text></svg>", "a<b & c>"),
    ("so <math><semantics><mrow><mi>x</mi><mo>=</mo><mn>1</mn></mrow><annotation>no</annotation></semantics></math> holds", "so x=1 holds"),
    ("a <object data=x><param name=y>fallback</object> b", "a fallback b"),
]
VISIBLE = [
    ("<div style='visibility:hidden'>no<p style='visibility: visible'>yes <b style='visibility:collapse'>no</b></p>no</div>", "yes"),
    ("<div style='display:none'>no<p style='visibility:visible'>no</p></div>yes", "yes"),
    ("<p style='visibility:hidden;visibility:visible'>yes</p><p style='backface-visibility:hidden'>too</p>", "yes\n\ntoo"),
    ("<ul style='visibility:hidden'><li>no<li style='visibility:visible'>yes</ul>", "- yes"),
    ("<table><tr style='visibility:hidden'><td>no<td style='visibility:visible'>b<tr><td>c<td>d</table>", "   b\nc  d"),
    ("<svg visibility=hidden><text>no</text><text visibility=visible>yes</text></svg>", "yes"),
]


@pytest.mark.parametrize(("html", "text"), CASES + HEADS + FOREIGN + VISIBLE)
def test_render(html, text):
    assert ht.render(html) == text


HARD = {
    "tags without end": lambda n: "<a " * n,
    "quotes without end": lambda n: "<a b='" * n,
    "items under inline tags": lambda n: "<ul>" + "<b>" * n + "<li>x</li>" * n,
    "blocks behind a scope": lambda n: "<p><button>" + "<b>" * n + "<div></div>" * n,
    "end tags behind a wall": lambda n: "<x><table><td>" + "<b>" * n + "</x>" * n,
    "rows under inline tags": lambda n: "<table>" + "<b>" * n + "<tr><td>x" * n,
    "wide cells": lambda n: "<table><tr>" + "<td colspan=1000>x" * n,
    "deep blocks": lambda n: "<div><ul><li><table><tr><td>" * (n // 20) + "x",
    "foreign": lambda n: "<svg><g>" * n + "<math>" * n + "<p>x",
    "mismatched": lambda n: "<b>" * n + "</i>" * n,
    "long cell": lambda n: "<table><tr><td>" + "x" * n * 10 + "<td>y" + "<tr><td>a<td>b" * n,
}


@pytest.mark.parametrize("name", HARD)
def test_hard_pages_stay_linear(name):
    def took(n):
        began = time.process_time()
        out = ht.render(HARD[name](n))
        return time.process_time() - began, len(out)

    short, long = took(5_000), took(40_000)
    # Eight times the page; a square would be sixty-four times the work.
    assert long[0] < 24 * max(short[0], 0.02) and long[1] <= 24 * max(short[1], 100)


def test_a_megabyte_of_open_tags_and_a_hundred_thousand_items():
    began = time.process_time()
    assert ht.render("x" + "<a " * 350_000) == "x"
    assert ht.render("<ul>" + "<b>" * 1000 + "<li>x</li>" * 100_000).count("- x") == 100_000
    assert time.process_time() - began < 60


# A second, naive rendering: random trees are rendered by recursion over their nodes, and written out with and without the tags that may be left out.


def tree(rng, depth=0):
    kinds = ["text", "p", "div", "ul", "ol", "b", "hidden", "none"] if depth < 4 else ["text"]
    kind = rng.choice(kinds)
    if kind == "text":
        return ("text", " ".join(rng.choices(["one", "two", "three", "x"], k=rng.randint(1, 3))))
    if kind in ("ul", "ol"):
        return (kind, [("li", [tree(rng, depth + 2) for _ in range(rng.randint(1, 3))]) for _ in range(rng.randint(1, 3))])
    if kind in ("p", "b"):
        return (kind, [("text", rng.choice(["p", "q", "r s"])) for _ in range(rng.randint(1, 2))])
    return (kind, [tree(rng, depth + 1) for _ in range(rng.randint(1, 3))])


def written(node, full):
    kind, inside = node
    if kind == "text":
        return inside
    body = "".join(written(x, full) for x in inside)
    if kind in ("hidden", "none"):
        return f"<div hidden>{body}</div>" if kind == "hidden" else f'<section style="display:none">{body}</section>'
    return f"<{kind}>{body}" + (f"</{kind}>" if full or kind not in ("p", "li") else "")


def naive(nodes, inside_item=False):
    """Lines of nodes: a list of strings, with None where a blank line is due."""
    lines, line = [], ""

    def flush():
        nonlocal line
        if line.strip():
            lines.append(" ".join(line.split()))
        line = ""

    for kind, inside in nodes:
        if kind in ("text", "b"):
            line += inside if kind == "text" else "".join(x for _, x in inside)
        elif kind not in ("hidden", "none"):
            flush()
            gap = [None] if kind == "p" or (kind in ("ul", "ol") and not inside_item) else []
            lines += gap
            if kind in ("ul", "ol"):
                shown = 0
                for _, item in inside:
                    shown += 1
                    mark = "- " if kind == "ul" else f"{shown}. "
                    rows = squeezed(naive(item, True))
                    if rows:
                        lines += [mark + rows[0], *(" " * len(mark) + x if x else "" for x in rows[1:])]
            else:
                lines += naive(inside, inside_item)
            lines += gap
    flush()
    return lines


def squeezed(lines):
    """Lines with one blank line where any was due between two of them."""
    out, due = [], False
    for x in lines:
        if x is None:
            due = True
            continue
        out += [""] if due and out else []
        out.append(x)
        due = False
    return out


def test_rendering_equals_a_naive_one():
    rng = random.Random(5)
    for _ in range(1500):
        nodes = [tree(rng) for _ in range(rng.randint(1, 4))]
        want = "\n".join(squeezed(naive(nodes)))
        for full in (True, False):
            page = "".join(written(x, full) for x in nodes)
            if full or not any(a[0] == "p" and b[0] in ("text", "b") for a, b in neighbours(nodes)):
                assert ht.render(page) == want, page


def neighbours(nodes):
    """Every two nodes that follow each other: text behind an open paragraph would be read as its own."""
    for kind, inside in nodes:
        if kind not in ("text",):
            yield from neighbours(inside)
    yield from zip(nodes, nodes[1:])


def test_report(spark, sf_dir):
    df = spark.createDataFrame([(1, "<p>a", "t"), (2, None, "t"), (3, "", "t"), (1, "<p>a", "t")], "page_id long, html string, text string")
    out = ht.report(df).collect()
    assert len(out) == 4 and {(r.page_id, r.text, r.n_lines) for r in out} == {(1, "a", 1), (2, None, 0), (3, "", 0)}
    assert ht.report(df.limit(0)).count() == 0
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    assert all("<article" not in r.text and r.n_chars > 0 for r in ht.report(pages).collect())
