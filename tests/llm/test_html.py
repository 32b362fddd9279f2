"""Main text by density: against densities reckoned by their definition, and pages that are easily misread."""

import math
import re
import time

import pytest

from lumengraph.llm import html, queries

SF = "/root/testdata/sf0.001"
P = "<p>Some long paragraph of the article with plenty of words in it, so that it is dense.</p>"
TEXT = "Some long paragraph of the article with plenty of words in it, so that it is dense."

MISREAD = {
    "a name of other words is no sidebar": (f'<body><div class="layout with-sidebar"><div>{P * 4}</div><div class="sidebar"><p>Side text.</p></div></div></body>', [TEXT] * 4),
    "nor is its absence": (f'<body><div class="no-sidebar">{P * 4}</div></body>', [TEXT] * 4),
    "a quote in an unquoted value": (f"<body><p title=it's>first</p>{P * 3}</body>", ["first", *[TEXT] * 3]),
    "hidden as a word of a value": (f'<body><article><p title="a hidden gem">kept</p>{P}</article></body>', ["kept", TEXT]),
    "hidden as an attribute": (f'<body><article><p hidden="">gone</p><p style="display: none">gone</p>{P}</article></body>', [TEXT]),
    "listed words within names": (f'<body><article>{P}<section id="reply-to-critics">{P}</section><div class="search-results">{P}</div></article></body>', [TEXT] * 3),
    "a slash ends no element": (f"<body><article><p><a href=http://x/>link</a> text</p>{P}<div/>in</div></article></body>", ["link text", TEXT, "in"]),
    "letters that grow in lower case": (f'<body><script>x="İİİİ"</SCRIPT><article>{P}</article></body>', [TEXT]),
    "more comments than article": (f'<body><article><h1>T</h1>{P * 2}</article><section class="comments">{P * 9}</section></body>', ["T", TEXT, TEXT]),
    "no article element": (f'<body><div class=top><a href=a>A</a> <a href=b>B</a> <a href=c>C</a></div><h1>Title</h1><div>{P * 5}</div><div>{P * 3}</div><div class="site-footer">Imprint</div></body>', ["Title", *[TEXT] * 8]),
    "parts within the article": (f'<body><article><h1>T</h1><div class=body>{P * 5}</div><p>After</p><div class=ad>Buy</div><ul class="share"><li><a>x</a></li></ul></article></body>', ["T", *[TEXT] * 5, "After"]),
    "a form around the page": (f"<body><form id=all><div>{P * 3}</div><form><input><button>Go</button></form></form></body>", [TEXT] * 3),
    "one short paragraph": ("<body><nav><a>x</a></nav><article><p>One.</p></article><footer>f</footer></body>", ["One."]),
    "no element at all": ("just &amp; text", ["just & text"]),
}


@pytest.mark.parametrize("name", sorted(MISREAD))
def test_page(name):
    page, lines = MISREAD[name]
    assert html.main_text(page).split("\n") == lines


def slow_density(node, body):
    """The composite text density by its definition, each node counted anew."""

    def count(n):
        chars = tags = link_chars = link_tags = weighed = 0
        for x in n.items:
            if isinstance(x, str):
                own = len(re.sub(r"\s", "", x))
                chars, weighed = chars + own, weighed + own
            elif not x.unseen:
                c, t, lc, lt, w = count(x)
                chars, tags, link_chars, link_tags, weighed = chars + c, tags + t + 1, link_chars + lc, link_tags + lt, weighed + w
        if n.name == "a":
            link_chars, link_tags = chars, tags + 1
        return chars, tags, link_chars, link_tags, weighed * n.weight

    chars, tags, link_chars, link_tags, weighed = count(node)
    if not chars:
        return 0.0
    b = count(body)
    base = math.log(chars / max(1, chars - link_chars) * link_chars + b[2] / max(1, b[0]) * chars + math.e)
    return weighed / max(1, tags) * math.log(max(chars / max(1, link_chars) * max(1, tags) / max(1, link_tags), 1.0000001)) / base


def test_the_greatest_density_sum_is_chosen(spark):
    pages = [r.html for r in queries.table(spark, SF, "pages").limit(60).collect()] + [page for page, _ in MISREAD.values()]
    for page in pages:
        root = html.parse(page)
        best, path, threshold = html.chosen(root)
        nodes = html._nodes(root)
        body = next((n for n in nodes if n.name == "body"), root)
        sums = {id(n): sum(slow_density(x, body) for x in n.children()) for n in nodes}

        def weight(n):
            return n.weight * (weight(n.parent) if n.parent else 1)

        most = max(weight(n) * (sums[id(n)] or slow_density(n, body) * 1e-6) for n in nodes if n.chars)
        assert math.isclose(weight(best) * (sums[id(best)] or slow_density(best, body) * 1e-6), most, rel_tol=1e-9)
        assert path[0] is best and math.isclose(threshold, min(x.plain for x in path))


def test_the_choice_comes_through_density(monkeypatch):
    page = f"<body><div><h2>Menu</h2><ul>{'<li><a href=x>to go</a></li>' * 9}</ul></div><div>{P * 4}</div></body>"
    assert html.main_text(page).split("\n") == [TEXT] * 4

    def off(root):
        nodes = html._nodes(root)
        for n in nodes:
            n.chars = n.density = n.plain = 1.0
            n.sum = float(len(n.children()))
        return nodes

    monkeypatch.setattr(html, "measure", off)
    assert html.main_text(page).split("\n") != [TEXT] * 4


def test_time_grows_with_the_length():
    took = []
    for n in (10_000, 40_000):
        began = time.process_time()
        html.main_text("<div>" * n + "x")
        html.main_text("<b><p>x</p>" * n)
        html.main_text('<p a="' + "x" * n)
        took.append(time.process_time() - began)
    assert took[1] < 12 * took[0] + 1
