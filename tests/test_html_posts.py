"""The page helper on hand-made pages."""

import random
import re
import time
from html import escape

import pytest

from feedsieve.operators.html_posts import PostFinder, SelectorSpec, parse_selector


def post(urn="urn:li:activity:1", content="text", title="Jane", css="feed-shared-update-v2"):
    attribute = "" if urn is None else f' data-urn="{urn}"'
    parts = "" if title is None else f'<span class="update-components-actor__title">{title}</span>'
    parts += "" if content is None else f'<span class="break-words">{content}</span>'
    return f'<div class="{css}"{attribute}>{parts}</div>'


def find(html, **spec):
    return PostFinder(SelectorSpec(**spec)).find(html)


def test_posts_in_document_order():
    html = post("u:1", "a") + "<p>between</p>" + post("u:2", "b", css="x feed-shared-update-v2 y")
    assert find(html) == [("a", "Jane", "u:1"), ("b", "Jane", "u:2")]


def test_first_selector_that_matches_wins_for_the_whole_page():
    third = '<div data-urn="urn:li:activity:7"><span class="break-words">c</span></div>'
    assert find(third) == [("c", None, "urn:li:activity:7")]
    assert find(third + post("u:1", "a")) == [("a", "Jane", "u:1")]
    assert find(post("u:1", "a") + third) == [("a", "Jane", "u:1")]


def test_second_selector_gives_posts_without_parts():
    html = '<div class="update-components-actor"><i>x</i></div>'
    assert find(html) == [(None, None, None)]


def test_nested_containers_are_both_found():
    inner = post("u:2", "inner", "Ann")
    outer = f'<div class="feed-shared-update-v2" data-urn="u:1">{inner}<b>tail</b></div>'
    assert find(outer + post("u:3")) == [
        ("inner", "Ann", "u:1"),
        ("inner", "Ann", "u:2"),
        ("text", "Jane", "u:3"),
    ]


def test_first_matching_descendant_counts():
    html = post(content='a<span class="break-words">b</span>c') + post("u:2", "z")
    assert [row[0] for row in find(html)] == ["abc", "z"]
    spans = "".join(f'<span class="break-words">{n}</span>' for n in (1, 2))
    two = f'<div class="feed-shared-update-v2">{spans}</div>'
    assert find(two) == [("1", None, None)]


@pytest.mark.parametrize(
    "html, row",
    [
        (post(title=None), ("text", None, "urn:li:activity:1")),
        (post(content=None), (None, "Jane", "urn:li:activity:1")),
        (post(content=""), ("", "Jane", "urn:li:activity:1")),
        (post(urn=None), ("text", "Jane", None)),
        (post(urn=""), ("text", "Jane", "")),
        (post(urn="a&amp;b"), ("text", "Jane", "a&b")),
        (post(urn="a&copy=1&notit;2&#45;3"), ("text", "Jane", "a&copy=1&notit;2-3")),
    ],
)
def test_missing_and_empty_parts(html, row):
    assert find(html) == [row]


@pytest.mark.parametrize(
    "content, expected",
    [
        ("a<br>b<br/>c", "a\nb\nc"),
        ("a &lt; b &amp; c &eacute; &#x41; &nope; &", "a < b & c é A &nope; &"),
        ("1 < 2 and 3 > 2", "1 < 2 and 3 > 2"),
        ("a<script>var x = '</span>';</script>b<style>p{}</style>c", "abc"),
        ("a<!-- </span> -->b<!-->c<!doctype x>d<?pi?>e</ x>f", "abcdef"),
        ("a<p>b<p>c</p><ul><li>d<li>e</ul>f", "a\nb\nc\nd\ne\nf"),
        ("a\r\nb\rc", "a b c"),
        ("a<b>b</i>c</b>d", "abcd"),
        ('a<img alt="</span>" src=x>b<a title=\'>\' href=/x?a=b/>c</a>', "abc"),
        ("<noscript><b>n</b></noscript>a<template><i>t</i></template>", "a"),
    ],
)
def test_text_of_an_element(content, expected):
    assert find(post(content=content)) == [(expected, "Jane", "urn:li:activity:1")]


@pytest.mark.parametrize(
    "html, expected",
    [
        ("\n    <span>Jane</span>\n    <br>  2nd  ", "Jane\n2nd"),
        ("\n  <i> a </i> <b> b </b>\n", "a b"),
        ("a<div>\n  <p> b </p>\n  </div> c", "a\nb\nc"),
        ("a <br> <br> b", "a\n\nb"),
        ("a\xa0 b", "a\xa0 b"),
        ("x<pre>  a\n   b </pre>y", "x\n  a\n   b \ny"),
        ("a<template> <br>t<div>u</div></template> b", "a b"),
        (" \n\t ", ""),
    ],
)
def test_blanks_as_shown(html, expected):
    assert find(post(content=html)) == [(expected, "Jane", "urn:li:activity:1")]
    assert find(post(title=html)) == [("text", expected, "urn:li:activity:1")]


def test_markup_that_is_not_an_element():
    hidden = (
        "<!-- " + post("c:1") + " --><script>'" + post("c:2") + "'</script>"
        "<textarea>" + post("c:3") + "</textarea><template>" + post("c:4") + "</template>"
        '<a title=\'<div class="feed-shared-update-v2">\'>x</a>'
    )
    assert find(hidden) == []
    assert find(hidden + post("u:1")) == [("text", "Jane", "u:1")]


def test_forms_of_a_tag():
    html = (
        "<DIV CLASS='feed-shared-update-v2\n x' Data-URN=u:1 data-urn=u:2 hidden>"
        "<SPAN\n class = break-words>a</SPAN >"
        "<span class=update-components-actor__title>b</span></DIV>"
        '<div class="feed&#45;shared-update-v2"></div><div class="feed-shared-update-v2-x"></div>'
    )
    assert find(html) == [("a", "b", "u:1"), (None, None, None)]


def test_unclosed_elements_end_with_their_parent():
    html = '<div class="feed-shared-update-v2" data-urn="u:1"><span class="break-words">a<div>b</div></div>c'
    assert find(html) == [("a\nb", None, "u:1")]
    assert find(html + post("u:2"))[1] == ("text", "Jane", "u:2")
    assert find('<div class="feed-shared-update-v2"><span class="break-words">to the end') == [
        ("to the end", None, None)
    ]
    assert find('<div class="feed-shared-update-v2"></body></html><span class="break-words">a') == [
        ("a", None, None)
    ]


def test_cells_of_a_table():
    html = (
        '<table><tr><td><div class="feed-shared-update-v2"><span class="break-words">a</td>'
        '<td><span class="update-components-actor__title">b</span></tr></table>'
    )
    assert find(html) == [("a", None, None)]


def test_other_selectors():
    html = '<ul><li id=p1 class="a b" lang="en-GB"><h2>t</h2><p>c</p></li></ul>'
    selectors = (
        "li", "*.b.a", "#p1", "li[id]", "[lang|=en]", '[id^="p"]', "[id$='1']", "[class*=' ']",
        ".b[id=p1]",
    )
    for selector in selectors:
        found = find(html, containers=(selector,), content="p", actor_title="h2", id_attribute="id")
        assert found == [("c", "t", "p1")], selector
    assert find(html, containers=("li[id^='']", "ol", ".c"), content="p", actor_title="h2") == []


@pytest.mark.parametrize("selector", ["", "div p", "a > b", "a,b", "p:first-child", "div.", "[x"])
def test_unsupported_selector(selector):
    with pytest.raises(ValueError):
        parse_selector(selector)


@pytest.mark.parametrize(
    "html",
    ["", "plain", "<", "<div", "</", "<!--", '<div class="', "<div class='feed-shared-update-v2"],
)
def test_broken_pages(html):
    assert find(html) == []


@pytest.mark.parametrize(
    "piece",
    ["<a ", '<a x="', "<", "<!--", "<!", "</a", "<div>", "<p>", "<script>", "</b>", "<a b=c ", "&"],
)
def test_hostile_pages_take_linear_time(piece):
    assert find(post("u:1") + piece * 50_000) == [("text", "Jane", "u:1")]


CONTAINER = '<div class="feed-shared-update-v2" data-urn="u">'
CONTENT = '<span class="break-words">'
TITLE = '<span class="update-components-actor__title">'


@pytest.mark.parametrize(
    "html, posts",
    [
        (CONTAINER * 50_000 + f"{CONTENT}x</span>" * 50_000, 50_000),
        (CONTAINER * 50_000 + f"{TITLE}</span>" * 50_000, 50_000),
        (f"<i><div>{CONTAINER}" + "<b>" * 50_000 + "</i>" * 50_000, 1),
        (f"{CONTAINER}{CONTENT}" * 50_000 + "<div>" * 50_000, 50_000),
        (f"{CONTAINER}<p>" + "<table>" * 50_000 + "<p>" * 50_000 + "</p>" * 50_000, 1),
    ],
)
def test_open_elements_are_not_walked(html, posts):
    start = time.perf_counter()
    assert len(find(html)) == posts
    assert time.perf_counter() - start < 4


def test_text_of_nested_parts():
    inner = f"{CONTAINER}{CONTENT} in <br> ner</span></div>"
    assert find(f"{CONTAINER}{CONTENT}a <p> b{inner}</p>c  d</span>{TITLE}T</span></div>") == [
        ("a\nb\nin\nner\nc d", "T", "u"),
        ("in\nner", None, "u"),
    ]
    assert find(f"{CONTAINER}{CONTENT}x <pre> y\n z </pre> w</span></div>") == [("x\n y\n z \nw", None, "u")]


def test_names_are_ascii():
    assert find("<\u017fcript></script>" + post()) == [("text", "Jane", "urn:li:activity:1")]
    assert find("<script></\u017fcript>" + post() + "</script>") == []


def test_entities_may_spell_a_class():
    for name in ("feed&#45;shared-update-v2", "f&#101;ed-shared-update-v2"):
        assert find(f'<div class="{name}" data-urn=u></div>') == [(None, None, "u")]
    urn = "<div data-urn='urn&colon;li&colon;activity'></div>"
    assert find(urn) == [(None, None, "urn:li:activity")]
    assert find("<p>a &amp; b &lt; c</p>" * 3) == []


def test_selectors_without_a_value():
    assert find("<article><p>a</p></article>", containers=("article",), content="p") == [("a", None, None)]
    assert find("<p id=x>a</p>", containers=("p[id]",), id_attribute="id") == [(None, None, "x")]


class Node:
    """An element of a random tree, which says by itself what is to be found."""

    def __init__(self, rng, depth=0):
        self.name = rng.choice(["div", "div", "span", "span", "b", "section"])
        self.css = rng.sample(
            ["feed-shared-update-v2", "update-components-actor", "break-words", "update-components-actor__title", "x"],
            rng.choice([0, 0, 1, 1, 2]),
        )
        self.urn = rng.choice([None, None, "urn:li:activity:1", "u&2"])
        self.children = []
        for _ in range(rng.randint(0, 4) if depth < 5 else 0):
            kind = rng.random()
            if kind < 0.35:
                self.children.append(rng.choice(["a", "b & c", "1 < 2", "é", " "]))
            elif kind < 0.45:
                self.children.append("\n")
            else:
                self.children.append(Node(rng, depth + 1))

    def html(self):
        css = f' class="{" ".join(self.css)}"' if self.css else ""
        urn = f' data-urn="{escape(self.urn)}"' if self.urn else ""
        parts = [
            c.html() if isinstance(c, Node) else "<br>" if c == "\n" else escape(c)
            for c in self.children
        ]
        return f"<{self.name}{css}{urn}>{''.join(parts)}</{self.name}>"

    def elements(self):
        for child in self.children:
            if isinstance(child, Node):
                yield child
                yield from child.elements()

    def pieces(self):
        """Text with a mark at the borders of blocks inside."""
        for child in self.children:
            if not isinstance(child, Node):
                yield child
            elif child.name in ("div", "section"):
                yield None
                yield from child.pieces()
                yield None
            else:
                yield from child.pieces()

    def text(self):
        shown = "".join("\v" if piece is None else piece for piece in self.pieces())
        shown = re.sub(r" ?([\n\v]) ?", r"\1", re.sub(" +", " ", shown))
        out = ""
        for char in shown:
            if char != "\v":
                out += char
            elif out and not out.endswith("\n"):
                out += "\n"
        return out.strip(" \n")

    def part(self, css):
        found = (e for e in self.elements() if e.name == "span" and css in e.css)
        return next((e.text() for e in found), None)


def expected_posts(root):
    tests = (
        lambda e: e.name == "div" and "feed-shared-update-v2" in e.css,
        lambda e: e.name == "div" and "update-components-actor" in e.css,
        lambda e: e.name == "div" and (e.urn or "").startswith("urn:li:activity"),
    )
    for test in tests:
        posts = [e for e in root.elements() if test(e)]
        if posts:
            return [
                (p.part("break-words"), p.part("update-components-actor__title"), p.urn) for p in posts
            ]
    return []


def test_random_trees():
    rng = random.Random(9)
    finder, found = PostFinder(SelectorSpec()), 0
    for _ in range(6000):
        root = Node(rng)
        root.name = "main"
        expected = expected_posts(root)
        assert finder.find(root.html()) == expected, root.html()
        found += len(expected)
    assert found > 3000
