"""Find the post elements of one HTML page.

A small per-row helper for the extraction operator.  One pass over the tags with
a stack of open elements; attributes are read only for tags that a selector can
match, and text is kept only inside the parts of a post.
"""

import re
from dataclasses import dataclass
from html import unescape
from html.entities import html5

from ..functions import fixed_values as fixed

# Each alternative may also run into the end of the page.  What is left open
# there is no tag, and trying again from every later "<" would take forever.
_NAME = r"[a-zA-Z][^\s/>]*+"
_QUOTED = r"""(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z))"""
_ATTRIBUTE = rf"""[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:{_QUOTED}|[^\s>"'][^\s>]*+)?+)?+"""
# End tag | start tag | comment | anything else that is not shown.
_TAG = re.compile(
    rf"<(?:/({_NAME})[^>]*+(>|\Z)"
    rf"|({_NAME})((?:[\s/]++|{_ATTRIBUTE})*+)(>|\Z)"
    rf"|!--(?:-?>|.*?(?:--!?>|\Z))"
    rf"|(?:[!?]|/(?![a-zA-Z]))[^>]*+(?:>|\Z))",
    re.DOTALL | re.ASCII,
)
_ATTRIBUTE_PARTS = re.compile(
    r"""([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"'][^\s>]*+)))?+""",
    re.ASCII,
)
_ATTRIBUTE_ENTITY = re.compile(r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|([a-zA-Z][a-zA-Z0-9]*)(;|(?!=)))")

# Element classes of HTML.
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_RAW_TEXT = frozenset("script style title textarea noscript iframe noembed noframes xmp".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset"
    " figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav"
    " ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_CLOSES_PARAGRAPH = _BLOCK - frozenset("body html tbody td tfoot th thead tr".split())
_TABLE_PARTS = frozenset("caption table tbody td tfoot th thead tr".split())
_SCOPE_EDGE = frozenset("caption html table td th".split())
# What an end tag does not reach across: of parts of tables, of blocks, of all others.
_EDGES = (frozenset("html table".split()), _SCOPE_EDGE, _BLOCK)
_EDGE_OF = {
    name: tuple(kind for kind, names in enumerate(_EDGES) if name in names)
    for name in frozenset().union(*_EDGES)
}
_RAW_TEXT_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE | re.ASCII) for name in _RAW_TEXT}

_SELECTOR_STEP = re.compile(
    r"""(?P<tag>^[a-zA-Z][\w-]*|^\*)|\.(?P<cls>[\w-]+)|\#(?P<id>[\w-]+)"""
    r"""|\[\s*(?P<attr>[\w-]+)\s*(?:(?P<op>[~^$*|]?=)\s*(?:"(?P<dq>[^"]*)"|'(?P<sq>[^']*)'|(?P<bare>[\w-]+))\s*)?\]"""
)

# How many start tags a finder remembers, and how long they may be.
_KEPT_ROLES, _KEPT_LENGTH = 4096, 500

_BLANKS = re.compile(r"[ \t\n\f\r]+")

_ATTRIBUTE_TESTS = {
    None: lambda have, want: True,
    "=": lambda have, want: have == want,
    "~=": lambda have, want: want in have and want in _BLANKS.split(have),
    "^=": lambda have, want: want != "" and have.startswith(want),
    "$=": lambda have, want: want != "" and have.endswith(want),
    "*=": lambda have, want: want != "" and want in have,
    "|=": lambda have, want: have == want or have.startswith(want + "-"),
}


@dataclass(frozen=True)
class SelectorSpec:
    """Which elements are posts, and which parts of a post are read.

    Selectors name one element each (``tag.class#id[attr^='v']``); those that
    relate several elements are refused.
    """

    containers: tuple = fixed.POST_CONTAINERS
    content: str = fixed.POST_CONTENT
    actor_title: str = fixed.POST_ACTOR_TITLE
    id_attribute: str = fixed.POST_ID_ATTRIBUTE

    def __post_init__(self):
        object.__setattr__(self, "containers", tuple(self.containers))
        for selector in (*self.containers, self.content, self.actor_title):
            parse_selector(selector)


def parse_selector(selector):
    """``(tag or None, [(attribute, test, value), ...])`` of a selector."""
    tag, conditions, at = None, [], 0
    while at < len(selector):
        step = _SELECTOR_STEP.match(selector, at)
        if step is None:
            raise ValueError(f"unsupported selector: {selector!r}")
        part = step.groupdict()
        if part["tag"]:
            tag = None if part["tag"] == "*" else part["tag"].lower()
        elif part["cls"]:
            conditions.append(("class", "~=", part["cls"]))
        elif part["id"]:
            conditions.append(("id", "=", part["id"]))
        else:
            value = next((part[k] for k in ("dq", "sq", "bare") if part[k] is not None), "")
            conditions.append((part["attr"].lower(), part["op"], value))
        at = step.end()
    if at == 0:
        raise ValueError("empty selector")
    return tag, conditions


def _compile(selector):
    tag, conditions = parse_selector(selector)
    tests = [(name, _ATTRIBUTE_TESTS[op], value) for name, op, value in conditions]

    def matches(name, attributes):
        if tag is not None and name != tag:
            return False
        return all(key in attributes and test(attributes[key], value) for key, test, value in tests)

    return tag, matches


def _unescape_attribute(value):
    """Entities of an attribute value: a bare ``&name`` counts only when whole."""

    def decode(match):
        name, end = match.groups()
        if name is None:
            return unescape(match.group())
        if end == ";":
            return html5.get(name + ";", match.group())
        return html5.get(name, match.group())

    return _ATTRIBUTE_ENTITY.sub(decode, value) if "&" in value else value


def _attributes(source):
    found = {}
    for name, double, single, bare in _ATTRIBUTE_PARTS.findall(source):
        found.setdefault(name.lower(), _unescape_attribute(double or single or bare))
    return found


class _AsWritten(str):
    """Text that keeps its blanks."""


# Line breaks in the log of a page: one that is always made, one only behind other text.
_END_LINE, _START_LINE = object(), object()


class _Text:
    """Text of one element: a part of the page's log, so that nested elements share it."""

    __slots__ = ("log", "start", "end", "shown")

    def __init__(self, log):
        self.log, self.start = log, len(log)
        self.end = self.shown = None

    def value(self):
        if self.shown is None:
            self.shown = _shown(self.log[self.start : self.end])
        return self.shown


def _shown(log):
    """Text as it is shown: a run of blanks is one, none at line ends."""
    pieces, runs = [], []
    written = False  # whether the last piece keeps its blanks

    def end_run():
        run = _BLANKS.sub(" ", "".join(runs))
        runs.clear()
        if not pieces or (not written and pieces[-1][-1] in " \n"):
            run = run.removeprefix(" ")
        if run:
            pieces.append(run)
        return written and not run

    for event in log:
        if type(event) is str:
            runs.append(event)
            continue
        if runs:
            written = end_run()
        if isinstance(event, _AsWritten):
            pieces.append(event)
            written = True
        elif event is _END_LINE or (pieces and not pieces[-1].endswith("\n")):
            if pieces and not written and pieces[-1].endswith(" "):
                pieces[-1] = pieces[-1][:-1]
                if not pieces[-1]:
                    pieces.pop()
            pieces.append("\n")
            written = False
    if runs:
        end_run()
    return "".join(pieces).strip(" \t\n\f\r")


class _OpenElements:
    """Stack of the open elements, with the depths that end tags ask for.

    Names and edges have stacks of depths of their own, changed with each element, so no
    question walks down the open elements.
    """

    __slots__ = ("names", "depths", "edges")

    def __init__(self):
        self.names = []
        self.depths = {}
        self.edges = ([], [], [])

    def push(self, name):
        depth = len(self.names)
        self.names.append(name)
        self.depths.setdefault(name, []).append(depth)
        for kind in _EDGE_OF.get(name, ()):
            self.edges[kind].append(depth)

    def pop(self):
        name = self.names.pop()
        self.depths[name].pop()
        for kind in _EDGE_OF.get(name, ()):
            self.edges[kind].pop()

    def closes(self, name):
        """Depth an end tag closes to, or None where it closes nothing."""
        depths = self.depths.get(name)
        if not depths:
            return None
        edges = self.edges[_edge_kind(name)]
        return None if edges and edges[-1] > depths[-1] else depths[-1]


class _Post:
    __slots__ = ("urn", "content", "title")

    def __init__(self, urn):
        self.urn = urn
        self.content = None
        self.title = None

    def row(self):
        return (
            None if self.content is None else self.content.value(),
            None if self.title is None else self.title.value(),
            self.urn,
        )


class PostFinder:
    """Finds ``(content, actor_title, id)`` of each post of a page, in order.

    The first container selector that matches anything on the page is the one
    that counts for the whole page.  Parts a post lacks are ``None``.
    """

    def __init__(self, spec):
        selectors = [*spec.containers, spec.content, spec.actor_title]
        compiled = [_compile(s) for s in selectors]
        self._containers = [matches for _, matches in compiled[:-2]]
        self._content, self._title = compiled[-2][1], compiled[-1][1]
        self._id_attribute = spec.id_attribute
        self._roles = {}
        tags = {tag for tag, _ in compiled}
        self._tags = None if None in tags else frozenset(tags)
        # Words one of which a matching tag must hold, unless written as entities.
        self._words = _selector_words(selectors)
        self._container_words = _selector_words(spec.containers)
        self._spelled = _spelled_pattern(self._container_words or ())

    def find(self, html):
        return self._find(html) if self._may_hold_posts(html) else []

    def _may_hold_posts(self, html):
        """A look at the whole page that spares pages without posts the parsing."""
        if self._container_words is None or any(w in html for w in self._container_words):
            return True
        return self._spelled.search(html) is not None

    def _find(self, html):
        if "\r" in html:
            html = html.replace("\r\n", "\n").replace("\r", "\n")
        self._posts = []
        self._best = len(self._containers)
        self._open = opened = _OpenElements()
        self._marked = []  # (depth, post or None, texts) of those that matched
        self._waiting = ([], [])  # open posts without content, without title
        self._log = log = []  # text and line breaks while the text of a part is open
        self._open_texts = 0
        depths = opened.depths
        templates = 0
        at = 0
        while True:
            tag = _TAG.search(html, at)
            if self._open_texts and not templates:
                run = unescape(html[at : tag.start() if tag else len(html)])
                if run:
                    log.append(_AsWritten(run) if depths.get("pre") else run)
            if tag is None:
                break
            at = tag.end()
            ended, end_close, started, source, start_close = tag.groups()
            if end_close == "" or start_close == "":
                break
            name = (ended or started or "").lower()

            if name == "br":
                if self._open_texts and not templates:
                    log.append(_END_LINE)
            elif ended:
                if name == "template" and templates:
                    templates -= 1
                if depths.get(name) and name not in ("body", "html"):
                    self._close(name, not templates)
            elif name in _RAW_TEXT:
                end = _RAW_TEXT_END[name].search(html, at)
                at = end.start() if end else len(html)
            elif started:
                if name == "template":
                    templates += 1
                if name in _BLOCK:
                    if depths.get("p") and name in _CLOSES_PARAGRAPH:
                        self._close("p", not templates)
                    if not templates:
                        self._start_line()
                matches = self._may_match(name, source)
                if name in _VOID and not matches:
                    continue
                opened.push(name)
                if matches and not templates:
                    self._enter(*self._role(name, source))
                if name in _VOID:
                    self._close_to(len(opened.names) - 1)
        return [post.row() for post in self._posts]

    def _may_match(self, name, source):
        if self._tags is not None and name not in self._tags:
            return False
        return self._words is None or "&" in source or any(w in source for w in self._words)

    def _role(self, name, source):
        """``(is content, is title, rank as container or None, id)`` of a start tag.

        Most tags come back over and over again, so what they are is kept.
        """
        role = self._roles.get((name, source))
        if role is None:
            attributes = _attributes(source)
            ranks = (n for n, matches in enumerate(self._containers) if matches(name, attributes))
            role = (
                self._content(name, attributes),
                self._title(name, attributes),
                next(ranks, None),
                attributes.get(self._id_attribute),
            )
            if len(source) <= _KEPT_LENGTH:
                if len(self._roles) >= _KEPT_ROLES:
                    self._roles.clear()
                self._roles[name, source] = role
        return role

    def _enter(self, is_content, is_title, rank, urn):
        texts = []
        for part, waiting, wanted in zip(("content", "title"), self._waiting, (is_content, is_title)):
            if wanted and waiting:
                texts.append(_Text(self._log))
                for post in waiting:
                    setattr(post, part, texts[-1])
                waiting.clear()
        self._open_texts += len(texts)

        post = None
        if rank is not None and rank <= self._best:
            if rank < self._best:
                self._best = rank
                self._posts.clear()
                for waiting in self._waiting:
                    waiting.clear()
                self._marked = [(depth, None, texts) for depth, _, texts in self._marked]
            post = _Post(urn)
            self._posts.append(post)
            for waiting in self._waiting:
                waiting.append(post)
        if post is not None or texts:
            self._marked.append((len(self._open.names) - 1, post, texts))

    def _start_line(self):
        log = self._log
        if self._open_texts and not (log and (log[-1] is _START_LINE or log[-1] is _END_LINE)):
            log.append(_START_LINE)

    def _close(self, name, shown):
        """End the innermost open element of that name, if it can be ended here."""
        depth = self._open.closes(name)
        if depth is None:
            return
        self._close_to(depth)
        if shown and name in _BLOCK:
            self._start_line()

    def _close_to(self, depth):
        opened = self._open
        while len(opened.names) > depth:
            opened.pop()
        while self._marked and self._marked[-1][0] >= depth:
            _, post, texts = self._marked.pop()
            # The innermost post closes first, so it is the last one that waits.
            for waiting in self._waiting:
                if waiting and waiting[-1] is post:
                    waiting.pop()
            for text in texts:
                text.end = len(self._log)
            self._open_texts -= len(texts)


def _selector_words(selectors):
    """The longest value in each selector, or None if one has no value."""
    words = {max((v for *_, v in parse_selector(s)[1]), key=len, default="") for s in selectors}
    return None if "" in words else tuple(words)


def _spelled_pattern(words):
    """Entities that may stand for a character of the words."""
    chars = frozenset("".join(words))
    names = {name.rstrip(";") for name, value in html5.items() if chars.intersection(value)}
    return re.compile("&(?:" + "|".join(["#", *sorted(names)]) + ")")


def _edge_kind(name):
    """Which edges an end tag of that name does not reach across."""
    if name in _TABLE_PARTS:
        return 0
    return 1 if name in _BLOCK else 2
