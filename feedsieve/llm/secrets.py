"""Secret scan with a trigram inverted index, in DataFrame operations only.

Every rule's regex is turned into a Boolean query over the trigrams that any match
must hold.  The index keeps, for each of the trigrams that some query names, the
rows whose text (in lower case) holds it; postings are intersected row by row, and
the texts of the candidates are verified with the regex itself.  A rule without
mandatory trigrams (a run of hex digits) has no query and scans all texts.

The three base rules give ``n_<kind>`` and the base digest; further rules add
spans of their own and leave the base ones alone.

A null text is an empty one and has no spans, an empty table gives no rows.  Spans
count code points, their end is exclusive.  Spans of several kinds may overlap or be
equal and are all listed, by start and then kind.  Rows that repeat get the same
result each; rows with a null id are scanned like others.  Further columns may have
any names.  Time grows in proportion to the length of a text and the matches in it:
running places are taken in blocks of matches, masked texts are cut from blocks.
"""

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import functions as F

try:
    from re import _parser as regex_parser
except ImportError:  # before Python 3.11
    import sre_parse as regex_parser

MAX_EXACT = 40  # strings that a part of a regex may stand for before it counts as unknown
MAX_CLASS = 8  # characters of a class, likewise
BLOCK = 256  # matches that are gone through at a time
PAGE = 1024  # code points of the blocks from which texts are cut


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of ``pattern`` whose group is long enough."""

    kind: str
    pattern: str
    group: int = 0
    min_length: int = 1


# The base rules.
ASSIGN = Rule(
    "assign",
    r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    2,
    6,
)
ACCESS = Rule("access", r"AKIA[A-Z0-9]+", 0, 20)
HEX = Rule("hex", r"[0-9a-f]+", 0, 24)
BASE_RULES = (ASSIGN, ACCESS, HEX)
NO_WORD_BEFORE = "(?<![A-Za-z0-9_])"
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("hosting", r"gh[oprsu]_[A-Za-z0-9]+", 0, 40),
    # The head of such a token is JSON in ASCII, which base64 writes without - and _; a
    # word has one start, so no run of letters is read twice.
    Rule("jwt", NO_WORD_BEFORE + r"eyJ[A-Za-z0-9]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
)
ALL_RULES = BASE_RULES + MORE_RULES


# --- from a regex to a trigram query -------------------------------------------
#
# A query is ANY, ("gram", g), ("and", parts) or ("or", parts).

ANY = ("any",)


def _parts(query):
    return query[1] if query[0] == "and" else frozenset([query])


def _all_of(queries):
    flat = frozenset().union(*(_parts(q) for q in queries if q != ANY))
    if not flat:
        return ANY
    return next(iter(flat)) if len(flat) == 1 else ("and", flat)


def _one_of(queries):
    queries = set(queries)
    if not queries or ANY in queries:
        return ANY
    # A part that asks for more than another adds nothing.
    queries = {q for q in queries if not any(_parts(o) < _parts(q) for o in queries)}
    return next(iter(queries)) if len(queries) == 1 else ("or", frozenset(queries))


def _query_of(strings):
    """Query for a text that holds one of the strings."""
    return _one_of(_all_of(("gram", s[i : i + 3]) for i in range(len(s) - 2)) for s in strings)


def _characters(items):
    """Letters of a class in lower case, None if they are many."""
    out = set()
    for op, arg in items:
        if str(op) == "LITERAL":
            out.add(chr(arg).lower())
        elif str(op) == "RANGE" and arg[1] - arg[0] < MAX_CLASS:
            out.update(chr(c).lower() for c in range(arg[0], arg[1] + 1))
        else:
            return None
    return out if len(out) <= MAX_CLASS else None


def _analyse(tree):
    """The strings a parsed part stands for, or None, and the query of what it holds."""
    run, whole, queries = {""}, True, []
    for op, arg in tree:
        name, strings, query = str(op), None, ANY
        if name == "LITERAL":
            strings = {chr(arg).lower()}
        elif name == "IN":
            strings = _characters(arg)
        elif name == "AT":
            strings = {""}
        elif name == "SUBPATTERN":
            strings, query = _analyse(arg[-1])
        elif name == "BRANCH":
            parts = [_analyse(part) for part in arg[1]]
            query = _one_of(q for _, q in parts)
            if all(s is not None for s, _ in parts):
                strings = set().union(*(s for s, _ in parts))
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            low, high, part = arg
            inner, inner_query = _analyse(part)
            query = inner_query if low else ANY
            if inner is not None and high == 1:
                strings = inner | (set() if low else {""})
        if strings is not None and len(run) * len(strings) <= MAX_EXACT:
            run = {a + b for a in run for b in strings}
            continue
        # An unknown part ends the run of known strings; a new one starts behind it.
        queries += [_query_of(run), query]
        run, whole = {""}, False
    queries.append(_query_of(run))
    return (run if whole else None), _all_of(queries)


def trigram_query(pattern):
    """Boolean query that each text with a match fulfils, over its lower-case trigrams."""
    return _analyse(regex_parser.parse(pattern, re.ASCII))[1]


def query_grams(query):
    if query[0] == "gram":
        return {query[1]}
    return set() if query == ANY else set().union(*(query_grams(part) for part in query[1]))


def _holds(query, postings):
    """Column: whether the grams of a row fulfil the query."""
    if query[0] == "gram":
        return F.array_contains(postings, query[1])
    parts = [_holds(part, postings) for part in sorted(query[1], key=str)]
    return reduce((lambda a, b: a & b) if query[0] == "and" else (lambda a, b: a | b), parts)


# --- index, candidates, verification ---------------------------------------------

SPANS = "array<struct<start:bigint,kind:int,end:bigint>>"


def build_index(rows, grams):
    """Postings ``(gram, _key)`` of the given trigrams over ``_text``."""
    held = [F.when(F.contains("_lower", F.lit(g)), F.lit(g)) for g in sorted(grams)]
    return rows.select("_key", F.lower("_text").alias("_lower")).select(
        "_key", F.explode(F.array_compact(F.array(*held))).alias("gram")
    )


def candidates(index, queries):
    """Keys whose postings fulfil a query, with the kinds of the rules they may match."""
    merged = index.groupBy("_key").agg(F.collect_set("gram").alias("_grams"))
    kinds = [F.when(_holds(q, F.col("_grams")), F.lit(kind)) for kind, q in queries.items()]
    found = merged.select("_key", F.array_compact(F.array(*kinds)).alias("_kinds"))
    return found.where(F.size("_kinds") > 0)


def _scanned(rule):
    """The rule with its least length inside the pattern, where that says the same.

    A match that is a word and then one run of a class is the whole run, so the
    length can be asked for at once, which spares the many short matches.
    """
    match = re.fullmatch(r"(\w*)(\[[^]]+\])\+", rule.pattern)
    if not match or rule.group or rule.min_length <= len(match[1]):
        return rule
    least = rule.min_length - len(match[1])
    return Rule(rule.kind, f"{match[1]}{match[2]}{{{least},}}")


def _let(value, use):
    """``use`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _gone_through(items, move, kept, emit, types):
    """Column: what ``emit(at, item)`` makes of the items ``kept(at, item)`` holds of.

    ``at`` starts at 0 and goes on by ``move(at, item)``.  Appending copies an array,
    so the items are taken in blocks, each from the ``at`` where the last one ended.
    """
    zero = F.lit(0).cast("long")

    def cut(array):
        last = F.greatest(F.lit(0), F.ceil(F.size(array) / BLOCK).cast("int") - 1)
        return F.transform(
            F.sequence(F.lit(0), last), lambda b: F.slice(array, b * BLOCK + 1, F.lit(BLOCK))
        )

    def begins(blocks):
        state = F.struct(zero.alias("at"), F.array().cast("array<bigint>").alias("found"))
        return F.aggregate(
            blocks,
            state,
            lambda s, block: F.struct(
                F.aggregate(block, s["at"], move).alias("at"),
                F.array_append(s["found"], s["at"]).alias("found"),
            ),
            lambda s: s["found"],
        )

    def go(block, at):
        state = F.struct(at.alias("at"), F.array().cast(types).alias("found"))
        return F.aggregate(
            block,
            state,
            lambda s, item: F.struct(
                move(s["at"], item).alias("at"),
                F.when(kept(s["at"], item), F.array_append(s["found"], emit(s["at"], item)))
                .otherwise(s["found"])
                .alias("found"),
            ),
            lambda s: s["found"],
        )

    return _let(
        items,
        lambda array: _let(
            cut(array), lambda blocks: F.flatten(F.zip_with(blocks, begins(blocks), go))
        ),
    )


def _rule_spans(rule, number, text):
    """Column: the spans of a rule in a text, leftmost first, none overlapping.

    The texts between the matches and the matches themselves give the places.
    """
    pieces = F.arrays_zip(
        F.split(text, rule.pattern, -1),
        F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)),
        F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)),
    )

    def length(piece, name):
        return F.coalesce(F.char_length(piece[name]), F.lit(0)).cast("long")

    lengths = F.transform(
        pieces,
        lambda p: F.struct(
            length(p, "0").alias("gap"), length(p, "1").alias("whole"), length(p, "2").alias("part")
        ),
    )

    def span(at, piece):
        begin = at + piece["gap"]
        end = begin + piece["whole"]
        return F.struct(begin.alias("start"), F.lit(number).alias("kind"), end.alias("end"))

    return _gone_through(
        lengths,
        lambda at, piece: at + piece["gap"] + piece["whole"],
        lambda at, piece: piece["part"] >= max(rule.min_length, 1),
        span,
        SPANS,
    )


def _with_spans(docs, rules, kept):
    """``kept`` (a struct ``_doc``), ``_text`` and ``_spans``, an array of spans per rule.

    One shuffle of postings, and a join of the candidates' keys back to the texts;
    the adaptive join sends the keys round if they are few and else splits hot ones.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(kept, text.alias("_text"), F.xxhash64("doc_id", text).alias("_key"))
    queries = {rule.kind: trigram_query(rule.pattern) for rule in rules}
    queries = {kind: query for kind, query in queries.items() if query != ANY}
    kinds = F.lit(None).cast("array<string>").alias("_kinds")
    if queries:
        index = build_index(rows, set().union(*map(query_grams, queries.values())))
        rows = rows.join(candidates(index, queries), "_key", "left")
        kinds = F.col("_kinds")
    rows = rows.select("_doc", "_text", kinds)
    spans = []
    for number, rule in enumerate(map(_scanned, rules)):
        test = F.col("_text").rlike(rule.pattern)
        if rule.kind in queries:
            test = F.array_contains("_kinds", rule.kind)
        found = F.when(test, _rule_spans(rule, number, F.col("_text")))
        spans.append(F.coalesce(found, F.array().cast(SPANS)))
    return rows.select("_doc", "_text", F.array(*spans).alias("_spans"))


def scan_secrets(docs, rules=ALL_RULES, base=BASE_RULES):
    """``doc_id``, a count per base kind, the digest of the base spans and all spans.

    The base rules come first in ``rules``.
    """
    found = _with_spans(docs, rules, F.struct("doc_id").alias("_doc"))
    kinds = F.array(*(F.lit(rule.kind) for rule in rules))

    def joined(per_rule):
        words = F.transform(
            F.array_sort(F.flatten(per_rule)),
            lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"], s["end"]),
        )
        return F.array_join(words, ",")

    spans = F.col("_spans")
    return found.select(
        F.col("_doc.doc_id").alias("doc_id"),
        *(F.size(spans[i]).cast("long").alias(f"n_{rule.kind}") for i, rule in enumerate(base)),
        F.sha2(joined(F.slice(spans, 1, len(base))).cast("binary"), 256).alias("base_sha256"),
        joined(spans).alias("spans"),
    )


def mask_secrets(docs, rules=ALL_RULES, mask="[SECRET]"):
    """``docs`` with each span of the rules replaced by ``mask`` in ``text``.

    Overlapping spans are one.  Other columns and texts without spans, null ones
    among them, stay as they are.
    """
    found = _with_spans(docs, rules, F.struct(*docs.columns).alias("_doc"))
    text = F.col("_text")

    def cut(pages, first, last):
        page = F.floor(first / PAGE).cast("int")
        many = F.floor(last / PAGE).cast("int") - page + 1
        held = F.array_join(F.slice(pages, page + 1, many), "")
        place = (first - page * PAGE + 1).cast("int")
        return F.substring(held, place, (last - first).cast("int"))

    def between(spans):
        """The stretches in front of spans that do not overlap an earlier one."""
        return _gone_through(
            spans,
            lambda at, span: F.greatest(at, span["end"]),
            lambda at, span: span["start"] >= at,
            lambda at, span: F.struct(at.alias("first"), span["start"].alias("last")),
            "array<struct<first:bigint,last:bigint>>",
        )

    def mask_in(pages):
        parts = F.transform(
            between(F.array_sort(spans)), lambda c: cut(pages, c["first"], c["last"])
        )
        behind = F.array_max(F.transform(spans, lambda span: span["end"]))
        rest = cut(pages, behind, F.char_length(text).cast("long"))
        return F.array_join(F.array_append(parts, rest), mask)

    spans = F.flatten("_spans")
    pages = F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % PAGE), F.lit(0))
    masked = F.when(F.size(spans) > 0, _let(pages, mask_in))
    return found.select(
        *(
            F.coalesce(masked, F.col("_doc.text")).alias(c) if c == "text" else F.col(f"_doc.{c}")
            for c in docs.columns
        )
    )


def oracle_sql(rules=ALL_RULES, base=BASE_RULES, table="documents"):
    """The same scan in the SQL of DuckDB."""

    def quoted(rule):
        # DuckDB has no look-behind; its ASCII \b says the same in front of a letter.
        return "'" + rule.pattern.replace(NO_WORD_BEFORE, r"\b").replace("'", "''") + "'"

    lists, spans = [], []
    for number, rule in enumerate(map(_scanned, rules)):
        lists += [
            f"string_split_regex(t, {quoted(rule)}) as gaps{number}",
            f"regexp_extract_all(t, {quoted(rule)}, 0) as whole{number}",
            f"regexp_extract_all(t, {quoted(rule)}, {rule.group}) as part{number}",
        ]
        begin = (
            f"list_sum(list_transform(gaps{number}[:i], lambda x: length(x)))"
            f" + coalesce(list_sum(list_transform(whole{number}[:i-1], lambda x: length(x))), 0)"
        )
        spans.append(
            f"list_transform(list_filter(range(1, len(whole{number}) + 1),"
            f" lambda i: length(part{number}[i]) >= {rule.min_length}), lambda i: struct_pack("
            f"s := cast({begin} as bigint), k := {number},"
            f" e := cast({begin} + length(whole{number}[i]) as bigint))) as found{number}"
        )
    names = "[" + ", ".join(f"'{rule.kind}'" for rule in rules) + "]"

    def joined(some):
        every = "[" + ", ".join(f"found{i}" for i in range(len(some))) + "]"
        return (
            f"coalesce(array_to_string(list_transform(list_sort(flatten({every})),"
            f" lambda f: {names}[f.k + 1] || ':' || f.s || ':' || f.e), ','), '')"
        )

    counts = ", ".join(f"cast(len(found{i}) as bigint) as n_{r.kind}" for i, r in enumerate(base))
    return f"""
        with texts as (select doc_id, coalesce(text, '') as t from {table}),
        parts as (select doc_id, {', '.join(lists)} from texts),
        spans as (select doc_id, {', '.join(spans)} from parts)
        select doc_id, {counts}, sha256({joined(base)}) as base_sha256, {joined(rules)} as spans
        from spans"""
