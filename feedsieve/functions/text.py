"""Text expressions: clean-up of post parts and the job-post score.

Each function takes and returns a ``Column`` and stays inside the JVM.  Case is
ignored the way Python's ``re.IGNORECASE`` and ``str.lower`` ignore it, which
Spark's plain ``(?i)`` and ``trim`` do not.
"""

import operator
import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as fixed

# The 29 characters for which str.isspace() holds.
PY_WHITESPACE = (
    "\t\n\v\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Letters outside ASCII that match an ASCII letter when case is ignored, but do
# not turn into it in lower case: the dotted capital I (whose lower case is an i
# and a separate dot), the dotless i, the long s.  (The Kelvin sign turns into k.)
_FOLDED_LETTERS = (("\u0130", "i"), ("\u0131", "i"), ("\u017f", "s"))

_PLAIN_WORDS = re.compile(r"[A-Za-z0-9 ]+")


def _column(value):
    return value if isinstance(value, Column) else F.col(value)


def strip(text):
    """Python's ``str.strip``."""
    return F.btrim(_column(text), F.lit(PY_WHITESPACE))


def clean_content(content):
    return strip(content)


def profile_name(actor_title):
    """First line of the actor title, stripped; may be empty."""
    return strip(F.substring_index(_column(actor_title), "\n", 1))


def post_url(data_urn, base_url=fixed.POST_BASE_URL):
    """Link of a post; null where the post has no id."""
    urn = _column(data_urn)
    return F.when(urn != "", F.concat(F.lit(base_url), urn))


def _let(value, use):
    """``use(value)`` with the value worked out once per row.

    Spark shares common expressions in a projection but not in a filter, where
    a dozen tests on ``lower(content)`` would lower it a dozen times.
    """
    return F.transform(F.array(value), use)[0]


def _fold(content, lowered):
    """Form in which ASCII words are found as by a regex with case ignored.

    It is the lower-cased content for nearly every text.
    """
    special = reduce(operator.or_, (content.contains(letter) for letter, _ in _FOLDED_LETTERS))
    plain = content
    for letter, ascii_letter in _FOLDED_LETTERS:
        plain = F.replace(plain, F.lit(letter), F.lit(ascii_letter))
    return F.when(special, F.lower(plain)).otherwise(lowered)


def _with_forms(content, use):
    """``use(content, lowered content, folded content)``."""

    def with_lowered(text, lowered):
        return _let(_fold(text, lowered), lambda folded: use(text, lowered, folded))

    return _let(
        _column(content),
        lambda text: _let(F.lower(text), lambda lowered: with_lowered(text, lowered)),
    )


def fold_text(text):
    """The folded form of one Python string."""
    for letter, ascii_letter in _FOLDED_LETTERS:
        text = text.replace(letter, ascii_letter)
    return text.lower()


def is_plain(pattern):
    """The pattern is made of ASCII words only, so a search is a substring test."""
    return _PLAIN_WORDS.fullmatch(pattern) is not None


def needed_terms(terms):
    """The terms without repeats and without those that contain another one."""
    terms = list(dict.fromkeys(terms))
    return [t for t in terms if not any(other != t and other in t for other in terms)]


def contains_any(text, terms):
    """Any of the terms occurs in ``text``, as it stands."""
    tests = [text.contains(term) for term in needed_terms(terms)]
    return reduce(operator.or_, tests) if tests else F.lit(False)


def java_pattern(patterns):
    """One Java regex with the meaning the patterns have in Python."""

    def spell_out_blanks(match):
        return r"[\s\x1c-\x1f]" if match.group() == r"\s" else match.group()

    spelled = (re.sub(r"\\.", spell_out_blanks, p, flags=re.DOTALL) for p in patterns)
    return "(?iU)(?:" + "|".join(spelled) + ")"


def _has_keyword(content, folded, keywords):
    """Plain words by substring search, some three times as fast as one regex."""
    if all(map(is_plain, keywords)):
        return contains_any(folded, (k.lower() for k in keywords))
    return content.rlike(java_pattern(keywords))


# The indicators, given the lower-cased and the folded content.


def _requirements(lowered, folded):
    return contains_any(folded, fixed.REQUIREMENT_WORDS)


def _experience(lowered, folded):
    """The substring test spares most posts the regex."""
    pattern = java_pattern(fixed.EXPERIENCE_PATTERNS)
    return folded.contains(fixed.EXPERIENCE_WORD) & folded.rlike(pattern)


def _apply_action(lowered, folded):
    return contains_any(folded, fixed.ACTION_WORDS)


def _word(word):
    return lambda lowered, folded: lowered.contains(word)


_INDICATORS = (
    _requirements,
    _experience,
    _apply_action,
    _word(fixed.RESUME_WORD),
    _word(fixed.CV_WORD),
    _word(fixed.POSITION_WORD),
    _word(fixed.ROLE_WORD),
)


def _count(lowered, folded):
    return reduce(operator.add, (test(lowered, folded).cast("int") for test in _INDICATORS))


# The predicates, each over a content column; null for a null content.


def matches_job_keyword(content, keywords=fixed.JOB_KEYWORDS):
    return _with_forms(
        content, lambda content, lowered, folded: _has_keyword(content, folded, keywords)
    )


def has_requirements(content):
    return _with_forms(content, lambda content, *forms: _requirements(*forms))


def has_experience(content):
    return _with_forms(content, lambda content, *forms: _experience(*forms))


def has_apply_action(content):
    return _with_forms(content, lambda content, *forms: _apply_action(*forms))


def mentions(content, word):
    """``word`` occurs in the lower-cased content."""
    return F.lower(_column(content)).contains(word)


def mentions_resume(content):
    return mentions(content, fixed.RESUME_WORD)


def mentions_cv(content):
    return mentions(content, fixed.CV_WORD)


def mentions_position(content):
    return mentions(content, fixed.POSITION_WORD)


def mentions_role(content):
    return mentions(content, fixed.ROLE_WORD)


def indicator_count(content):
    """How many of the seven indicators hold."""
    return _with_forms(content, lambda content, *forms: _count(*forms))


def _job_post_test(keywords):
    def test(content, lowered, folded):
        enough = _count(lowered, folded) >= fixed.MIN_INDICATORS
        return _has_keyword(content, folded, keywords) & enough

    return test


def is_job_post(content, keywords=fixed.JOB_KEYWORDS):
    """A job keyword and at least two indicators; false for null and empty."""
    return F.coalesce(_with_forms(content, _job_post_test(keywords)), F.lit(False))


def is_relevant_post(content, keywords=fixed.JOB_KEYWORDS):
    """The job-post test on the lower-cased content; a missing one is empty.

    Lower case stays as it is when lowered again, so that is done once.
    """
    test = _job_post_test(keywords)
    return _let(
        F.lower(F.coalesce(_column(content), F.lit(""))),
        lambda text: _let(_fold(text, text), lambda folded: test(text, text, folded)),
    )


def mentions_any(content, terms=fixed.CITY_TERMS):
    """Any of the terms occurs in the lower-cased content."""
    return _let(F.lower(_column(content)), lambda lowered: contains_any(lowered, terms))


def mentions_all(content, terms):
    """All of the terms occur in the lower-cased content."""
    terms = list(dict.fromkeys(terms))
    if not terms:
        return F.lit(True)

    def test(lowered):
        return reduce(operator.and_, (lowered.contains(term) for term in terms))

    return _let(F.lower(_column(content)), test)
