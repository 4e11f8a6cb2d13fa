"""Requests to a language model and the strict reading of its replies."""

import hashlib
import json
import math
import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .fixed_values import HIRING_PROMPT

FIELD = "classification"

# What a reply may be refused for.
EMPTY_INPUT = "empty_input"
BAD_JSON = "bad_json"
NOT_AN_OBJECT = "not_an_object"
MISSING_FIELD = "missing_field"
NOT_AN_INTEGER = "not_an_integer"
OUT_OF_RANGE = "out_of_range"
CLIENT_ERROR = "client_error"
NO_ANSWER = "no_answer"

# A lax field skips leading zeros and takes what follows, even with a sign, as the number.
_INTEGER_TEXT = re.compile(r"[+-]?[0-9]+(?:_[0-9]+)*(?:\.0+)?|\+?0+-_?[0-9]+(?:_[0-9]+)*")
_JSON_BLANKS = " \t\n\r"
_LONG_MIN, _LONG_MAX = -(1 << 63), (1 << 63) - 1
_LONG_DIGITS = 19


@dataclass(frozen=True)
class LabelSpec:
    """A label: the column it fills, and the prompt that asks for it."""

    name: str
    prompt: str
    title: str = "Label"

    def __post_init__(self):
        if not self.name or not self.prompt:
            raise ValueError("a label needs a name and a prompt")

    def json_schema(self):
        """Schema of the reply: an object with one required integer."""
        return {
            "properties": {FIELD: {"title": FIELD.capitalize(), "type": "integer"}},
            "required": [FIELD],
            "title": self.title,
            "type": "object",
        }

    def key(self):
        """Digest of what is asked for: prompt and schema, not the name of the column."""
        asked = json.dumps([self.prompt, self.json_schema()], sort_keys=True)
        return hashlib.sha256(asked.encode("utf-8", "surrogatepass")).hexdigest()


HIRING_POST = LabelSpec("hiring_post", HIRING_PROMPT, "HiringPost")


def build_messages(prompt, text):
    """Column with the two messages of a request."""
    if not prompt:
        raise ValueError("a request needs a prompt")
    text = F.col(text) if isinstance(text, str) else text

    def message(role, content):
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    return F.array(message("system", F.lit(prompt)), message("user", text))


def request_messages(prompt, text):
    """The same messages for one text, as the clients take them.

    Built next to the call, so the prompt does not travel with every row.
    """
    return [{"role": "system", "content": prompt}, {"role": "user", "content": text}]


def read_reply(reply):
    """``(label, None)`` of a valid reply, ``(None, reason)`` of any other.

    Accepted are integers, whole floats, booleans and texts of an integer, as a
    lax integer field of a validated model takes them.
    """
    try:
        value = json.loads((reply or "").strip(_JSON_BLANKS))
        if "\\u" in reply:
            # Half a surrogate pair is no text; json lets it through.
            json.dumps(value, ensure_ascii=False).encode()
    except (ValueError, RecursionError):
        return None, BAD_JSON
    if not isinstance(value, dict):
        return None, NOT_AN_OBJECT
    if FIELD not in value:
        return None, MISSING_FIELD
    number = _as_integer(value[FIELD])
    if number is None:
        return None, NOT_AN_INTEGER
    if not _LONG_MIN <= number <= _LONG_MAX:
        return None, OUT_OF_RANGE
    return number, None


def _as_integer(value):
    if isinstance(value, int):
        return int(value)
    if isinstance(value, float):
        return int(value) if math.isfinite(value) and value.is_integer() else None
    if isinstance(value, str):
        value = value.strip()
        if _INTEGER_TEXT.fullmatch(value):
            digits = re.sub("[+_-]", "", value.partition(".")[0]).lstrip("0") or "0"
            # More digits than a BIGINT has are out of range, whatever they are.
            number = int(digits[: _LONG_DIGITS + 1])
            return -number if "-" in value else number
    return None


_PARSED = T.StructType(
    [T.StructField(FIELD, T.LongType()), T.StructField("error", T.StringType())]
)


@F.pandas_udf(_PARSED)
def parse_classification(replies: pd.Series) -> pd.DataFrame:
    """Column function over replies; the labelling operator reads them in place."""
    read = [read_reply(reply) for reply in replies]
    return pd.DataFrame(
        {
            FIELD: pd.array([label for label, _ in read], dtype="Int64"),
            "error": [error for _, error in read],
        }
    )
