"""Reading replies, against golden values and a validating model."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from feedsieve.functions import replies
from feedsieve.functions.replies import LabelSpec, build_messages, parse_classification, read_reply

VALUES = [
    ("1", 1), ("0", 0), ("2", 2), ("-1", -1), ('"1"', 1), ('" 1 "', 1), ('"+1"', 1), ('"01"', 1),
    ('"1.0"', 1), ('"1_0"', 10), ("1.0", 1), ("1e0", 1), ("true", 1), ("false", 0), ("-0", 0),
    ("9223372036854775807", 2**63 - 1), ("-9223372036854775808", -(2**63)),
]
REFUSED = [
    "1.5", "null", '"yes"', '"true"', '"1e0"', "[1]", "{}", '""', '"1.5"', '"1__0"', '"_1"', '"٣"',
    "9223372036854775808", "1e30", "NaN", "Infinity",
]
WHOLE = [
    ("", replies.BAD_JSON),
    (None, replies.BAD_JSON),
    ('{"classification": 1} ok', replies.BAD_JSON),
    ('ok {"classification": 1}', replies.BAD_JSON),
    ("{'classification': 1}", replies.BAD_JSON),
    ('```json\n{"classification": 1}\n```', replies.BAD_JSON),
    ('{"classification": 1,}', replies.BAD_JSON),
    ("[" * 100_000, replies.BAD_JSON),
    (r'{"classification": 1, "x": "\ud800"}', replies.BAD_JSON),
    ("[1]", replies.NOT_AN_OBJECT),
    ("1", replies.NOT_AN_OBJECT),
    ("{}", replies.MISSING_FIELD),
    ('{"Classification": 1}', replies.MISSING_FIELD),
    ('{"classification": null}', replies.NOT_AN_INTEGER),
    ('{"classification": 9223372036854775808}', replies.OUT_OF_RANGE),
]


@pytest.mark.parametrize("value, label", VALUES)
def test_accepted(value, label):
    assert read_reply(f'{{"classification": {value}}}') == (label, None)
    assert read_reply(f' {{"x": [1], "classification": 5, "classification": {value}}}\n') == (label, None)


def test_escapes():
    assert read_reply(r'{"\u0063lassification": "\u0031", "x": "\ud83d\ude00"}') == (1, None)


@pytest.mark.parametrize("value", REFUSED)
def test_refused(value):
    label, error = read_reply(f'{{"classification": {value}}}')
    assert label is None and error


@pytest.mark.parametrize("reply, error", WHOLE)
def test_refused_reply(reply, error):
    assert read_reply(reply) == (None, error)


scalars = st.one_of(
    st.none(),
    st.booleans(),
    st.integers(-(2**70), 2**70),
    st.floats(-1e17, 1e17),
    st.integers(-(10**6), 10**6).map(float),
    st.text(alphabet="0123456789+-_. e\t", max_size=8),
    st.text(max_size=4),
    st.lists(st.integers(), max_size=2),
)


@settings(max_examples=1500, deadline=None)
@given(st.dictionaries(st.sampled_from(["classification", "Classification", "x"]), scalars))
def test_equals_a_validating_model(reply):
    pydantic = pytest.importorskip("pydantic")
    model = pydantic.create_model("Model", classification=(int, ...))
    text = json.dumps(reply)
    try:
        expected = model.model_validate_json(text).classification
    except pydantic.ValidationError:
        expected = None
    if expected is not None and not -(2**63) <= expected < 2**63:
        expected = None
    assert read_reply(text)[0] == expected


def test_column_function(spark):
    rows = [(f'{{"classification": {v}}}', label) for v, label in VALUES]
    rows += [(reply, None) for reply, _ in WHOLE]
    df = spark.createDataFrame(rows, "reply string, label bigint")
    got = df.select("label", parse_classification("reply").alias("p")).select("label", "p.*")
    assert got.schema["classification"].dataType.typeName() == "long"
    for label, classification, error in got.collect():
        assert label == classification and (error is None) == (label is not None)


def test_messages(spark):
    df = spark.createDataFrame([("hello",), (None,)], "t string")
    got = df.select(build_messages("p", "t").alias("m")).collect()
    assert [m.asDict() for m in got[0].m] == replies.request_messages("p", "hello")
    assert got[1].m[1].content is None
    with pytest.raises(ValueError):
        build_messages("", F.col("t"))


def test_label_spec():
    assert replies.HIRING_POST.json_schema() == {
        "properties": {"classification": {"title": "Classification", "type": "integer"}},
        "required": ["classification"],
        "title": "HiringPost",
        "type": "object",
    }
    for name, prompt in (("", "p"), ("n", "")):
        with pytest.raises(ValueError):
            LabelSpec(name, prompt)


def test_integers_of_any_length():
    def read(number):
        return read_reply(f'{{"classification": "{number}"}}')

    assert read("0" * 4100 + "1") == (1, None)
    assert read("-" + "0" * 4400 + "_7.0") == (-7, None)
    assert read("9" * 5000)[1] == read(str(1 << 63))[1] == "out_of_range"
    assert read(str(-(1 << 63))) == (-(1 << 63), None)
