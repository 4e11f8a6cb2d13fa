"""Classifiers on long texts, few labels and awkward rows."""

import numpy as np
import pytest

from feedsieve.llm import labelled, quality, toxicity

DOCS = "doc_id long, text string, source string, score string"
FITS = {
    "quality": (quality.fit_quality, quality.score_quality),
    "toxic": (toxicity.fit_toxicity, toxicity.score_toxicity),
}


def corpus(rng, n, words):
    """Clean texts of one vocabulary, labelled ones with words of another among them."""
    own = [f"word{k}" for k in range(300)]
    other = [f"zzgrub{k}" for k in range(30)]
    rows = []
    for i in range(n):
        label = i % 2
        text = [str(w) for w in rng.choice(own, words)]
        if label:
            for at in rng.choice(words, words // 4, replace=False):
                text[at] = str(rng.choice(other))
        rows.append((i, " ".join(text), label))
    return rows


@pytest.mark.parametrize("name", sorted(FITS))
@pytest.mark.parametrize("words", [60, 8000])
def test_texts_of_any_length_are_learnt_from(spark, name, words):
    rows = corpus(np.random.default_rng(3), 400 if words < 100 else 120, words)
    docs = spark.createDataFrame([(i, t, "s", "x") for i, t, _ in rows], DOCS)
    labels = spark.createDataFrame([(i, v) for i, _, v in rows], f"doc_id long, {name} int")
    fit, score = FITS[name]
    model = fit(docs, labels)
    assert not isinstance(model, float)
    scored = score(docs, model)
    assert scored.columns == ["doc_id", "text", "source", "score"]
    got = {r.doc_id: r.score for r in scored.collect()}
    right = np.mean([(got[i] >= 0.5) == v for i, _, v in rows])
    assert right >= 0.85, right


@pytest.mark.parametrize("name", sorted(FITS))
@pytest.mark.parametrize("values, wanted", [((), 0.0), ((0, 0), 0.0), ((1, 1), 1.0), ((None, 5), 0.0)])
def test_without_both_classes_the_labels_decide(spark, name, values, wanted):
    docs = spark.createDataFrame([(i, "some words here", "s", "x") for i in range(1, 9)], DOCS)
    labels = spark.createDataFrame(
        [(i + 1, v) for i, v in enumerate(values * 4)], f"doc_id long, {name} int"
    )
    fit, score = FITS[name]
    assert {r.score for r in score(docs, fit(docs, labels)).collect()} == {wanted}


@pytest.mark.parametrize("name", sorted(FITS))
def test_awkward_rows_have_scores(spark, name):
    rows = corpus(np.random.default_rng(4), 80, 50)
    docs = spark.createDataFrame([(i, t, "s", "x") for i, t, _ in rows], DOCS)
    labels = spark.createDataFrame([(i, v) for i, _, v in rows], f"doc_id long, {name} int")
    fit, score = FITS[name]
    model = fit(docs, labels)
    odd = [(None, None, None, None), (1, "", "s", "x"), (1, "", "s", "x"), (2, "zzgrub1 " * 60000, "s", "x")]
    got = score(spark.createDataFrame(odd, DOCS), model).collect()
    assert len(got) == 4 and all(0 <= r.score <= 1 for r in got)
    assert score(docs.limit(0), model).collect() == []


def test_excerpts_span_the_whole_text(spark):
    text = "".join(chr(0x4E00 + k) for k in range(1000))
    df = spark.createDataFrame([(text,), ("short",), ("",)], "text string")
    got = [r[0] for r in df.select(labelled.excerpt(df.text, 5, 20)).collect()]
    assert got[1:] == ["short", ""]
    parts = got[0].split(" ")
    assert [len(p) for p in parts] == [20] * 5
    assert parts[0] == text[:20] and parts[-1] == text[-20:] and parts[2] in text
