"""Mixing sources to target weights by iterative proportional fitting.

The words of the corpus are counted by source, language and topic in one
aggregation.  Raking then scales the cells until the token shares of each of the
three marginals are those asked for, no cell above what the corpus holds; the
scale of a cell is the probability with which its documents are sampled.

A marginal names its categories, and all others together are ``REST``: the number
of cells follows from the targets, not from the data.  The share of categories
that the corpus does not hold goes to the others in proportion; targets that the
corpus cannot meet are met as far as full cells allow; ``shares_reached`` tells which.

A null source or language is of the rest, a null or empty text has no words and
counts as one, so that it can be drawn.  A document is drawn by the hash of its
id and text: rows that repeat are drawn together, and a second run draws the same.
"""

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import functions as F

REST = "*"
MARGINALS = ("source", "lang", "topic")
SWEEPS = 500
TOLERANCE = 1e-9
SHARE_TOLERANCE = 1e-3
SHARES = (
    "marginal string, category string, target double, corpus double, expected double, "
    "drawn double, met boolean"
)

TOPICS = (
    ("licence", r"(?i)licen[cs]e|copyright"),
    ("contact", r"[\w.]+@[\w.]+"),
)


@dataclass(frozen=True)
class Targets:
    """Token shares by category of each marginal, and how much of all tokens to keep."""

    source: dict = field(default_factory=lambda: {"src0": 0.15, REST: 0.85})
    lang: dict = field(default_factory=lambda: {"en": 0.5, "de": 0.2, "fr": 0.15, REST: 0.15})
    topic: dict = field(default_factory=lambda: {"licence": 0.02, "contact": 0.05, REST: 0.93})
    keep: float = 0.5


def topic_of(text, topics=TOPICS):
    """The first topic whose pattern the text matches, else ``REST``.

    A topic that no target names would be of the rest as well: leave its pattern out.
    """
    out = F.lit(None).cast("string")
    for name, pattern in topics:
        out = F.coalesce(out, F.when(text.rlike(pattern), F.lit(name)))
    return F.coalesce(out, F.lit(REST))


def _category(column, shares):
    return F.when(column.isin([c for c in shares if c != REST]), column).otherwise(F.lit(REST))


def with_cells(docs, targets=Targets(), topics=TOPICS):
    """``_doc`` (the document) with ``_tokens`` and its cell ``_source, _lang, _topic``."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        F.struct(*docs.columns).alias("_doc"),
        F.greatest(F.regexp_count(text, F.lit(r"\S+")), F.lit(1)).cast("long").alias("_tokens"),
        _category(F.col("source"), targets.source).alias("_source"),
        _category(F.col("lang"), targets.lang).alias("_lang"),
        _category(topic_of(text, topics), targets.topic).alias("_topic"),
        F.pmod(F.xxhash64("doc_id", text), F.lit(1 << 52)).alias("_draw"),
    )


def rake(tokens, shares, keep=0.5, sweeps=SWEEPS):
    """Sampling probability of each cell of the cube ``tokens``.

    ``shares`` has a vector per axis.  Each sweep scales the slices of each axis to
    their share of the tokens to keep; what a full cell cannot take is left to the
    others of its slice in the next sweeps.
    """
    tokens = np.asarray(tokens, float)
    budget = keep * tokens.sum()
    kept = keep * tokens
    wanted = []
    for axis, share in enumerate(shares):
        others = tuple(i for i in range(tokens.ndim) if i != axis)
        present = np.where(tokens.sum(axis=others) > 0, share, 0.0)
        wanted.append((others, budget * present / max(present.sum(), 1e-300)))
    for _ in range(sweeps):
        before = kept
        for axis, (others, want) in enumerate(wanted):
            have = kept.sum(axis=others)
            scale = np.divide(want, have, out=np.zeros_like(want), where=have > 0)
            shape = [-1 if i == axis else 1 for i in range(tokens.ndim)]
            kept = np.minimum(kept * scale.reshape(shape), tokens)
        if np.abs(kept - before).max(initial=0) <= TOLERANCE * max(budget, 1):
            break
    return np.divide(kept, tokens, out=np.zeros_like(kept), where=tokens > 0)


def sampling_weights(cells, targets):
    """Probability by (source, language, topic) category, from the counted cells."""
    names = [list(getattr(targets, m)) for m in MARGINALS]
    names = [n if REST in n else [*n, REST] for n in names]
    cube = np.zeros([len(n) for n in names])
    for *categories, tokens in cells:
        cube[tuple(n.index(c) for n, c in zip(names, categories))] = tokens
    shares = [
        np.array([getattr(targets, m).get(c, 0.0) for c in n]) for m, n in zip(MARGINALS, names)
    ]
    chance = rake(cube, shares, targets.keep)
    return {
        tuple(n[i] for n, i in zip(names, at)): float(chance[at]) for at in np.ndindex(cube.shape)
    }


def mix_documents(docs, targets=Targets(), topics=TOPICS):
    """Each document with its cell, ``_tokens``, ``_probability`` and whether it is ``_drawn``.

    Two maps over the texts and one aggregation of a cell per row.
    """
    rows = with_cells(docs, targets, topics)
    keys = [f"_{m}" for m in MARGINALS]
    counted = rows.groupBy(*keys).agg(F.sum("_tokens").alias("_tokens"))
    # As many rows as the targets have cells.
    chances = sampling_weights([tuple(r) for r in counted.collect()], targets)
    table = F.create_map(
        *(F.lit(x) for cell, p in chances.items() for x in ("\x1f".join(cell), p))
    )
    chance = F.coalesce(F.element_at(table, F.concat_ws("\x1f", *keys)), F.lit(0.0))
    rows = rows.withColumn("_probability", chance)
    return rows.withColumn("_drawn", F.col("_draw") < F.col("_probability") * float(1 << 52)).drop(
        "_draw"
    )


def shares_reached(mixed, targets=Targets()):
    """What became of the targets, from the rows of ``mix_documents``: a row per category.

    ``target`` share, ``corpus`` share, share ``expected`` from the probabilities and
    share ``drawn``, all of tokens; ``met`` where the expected share is the target.  It is
    not where full cells hold too little.  Categories without a target are ``REST``;
    without tokens, shares are 0.
    """
    keys = [f"_{m}" for m in MARGINALS]
    cells = mixed.groupBy(*keys).agg(
        F.sum("_tokens").alias("_corpus"),
        F.sum(F.col("_tokens") * F.col("_probability")).alias("_expected"),
        F.sum(F.when(F.col("_drawn"), F.col("_tokens")).otherwise(0)).alias("_kept"),
    )
    # As many rows as the targets have cells.
    counted = [tuple(r) for r in cells.collect()]
    sums = [sum(row[k] for row in counted) for k in (3, 4, 5)]
    out = []
    for axis, marginal in enumerate(MARGINALS):
        shares = getattr(targets, marginal)
        for category in dict.fromkeys([*shares, REST]):
            own = [row for row in counted if row[axis] == category]
            have = [sum(row[k] for row in own) for k in (3, 4, 5)]
            corpus, expected, drawn = (float(a / b) if b else 0.0 for a, b in zip(have, sums))
            target = float(shares.get(category, 0.0))
            met = abs(expected - target) <= SHARE_TOLERANCE
            out.append((marginal, category, target, corpus, expected, drawn, met))
    return mixed.sparkSession.createDataFrame(out, SHARES)


def sample_mix(docs, targets=Targets(), topics=TOPICS):
    """The documents that are drawn, with their own columns."""
    drawn = mix_documents(docs, targets, topics).where("_drawn")
    return drawn.select(*(F.col(f"_doc.{c}") for c in docs.columns))
