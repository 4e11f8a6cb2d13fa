"""Toxicity by bags of subwords.

Each character n-gram of a word, word edges included, has a vector in a hashed
table.  A word is the mean of its n-grams, a document the mean of its words, and
a linear softmax on top tells the classes apart; table and softmax are trained
jointly in numpy.  A misspelt word shares most n-grams with the word it stands
for, so it is understood without having been seen.

The softmax is linear, so for scoring the table shrinks to one number per n-gram,
and all texts of a block are scored by array operations at once.

A null or empty text has the zero vector and gets the softmax of it.  Where not
both classes are among the labels, every score is the one that they show, 0 without
any.  Of a text that is longer than ``EXCERPT`` characters, parts from its whole length
are learnt from; scores are those of whole texts.  Rows that repeat an id are scored one
by one; a column that is named like the score is replaced.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from .labelled import excerpt, in_order, labelled_sample, only_class
from .text_blocks import MULTIPLIER, batches_of, mix, word_bounds

PER_CLASS = 2000  # bound of the sample, see labelled_sample
EXCERPT = (8, 1_000)  # parts of a long text to learn from, and their characters
BUCKET_BITS = 17
DIMENSIONS = 8
NGRAMS = (3, 4, 5, 6)
EPOCHS = 25
BATCH = 128
RATE = 0.05
DECAY = 0.02
PART_BYTES = 1 << 16  # of a block that are hashed at a time
MIN_DOCS = 3
LEAST_T = 4.5
SEED = 7

# Letters, digits and all bytes of other letters stay; the rest parts words.
_LETTERS = np.full(256, 32, np.uint8)
_LETTERS[48:58] = np.arange(48, 58)
_LETTERS[97:123] = np.arange(97, 123)
_LETTERS[128:] = np.arange(128, 256)


def plain(text):
    """A text as letters and digits in lower case, one blank on either side."""
    data = ("" if text is None else text.lower()).encode("utf-8", "surrogatepass")
    return b" " + data + b" "


def gram_buckets(data, n, bits):
    """Bucket of the n-gram that starts at each byte."""
    codes = data.astype(np.uint64) + np.uint64(1)
    size = max(0, len(data) - n + 1)
    h = np.full(size, n, np.uint64)
    for k in range(n):
        h = h * MULTIPLIER + codes[k : k + size]
    return (mix(h) >> np.uint64(64 - bits)).astype(np.int64)


def _counts(starts, ends, n):
    """N-grams of each word with its edges."""
    return np.maximum(ends - starts + 3 - n, 0)


def running_sums(data, table, n, bits):
    """Sums of the table values of the first 0, 1, 2, .. n-grams.

    Hashes take many times the room of the bytes, so they are made part by part.
    """
    size = max(0, len(data) - n + 1)
    sums, carry = np.zeros(size + 1), table.dtype.type(0)
    for at in range(0, size, PART_BYTES):
        values = table[gram_buckets(data[at : at + PART_BYTES + n - 1], n, bits)]
        values[0] += carry
        values = np.cumsum(values)
        carry = values[-1]
        sums[at + 1 : at + 1 + len(values)] = values
    return sums


def word_values(data, table, bits):
    """Starts of the words of a block, and the mean table value of their n-grams."""
    data = _LETTERS[data]
    starts, ends = word_bounds(data)
    total, count = np.zeros(len(starts)), np.zeros(len(starts), np.int64)
    for n in NGRAMS:
        sums = running_sums(data, table, n, bits)
        grams = _counts(starts, ends, n)
        first = np.minimum(starts - 1, len(sums) - 1)
        last = np.minimum(first + grams, len(sums) - 1)
        total += sums[last] - sums[first]
        count += grams
    return starts, total / np.maximum(count, 1)


def bag(data, bits):
    """Buckets of a document and their weights, which sum to one."""
    data = _LETTERS[data]
    starts, ends = word_bounds(data)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0)
    count = sum(_counts(starts, ends, n) for n in NGRAMS)
    buckets, weights = [], []
    for n in NGRAMS:
        grams = _counts(starts, ends, n)
        begin = np.repeat(starts - 1 - np.concatenate([[0], np.cumsum(grams)[:-1]]), grams)
        at = begin + np.arange(grams.sum())
        buckets.append(gram_buckets(data, n, bits)[at])
        weights.append(np.repeat(1.0 / (count * len(starts)), grams))
    found, inverse = np.unique(np.concatenate(buckets), return_inverse=True)
    shares = np.bincount(inverse, np.concatenate(weights), len(found))
    return found.astype(np.int32), shares.astype(np.float32)


def keep_telling(bags, labels, min_docs=MIN_DOCS, least=LEAST_T, bits=BUCKET_BITS):
    """Bags without the n-grams whose share of a document does not tell the classes apart.

    By Welch's t of the shares.  What chance has left in the others would add up
    in the many words of a document, and outweigh the few that matter.
    """
    labels, size = np.asarray(labels), 1 << bits
    seen = np.zeros(size, np.int64)
    sums, squares = np.zeros((2, size)), np.zeros((2, size))
    # The buckets of a document are distinct, and one document is added at a time.
    for (at, weight), label in zip(bags, labels):
        seen[at] += 1
        sums[label][at] += weight
        squares[label][at] += weight**2
    n = np.maximum(1, [(labels == value).sum() for value in (0, 1)])[:, None]
    means = sums / n
    spreads = np.maximum(squares / n - means**2, 0) / n
    t = np.abs(means[1] - means[0]) / np.sqrt(spreads[0] + spreads[1] + 1e-30)
    keep = (seen >= min_docs) & (t >= least)
    return [(b[0][keep[b[0]]], b[1][keep[b[0]]]) for b in bags]


def train(
    bags, labels, bits=BUCKET_BITS, dim=DIMENSIONS, epochs=EPOCHS, rate=RATE, decay=DECAY, seed=SEED
):
    """Train table and softmax jointly (Adam); returns one number per bucket, and the bias.

    The table starts at zero and shrinks a little at each step it takes part in,
    so n-grams that were not seen, or that say nothing, count for nothing.
    """
    rng = np.random.default_rng(seed)
    table = np.zeros((1 << bits, dim), np.float32)
    top = rng.normal(0, 0.3, (dim, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    state = [[np.zeros_like(x), np.zeros_like(x)] for x in (table, top, bias)]
    labels, step = np.asarray(labels), 0
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for start in range(0, len(order), BATCH):
            chosen = order[start : start + BATCH]
            sizes = np.array([len(bags[i][0]) for i in chosen])
            rows = np.repeat(np.arange(len(chosen)), sizes)
            at = np.concatenate([bags[i][0] for i in chosen])
            weight = np.concatenate([bags[i][1] for i in chosen])
            # Distinct buckets only, so that a step costs what the batch holds.
            used, local = np.unique(at, return_inverse=True)
            docs = np.stack(
                [np.bincount(rows, table[at, d] * weight, len(chosen)) for d in range(dim)], axis=1
            )
            z = docs @ top + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(chosen)), labels[chosen]] -= 1
            p /= len(chosen)
            back = p @ top.T
            grads = [
                np.stack(
                    [np.bincount(local, back[rows, d] * weight, len(used)) for d in range(dim)],
                    axis=1,
                ),
                docs.T @ p,
                p.sum(axis=0),
            ]
            step += 1
            places = (used, slice(None), slice(None))
            for value, grad, moments, where in zip((table, top, bias), grads, state, places):
                moments[0][where] = 0.9 * moments[0][where] + 0.1 * grad
                moments[1][where] = 0.99 * moments[1][where] + 0.01 * grad * grad
                mean = moments[0][where] / (1 - 0.9**step)
                spread = np.sqrt(moments[1][where] / (1 - 0.99**step))
                value[where] -= rate * mean / (spread + 1e-8)
            table[used] *= 1 - decay * rate
    return (table @ (top[:, 1] - top[:, 0])).astype(np.float64), float(bias[1] - bias[0])


class SubwordModel:
    """One number per bucket and a bias: ``2 ** bits`` floats, whatever the corpus."""

    def __init__(self, table, bias, bits=BUCKET_BITS):
        self.table, self.bias, self.bits = table.astype(np.float32), bias, bits

    def scores(self, texts):
        """Scores of the texts; long ones are read in parts that end between words."""
        texts = [plain(text) for text in texts]
        total, words = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        for first, last in batches_of(texts):
            data = np.frombuffer(b"".join(texts[first:last]), np.uint8)
            ends = np.cumsum([len(t) for t in texts[first:last]])
            starts, values = word_values(data, self.table, self.bits)
            doc = first + np.searchsorted(ends, starts, "right")
            total += np.bincount(doc, values, len(texts))
            words += np.bincount(doc, minlength=len(texts))
        z = np.clip(total / np.maximum(words, 1) + self.bias, -60, 60)
        return 1 / (1 + np.exp(-z))


def fit_toxicity(docs, labels, label="toxic", per_class=PER_CLASS, parts=EXCERPT):
    """Model of a bounded labelled sample; without rows of both classes a constant score."""
    sample, rows = labelled_sample(docs, labels, label, per_class)
    cut = excerpt(F.col("text"), *parts).alias("text")
    found = in_order(sample).select("label", cut).toArrow()
    classes = found.column("label").to_pylist()
    if len(set(classes)) < 2:
        return only_class(rows)
    order = np.argsort(classes, kind="stable")
    texts = found.column("text")
    bags = [bag(np.frombuffer(plain(texts[i].as_py()), np.uint8), BUCKET_BITS) for i in order.tolist()]
    classes = sorted(classes)
    return SubwordModel(*train(keep_telling(bags, classes), classes))


def score_toxicity(docs, model, text="text", score="score"):
    """Add the score of each whole text; a map without a shuffle."""
    schema = docs.drop(score).withColumn(score, F.lit(0.0)).schema
    if isinstance(model, float):
        return docs.drop(score).withColumn(score, F.lit(model))

    def run(batches):
        for batch in batches:
            values = np.zeros(batch.num_rows)
            for first in range(0, batch.num_rows, 512):
                part = batch.column(text).slice(first, 512).to_pylist()
                values[first : first + len(part)] = model.scores(part)
            out = pa.array(values, pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, out], names=[*batch.schema.names, score])

    return docs.drop(score).mapInArrow(run, schema)


def drop_toxic(docs, labels, threshold=0.5):
    """The documents whose score stays below the threshold, with their own columns.

    Without labelled rows of both classes there is nothing to go by, and all stay.
    """
    name = "_toxicity"
    while name in docs.columns:
        name = f"_{name}"
    model = fit_toxicity(docs, labels)
    if isinstance(model, float):
        return docs
    scored = score_toxicity(docs, model, score=name)
    return scored.where(F.col(name) < threshold).select(*docs.columns)
