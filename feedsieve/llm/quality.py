"""Quality by compression.

Two zstandard dictionaries hold good and bad labelled text.  A text that is
like one of them packs smaller with it, so the difference of the two sizes,
divided by their sum, tells the classes apart.  A logistic calibration over
that difference and how well the text packs at all (a line said a hundred
times packs well with either) turns it into a score.

Texts are packed whole, in chunks, as a dictionary helps only the beginning of
what is packed with it.  A null text is an empty one; an empty text gets the
score that the calibration gives to sizes of nothing.  Where not both classes are
among the labels, every score is the one that they show, 0 without any.  Labelled texts
are packed whole as well, in Spark; only their measures come to the driver.  Rows that
repeat an id are scored one by one; a column that is named like the score is replaced.
"""

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import functions as F

from ..session import drop_shared, write_shared
from .labelled import in_order, labelled_sample, only_class
from .text_blocks import to_bytes

PER_CLASS = 3000  # bound of the sample, see labelled_sample
DICTIONARY_DOCS = 700
DICTIONARY_BYTES = 200_000
DOC_BYTES = 500
CHUNK_BYTES = 1000
LEVEL = 3


def build_dictionary(middles, size=DICTIONARY_BYTES):
    """Raw content of a dictionary: the middle parts of texts, up to a size."""
    parts, total = [], 0
    for middle in middles:
        parts.append(bytes(middle))
        total += len(middle)
        if total >= size:
            break
    return b" ".join(parts)[:size]


class CompressionModel:
    """Dictionaries and calibration; small enough to travel with the tasks."""

    def __init__(self, bad, good, chunk_bytes=CHUNK_BYTES, level=LEVEL):
        self.bad, self.good = bad, good
        self.chunk_bytes, self.level = chunk_bytes, level
        self.centre, self.scale, self.weights = None, None, None
        self._packers = None

    def __getstate__(self):
        return {**self.__dict__, "_packers": None}

    def _load(self):
        options = dict(write_content_size=False, write_checksum=False, write_dict_id=False)
        packers = [zstandard.ZstdCompressor(level=self.level, **options)]
        for content in (self.bad, self.good):
            book = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            book.precompute_compress(level=self.level)
            packers.append(zstandard.ZstdCompressor(level=self.level, dict_data=book, **options))
        self._packers = packers

    def measures(self, data):
        """Normalised difference, packed size per byte without and with dictionaries, log length."""
        if self._packers is None:
            self._load()
        alone, bad_packer, good_packer = self._packers
        own = bad = good = 0
        for start in range(0, len(data), self.chunk_bytes):
            chunk = data[start : start + self.chunk_bytes]
            own += len(alone.compress(chunk))
            bad += len(bad_packer.compress(chunk))
            good += len(good_packer.compress(chunk))
        n = max(1, len(data))
        return (bad - good) / max(1, bad + good), own / n, (bad + good) / (2 * n), np.log1p(len(data))

    def _design(self, x):
        x = np.asarray(x, float).reshape(-1, 4)
        return np.hstack([x, x**2, x[:, :1] * x[:, 1:]])

    def calibrate(self, measures, labels, weights, ridge=1.0, steps=60):
        """Weighted logistic regression by damped Newton steps."""
        design = self._design(measures)
        self.centre, self.scale = design.mean(0), design.std(0) + 1e-9
        a = np.hstack([np.ones((len(design), 1)), (design - self.centre) / self.scale])
        y, s, beta = np.asarray(labels, float), np.asarray(weights, float), np.zeros(a.shape[1])
        penalty = np.full(a.shape[1], ridge)
        penalty[0] = 1e-6

        def loss(b):
            z = a @ b
            return (s * (np.logaddexp(0, z) - y * z)).sum() + 0.5 * (penalty * b * b).sum()

        at = loss(beta)
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(a @ beta, -60, 60)))
            gradient = a.T @ (s * (p - y)) + penalty * beta
            step = np.linalg.solve((a * (s * p * (1 - p))[:, None]).T @ a + np.diag(penalty), gradient)
            size = 1.0
            while size > 1e-6 and loss(beta - size * step) > at:
                size /= 2
            beta = beta - size * step
            new = loss(beta)
            if at - new < 1e-9 * abs(at):
                break
            at = new
        self.weights = beta

    def scores(self, measures):
        design = (self._design(measures) - self.centre) / self.scale
        z = np.clip(self.weights[0] + design @ self.weights[1:], -60, 60)
        return 1 / (1 + np.exp(-z))


def fit_quality(docs, labels, label="quality", per_class=PER_CLASS):
    """Model of a bounded labelled sample; without rows of both classes a constant score.

    Dictionaries and calibration see different documents.  The calibration
    weighs the classes as they are among all labels.
    """
    sample, rows = labelled_sample(docs, labels, label, per_class)
    sample = write_shared(sample, "labelled")
    try:
        return _fitted(sample, rows)
    finally:
        drop_shared(sample)


def _fitted(sample, rows):
    ids = in_order(sample.select("doc_id", "label")).toArrow().to_pydict()
    by_class = [[i for i, v in zip(ids["doc_id"], ids["label"]) if v == value] for value in (0, 1)]
    if not all(by_class):
        return only_class(rows)
    cuts = [min(DICTIONARY_DOCS, (len(own) + 1) // 2) for own in by_class]
    # As many ids as the dictionaries have documents.
    lent = sample.join(F.broadcast(_ids(sample, by_class[0][: cuts[0]] + by_class[1][: cuts[1]])), "doc_id")
    data = F.col("text").cast("binary")
    start = F.greatest(F.floor((F.octet_length("text") - DOC_BYTES) / 2), F.lit(0)).cast("int")
    middle = F.substring(data, start + 1, F.lit(DOC_BYTES)).alias("middle")
    lent = in_order(lent).select("label", middle).toArrow().to_pydict()
    model = CompressionModel(
        *(build_dictionary([m for m, v in zip(lent["middle"], lent["label"]) if v == value]) for value in (0, 1))
    )
    learnt = [own[cut:] or own for own, cut in zip(by_class, cuts)]
    rest = sample.join(F.broadcast(_ids(sample, learnt[0] + learnt[1])), "doc_id")

    def measure(batches):
        for batch in batches:
            found = [model.measures(to_bytes(value.as_py())) for value in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("label"), pa.array(map(list, found), pa.list_(pa.float64()))],
                names=["doc_id", "label", "measures"],
            )

    measured = rest.select("doc_id", "label", "text").mapInArrow(
        measure, "doc_id long, label int, measures array<double>"
    )
    found = in_order(measured).toArrow().to_pydict()
    values = np.array(found["label"])
    share = np.array([rows[v] / max(1, (values == v).sum()) for v in (0, 1)])
    weights = share[values]
    model.calibrate(found["measures"], values, weights * len(weights) / weights.sum())
    return model


def _ids(sample, ids):
    return sample.sparkSession.createDataFrame([(i,) for i in ids], "doc_id long")


def score_quality(docs, model, text="text", score="score"):
    """Add the score of each whole text; a map without a shuffle."""
    schema = docs.drop(score).withColumn(score, F.lit(0.0)).schema
    if isinstance(model, float):
        return docs.drop(score).withColumn(score, F.lit(model))

    def run(batches):
        for batch in batches:
            found = [model.measures(to_bytes(value.as_py())) for value in batch.column(text)]
            out = pa.array(model.scores(found) if found else [], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, out], names=[*batch.schema.names, score])

    return docs.drop(score).mapInArrow(run, schema)
