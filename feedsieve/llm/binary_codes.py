"""Near-duplicate vectors by binary codes of randomly rotated vectors.

A unit vector is rotated by one random orthogonal matrix.  Stored of it are its signs,
a bit each; a correction factor, its inner product with the sign vector; the error that
goes with it; and the rotated vector in steps of a byte, with a bound of what they lose.
From the signs of one vector and the steps of the other, their inner product is
estimated without bias but for that bound.  The part of the other vector that is
orthogonal to the first makes the error; of a link it is short, so the estimate of a
link is within a small distance of the threshold, or above.  All pairs for which that
holds are computed exactly in double precision, no others.

Only vectors of one label (and length) are compared.  A label is cut into blocks of
bounded size by the hash of the id, and a task compares the codes of one block with
those of another, so a label that holds a third of all rows is spread over many tasks.
Pairs never leave it as rows: a vector that has partners there leaves with a bitmap of
them, no longer than two blocks.  Those vectors alone are fetched for the exact products,
of which only the number of links of each and a spanning forest are kept.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, IntegerType, StructField, StructType

from ..session import drop_shared, write_shared
from .components import connected_components
from .vectors import comparable, matrix, numbers

THRESHOLD = 0.93
BLOCK_ROWS = 1024
DEVIATIONS = 6.0  # width of the confidence bound; 6 misses fewer than one link in 10**8
SEED = 11
STEPS = 127  # of a rotated component, on each side of zero
ROUNDING = 1e-5  # of estimates in single precision
CODES = ("_signs", "_steps", "_step", "_factor", "_error", "_slack")
TILE = ("label", "_dim", "_first", "_second")
LINKS = "vec_id long, links long, root long"


def rotation(dim, seed=SEED):
    """A random orthogonal matrix, the same for each task."""
    q, r = np.linalg.qr(np.random.default_rng(seed + dim).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def unit_vectors(vectors):
    """Vectors of length one.  Powers of two are taken out first, so that no square overflows."""
    power = np.frexp(np.abs(vectors).max(axis=1))[1]
    vectors = np.ldexp(vectors, -power[:, None])
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def encode(vectors, turn):
    """What is stored of vectors: the columns ``CODES``."""
    turned = unit_vectors(vectors) @ turn
    dim = turned.shape[1]
    factor = np.abs(turned).sum(axis=1) / np.sqrt(dim)
    error = np.sqrt(np.maximum(1 - factor**2, 0)) / factor / np.sqrt(max(dim - 1, 1))
    step = np.abs(turned).max(axis=1) / STEPS
    steps = np.rint(turned / step[:, None])
    slack = np.linalg.norm(turned - steps * step[:, None], axis=1)
    return np.packbits(turned >= 0, axis=1), steps.astype(np.int8), step, factor, error, slack


def with_codes(rows):
    """The comparable rows with the columns ``CODES``."""
    types = [BinaryType()] * 2 + [DoubleType()] * 4
    schema = StructType(rows.schema.fields + [StructField(c, t) for c, t in zip(CODES, types)])

    def run(batches):
        turns = {}
        for batch in batches:
            dims = numbers(batch.column("_dim"))
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                if dim not in turns:
                    turns[dim] = rotation(dim)
                codes = encode(matrix(part.column("_vector")), turns[dim])
                binary = [pa.array([row.tobytes() for row in c], pa.binary()) for c in codes[:2]]
                columns = part.columns + binary + [pa.array(c) for c in codes[2:]]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(run, schema)


def estimates(signs, factor, steps, step):
    """Estimates of all inner products of coded unit vectors with others in steps."""
    found = signs.astype(np.float32) @ steps.astype(np.float32).T
    return found * (step[None, :] / np.sqrt(signs.shape[1]) / factor[:, None])


def may_link(codes, others, threshold=THRESHOLD, deviations=DEVIATIONS):
    """Which pairs may have a cosine of at least the threshold, by their codes."""
    signs, _, _, factor, error, _ = codes
    _, steps, step, _, _, slack = others
    found = estimates(signs, factor, steps, step)
    aside = deviations * np.sqrt(max(1 - threshold**2, 0)) * error
    return found + aside[:, None] + slack[None, :] / factor[:, None] + ROUNDING >= threshold


def _codes_of(table, order):
    """Columns ``CODES`` of a tile as arrays, the signs as 1 and -1."""
    dim = table["_dim"][0].as_py()
    packed, steps = (
        np.frombuffer(b"".join(table[c].to_pylist()), t).reshape(len(order), -1)[order]
        for c, t in (("_signs", np.uint8), ("_steps", np.int8))
    )
    signs = np.unpackbits(packed, axis=1, count=dim).astype(np.int8) * 2 - 1
    return signs, steps, *(numbers(table[c])[order] for c in CODES[2:])


def compare_codes(table, threshold=THRESHOLD, deviations=DEVIATIONS):
    """The vectors of a tile with partners in it: their place, and the partners' as a bitmap."""
    side = numbers(table["_side"])
    order = np.lexsort((numbers(table["vec_id"]), side))
    n, cut = len(order), int((side == 0).sum())
    codes = _codes_of(table, order)
    first = [c[:cut] for c in codes]
    if table["_first"][0] == table["_second"][0]:
        maybe = np.triu(may_link(first, first, threshold, deviations), 1)
    else:
        maybe = np.zeros((cut, n), bool)
        maybe[:, cut:] = may_link(first, [c[cut:] for c in codes], threshold, deviations)
    leads = maybe.any(axis=1)
    at = np.union1d(np.flatnonzero(leads), np.flatnonzero(maybe.any(axis=0)))
    bitmaps = np.packbits(maybe, axis=1)
    partners = [bitmaps[k].tobytes() if k < cut and leads[k] else None for k in at]
    rows = table.select([*TILE, "vec_id"]).take(pa.array(order[at]))
    return rows.append_column("_at", pa.array(at.astype(np.int32))).append_column(
        "_partners", pa.array(partners, pa.binary())
    )


def roots(n, i, j):
    """The smallest index that each of ``n`` nodes reaches over the links ``(i, j)``."""
    at = np.arange(n)
    while len(i):
        low = np.minimum(at[i], at[j])
        new = at.copy()
        np.minimum.at(new, at[i], low)
        np.minimum.at(new, at[j], low)
        new = new[new]
        if (new == at).all():
            break
        at = new
    while (at[at] != at).any():
        at = at[at]
    return at


def exact_links(table, threshold=THRESHOLD):
    """Links of each vector among the candidates of a tile, and the root it is linked to."""
    at, ids = numbers(table["_at"]), numbers(table["vec_id"])
    unit = unit_vectors(matrix(table["_vector"]))
    row_at = np.zeros(at.max() + 1, np.int64)
    row_at[at] = np.arange(len(at))
    order = np.argsort(ids, kind="stable")  # roots are the smallest indices
    rank = np.empty(len(ids), np.int64)
    rank[order] = np.arange(len(ids))
    linked = [np.zeros((0, 2), np.int64)]
    for row, partners in enumerate(table["_partners"].to_pylist()):
        if partners is None:
            continue
        others = row_at[np.flatnonzero(np.unpackbits(np.frombuffer(partners, np.uint8)))]
        others = others[unit[others] @ unit[row] >= threshold]
        linked.append(np.column_stack([np.full(len(others), row), others]))
    i, j = rank[np.concatenate(linked)].T
    links = np.bincount(i, minlength=len(ids)) + np.bincount(j, minlength=len(ids))
    ids = ids[order]
    root = ids[roots(len(ids), i, j)]
    some = links > 0
    return pa.table(
        {"vec_id": ids[some], "links": links[some].astype(np.int64), "root": root[some]}
    )


def candidates(codes, threshold=THRESHOLD, block_rows=BLOCK_ROWS, deviations=DEVIATIONS):
    """Per tile, the vectors with partners in it, from codes alone."""
    group = ["label", "_dim"]
    blocks = codes.groupBy(*group).agg(
        F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("_blocks")
    )
    own = F.pmod(F.xxhash64("vec_id"), F.col("_blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    dealt = (
        codes.select(*group, "vec_id", *CODES)
        .join(blocks, group)
        .withColumn("_own", own)
        .withColumn("_other", other)
        .withColumn("_first", F.least("_own", "_other"))
        .withColumn("_second", F.greatest("_own", "_other"))
        .withColumn("_side", (F.col("_own") != F.col("_first")).cast("int"))
        .select(*TILE, "_side", "vec_id", *CODES)
    )
    fields = dealt.select(*TILE, "vec_id").schema.fields
    schema = StructType(
        fields + [StructField("_at", IntegerType()), StructField("_partners", BinaryType())]
    )

    def compare(table):
        return compare_codes(table, threshold, deviations)

    return dealt.groupBy(*TILE).applyInArrow(compare, schema)


def vector_links(codes, threshold=THRESHOLD, block_rows=BLOCK_ROWS, deviations=DEVIATIONS):
    """``(vec_id, links, root)`` rows per pair of blocks; sum the links, join the roots."""
    found = candidates(codes, threshold, block_rows, deviations)
    rows = found.join(codes.select("vec_id", "_vector"), "vec_id")
    return rows.groupBy(*TILE).applyInArrow(lambda table: exact_links(table, threshold), LINKS)


def stored_codes(embeddings):
    """The comparable vectors that have a label, with their codes, in a shared table."""
    rows = comparable(embeddings, "label").where(F.col("label").isNotNull())
    return write_shared(with_codes(rows), "codes")


def near_duplicates(embeddings, threshold=THRESHOLD, block_rows=BLOCK_ROWS):
    """``vec_id, n_links, component_id, kept`` for each id.

    Vectors that cannot be compared, and those without a label, link with nothing.
    Rows that repeat an id are one vector; a null id is a row without links, with a
    null component, not kept.  An empty table has no rows.  Other columns are not read.
    """
    codes = stored_codes(embeddings)
    links = write_shared(vector_links(codes, threshold, block_rows), "links")
    drop_shared(codes)
    counts = links.groupBy("vec_id").agg(F.sum("links").alias("_links"))
    parts = connected_components(links, "vec_id", "root")
    ids = embeddings.select(F.col("vec_id").cast("long")).distinct()
    component = F.coalesce("component", "vec_id")
    return (
        ids.join(counts, "vec_id", "left")
        .join(parts.withColumnRenamed("node", "vec_id"), "vec_id", "left")
        .select(
            "vec_id",
            F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"),
            component.alias("component_id"),
            F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
        )
    )
