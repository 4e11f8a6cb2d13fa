"""Vectors of a table, as rows that can be compared and as arrays."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F


def comparable(embeddings, *others, vector="embedding", key="vec_id"):
    """One row per id: ``key``, ``others``, ``_vector`` (doubles) and ``_dim``.

    Vectors that are null, empty, zero or hold null or non-finite components are
    left out, and so are rows without an id.  Of rows that repeat an id, the
    smallest by ``others`` and vector counts.
    """
    doubles = F.transform(vector, lambda x: x.cast("double"))
    finite = F.forall(
        "_vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    )
    rows = (
        embeddings.select(F.col(key).cast("long").alias(key), *others, doubles.alias("_vector"))
        .where(F.col(key).isNotNull() & F.col("_vector").isNotNull() & finite)
        .where(F.exists("_vector", lambda x: x != 0))
    )
    one = F.min(F.struct(*others, "_vector")).alias("_one")
    return (
        rows.groupBy(key)
        .agg(one)
        .select(key, "_one.*")
        .withColumn("_dim", F.size("_vector"))
    )


def matrix(column):
    """Rows of an Arrow list column, all of one length, as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.asarray(flat, np.float64).reshape(len(column), -1)


def numbers(column):
    """An Arrow column of numbers as an array."""
    return np.asarray(column.to_numpy())
