"""Labelled documents to fit a classifier on, as a bounded sample."""

from pyspark.sql import functions as F


def is_held_out(doc_id):
    """Rows no classifier may learn from: every fifth by the checksum of the id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled_sample(docs, labels, label, per_class):
    """``(documents, rows by class)``: ``doc_id, text, label`` to learn from.

    At most ``per_class`` labelled documents of each class, chosen by the hash of
    their id, so at every size alike; their whole texts, of any length, stay in Spark.
    The class sizes are counted over all labels.  Rows that are held out, or
    have no id or another label than 0 and 1, are left out; a repeated id
    counts once, with the least of its texts.
    """
    usable = (
        labels.select(F.col("doc_id").cast("long"), F.col(label).cast("int").alias("label"))
        .where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull())
        .where(~is_held_out(F.col("doc_id")))
    )
    rows = {r["label"]: r["count"] for r in usable.groupBy("label").count().collect()}
    chosen = [
        usable.where(F.col("label") == value)
        .distinct()
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(per_class)
        for value in (0, 1)
    ]
    # Two times per_class ids at most, so the broadcast has a fixed bound.
    ids = F.broadcast(chosen[0].unionByName(chosen[1]))
    found = (
        docs.select(F.col("doc_id").cast("long"), "text")
        .where(F.col("text").isNotNull())
        .join(ids, "doc_id")
        .groupBy("doc_id", "label")
        .agg(F.min("text").alias("text"))
    )
    return found, (rows.get(0, 0), rows.get(1, 0))


def excerpt(text, parts, part_chars):
    """Column: a text, or, of a longer one, parts spread evenly over its whole length."""
    length = F.char_length(text)
    step = (length - part_chars) / F.lit(parts - 1)
    cut = F.transform(
        F.sequence(F.lit(0), F.lit(parts - 1)),
        lambda k: F.substring(text, (F.floor(k * step) + 1).cast("int"), F.lit(part_chars)),
    )
    return F.when(length <= parts * part_chars, text).otherwise(F.array_join(cut, " "))


def in_order(sample):
    """Rows of a sample in the order of the hash of their id, which is the same at every run."""
    return sample.orderBy(F.xxhash64("doc_id"), "doc_id")


def only_class(rows):
    """The score where the labels of both classes do not occur: 1 if all say so, else 0."""
    return 1.0 if rows[1] and not rows[0] else 0.0
