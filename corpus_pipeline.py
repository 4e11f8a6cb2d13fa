"""A corpus pipeline: toxic documents out, near copies out, secrets masked, mixed, packed.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows of ``docs``; all but
the last return the columns they were given.  ``run`` writes what a stage returns
and reads it again for the next.
"""

import feedsieve
from feedsieve.llm import mixing, packing, parity_join, secrets, toxicity
from feedsieve.session import write_shared
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(feedsieve)


def drop_toxic(spark, docs, sf_dir):
    """Documents that the subword classifier does not take for toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.drop_toxic(docs, labels)


def drop_near_copies(spark, docs, sf_dir):
    """One document of each group of near copies, the one with the smallest id."""
    return parity_join.keep_one_of_each(docs)


def mask_secrets(spark, docs, sf_dir):
    """All documents, their secrets masked."""
    return secrets.mask_secrets(docs)


def mix_sources(spark, docs, sf_dir):
    """Documents drawn so that the token shares of the marginals are the targets."""
    return mixing.sample_mix(docs)


def pack(spark, docs, sf_dir):
    """The pieces of all documents with their places in sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("secret_scan", mask_secrets),
    ("source_mixing", mix_sources),
    ("packing", pack),
]

# A trained classifier decides in the first stage, which SQL cannot express.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = write_shared(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
