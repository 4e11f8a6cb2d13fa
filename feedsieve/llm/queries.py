"""Registered queries of the training-data operators, and their SQL where there is one."""

from pyspark.sql import functions as F

from ..session import new_table_path
from . import (
    binary_codes,
    hnsw,
    mixing,
    packing,
    parity_join,
    prefix_trie,
    quality,
    secrets,
    sharding,
    suffix_dedup,
    toxicity,
    turn_repair,
    warc,
)
from .labelled import is_held_out

QUERIES = {}
ORACLES = {}

QUALITY_LEAST = 0.3
TOXIC_LEAST = 0.5
SHARDS = 40


def query(sql=None):
    """Register the function under its name, with its SQL if there is one."""

    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return register


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _predictions(scored, least):
    return scored.select(
        "doc_id",
        is_held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= least).cast("int").alias("predicted"),
    )


@query()
def op1_quality_compression(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit_quality(docs, _table(spark, sf_dir, "labels"))
    return _predictions(quality.score_quality(docs, model), QUALITY_LEAST)


_WARC_SQL = """
    with p as (
        select page_id, octet_length(encode(coalesce(html, ''))) as n,
               sha256(coalesce(html, '')) as d
        from pages),
    f as (select d, min(page_id) as first_id from p where n >= 100 group by d)
    select page_id, cast(n as bigint) as payload_bytes, d as payload_digest,
           case when first_id is not null and page_id <> first_id then 'revisit'
                else 'response' end as record_type,
           case when page_id <> first_id then first_id end as refers_to
    from p left join f using (d)"""


@query(_WARC_SQL)
def op2_warc(spark, sf_dir):
    path = new_table_path(spark, "warc")
    warc.write_warc(warc.page_records(_table(spark, sf_dir, "pages")), path)
    records = warc.read_warc(spark, path)
    digest = F.coalesce(F.sha2("payload", 256), "payload_digest")
    intact = digest == F.col("payload_digest")
    return records.select(
        warc.page_id_of("record_id").alias("page_id"),
        F.coalesce(F.octet_length("payload").cast("long"), "payload_bytes").alias("payload_bytes"),
        F.when(intact, digest)
        .otherwise(F.raise_error(F.lit("a payload does not have its digest")))
        .alias("payload_digest"),
        "record_type",
        warc.page_id_of("refers_to").alias("refers_to"),
    )


@query()
def op3_hnsw(spark, sf_dir):
    return hnsw.nearest_neighbours(_table(spark, sf_dir, "embeddings"))


@query()
def op4_suffix_dedup(spark, sf_dir):
    return suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"))


@query()
def op5_rotated_codes(spark, sf_dir):
    return binary_codes.near_duplicates(_table(spark, sf_dir, "embeddings"))


@query()
def op6_toxicity_subwords(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit_toxicity(docs, _table(spark, sf_dir, "labels"))
    return _predictions(toxicity.score_toxicity(docs, model), TOXIC_LEAST)


@query()
def op7_parity_join(spark, sf_dir):
    return parity_join.join_documents(_table(spark, sf_dir, "documents"))


@query()
def op8_pattern_packing(spark, sf_dir):
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


@query(secrets.oracle_sql())
def op9_secret_scan(spark, sf_dir):
    return secrets.scan_secrets(_table(spark, sf_dir, "documents"))


@query()
def op10_source_mixing(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return mixing.mix_documents(docs).select(
        F.col("_doc.doc_id").alias("doc_id"),
        F.col("_source").alias("source_category"),
        F.col("_lang").alias("lang_category"),
        F.col("_topic").alias("topic"),
        F.col("_tokens").alias("tokens"),
        F.col("_probability").alias("probability"),
        F.col("_drawn").alias("drawn"),
    )


@query(prefix_trie.oracle_sql())
def op11_prefix_trie(spark, sf_dir):
    return prefix_trie.rebuilt_trie(_table(spark, sf_dir, "conversations"))


@query(turn_repair.oracle_sql())
def op12_turn_repair(spark, sf_dir):
    return turn_repair.repair_damaged(_table(spark, sf_dir, "conversations"))


@query(sharding.oracle_sql(SHARDS))
def op13_rendezvous_sharding(spark, sf_dir):
    return sharding.shard_documents(_table(spark, sf_dir, "documents"), SHARDS)
