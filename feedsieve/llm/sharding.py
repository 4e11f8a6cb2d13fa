"""Weighted rendezvous hashing of record keys, in built-in functions only.

Every shard draws a number for every key from the digest of both, and the key goes to
the shard with the highest score ``-weight / ln(draw)``.  The scores of a key do not
depend on the other shards, so a shard that is added takes keys only into itself, one
that is removed gives up only its own, and a changed weight moves keys only into or out
of its shard.  Nothing is looked up and nothing is shuffled to find the shard of a row.

All rows of a key share a shard: that is what the law "the key decides" means.  A key
that holds a third of all rows makes its shard large, but no task: places are counted
over a range sort that splits equal keys, and files are cut by place.

Null keys count as empty ones.  Empty tables give no rows.  Other columns of the table,
whatever their names, are kept by ``assign_shards`` and may not be named like the added
ones.
"""

from pyspark.sql import functions as F

from ..operators.posts import with_position

# Hexadecimal digits of a digest that make a draw; as many bits as a double holds exactly.
DRAW_DIGITS = 13
EXTRA_BYTES = 16


def _draw(key, shard):
    """Digits of the digest of key and shard, the same in every engine."""
    return F.substring(F.md5(F.concat(key, F.lit(":"), shard.cast("string"))), 1, DRAW_DIGITS)


def _score(draw, weight):
    share = (F.conv(draw, 16, 10).cast("double") + 0.5) / float(16**DRAW_DIGITS)
    return -weight / F.log(share)


def _checked(weights):
    weights = [float(w) for w in weights]
    if not weights or not all(0 < w < float("inf") for w in weights):
        raise ValueError("a shard needs a positive, finite weight")
    return weights


def _best(key, weights):
    """Struct ``(score, -shard)`` of the winner; equal weights need no logarithms."""
    weights = _checked(weights)
    if len(set(weights)) == 1:
        scored = F.transform(
            F.sequence(F.lit(0), F.lit(len(weights) - 1)),
            lambda s: F.struct(_draw(key, s).alias("score"), (-s).alias("less")),
        )
    else:
        scored = F.transform(
            F.array(*map(F.lit, weights)),
            lambda w, s: F.struct(_score(_draw(key, s), w).alias("score"), (-s).alias("less")),
        )
    return F.array_max(scored)


def shard_of(key, weights):
    """Column with the shard, from 0, of a key column; ties go to the smaller shard."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return (-_best(text, weights)["less"]).cast("int")


def assign_shards(df, key, weights, name="shard"):
    """Add the shard of each row by its key column."""
    if name in df.columns:
        raise ValueError(f"there is a column {name!r} already")
    return df.withColumn(name, shard_of(F.col(key), weights))


def place_rows(rows, order, shard="shard", name="slot"):
    """Number the rows of each shard from 0 without gaps, in the given order.

    One range sort over all shards; the first place of a shard is subtracted.  Pass the
    narrow columns only, as they are written once.  Rows that are equal in the order
    take their places in any way, and never depend on one task.
    """
    tie = "_tie"
    ordered = rows.withColumn(tie, F.monotonically_increasing_id()).orderBy(shard, *order, tie)
    placed = with_position(ordered, "_place").drop(tie)
    first = placed.groupBy(F.col(shard).alias("_shard")).agg(F.min("_place").alias("_first"))
    # One row per shard.
    return (
        placed.join(F.broadcast(first), F.col(shard) == F.col("_shard"))
        .withColumn(name, F.col("_place") - F.col("_first"))
        .drop("_shard", "_first", "_place")
    )


def shard_documents(docs, n_shards):
    """Shard, place, size and checksum of each document, and its shard with one more.

    Equal weights; the key is ``doc_id``, whose repeats share a shard.  A null text has no
    bytes and the checksum of the empty text.  Places follow ``doc_id`` (null first),
    then size and checksum.
    """
    text = F.coalesce("text", F.lit(""))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    best = _best(key, [1.0] * n_shards)
    own = docs.select(
        "doc_id",
        (F.octet_length(text) + EXTRA_BYTES).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        best.alias("_best"),
        _draw(key, F.lit(n_shards)).alias("_next"),
    )
    taken = F.col("_next") > F.col("_best.score")
    shard = (-F.col("_best.less")).cast("int")
    sharded = own.select(
        "doc_id",
        "size",
        "text_crc32",
        shard.alias("shard"),
        F.when(taken, F.lit(n_shards)).otherwise(shard).alias("grown_shard"),
    )
    placed = place_rows(sharded, ("doc_id", "size", "text_crc32"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )


def moved_rows(df, key, old_weights, new_weights):
    """Rows per pair of different shards under the old and the new weights."""
    both = df.select(
        shard_of(F.col(key), old_weights).alias("old_shard"),
        shard_of(F.col(key), new_weights).alias("new_shard"),
    )
    return (
        both.where("old_shard <> new_shard")
        .groupBy("old_shard", "new_shard")
        .agg(F.count(F.lit(1)).alias("rows"))
    )


def write_shards(df, path, key, weights, rows_per_file=1_000_000):
    """Write one folder per shard, ``shard=<n>``, in files of at most ``rows_per_file`` rows.

    The rows of the largest shard tell how many tasks write a shard.  Rows are dealt to
    them in turn, so neither a large shard nor copies of a row wait for one task.  A
    table that is there is not touched.
    """
    sharded = assign_shards(df, key, weights)
    largest = sharded.groupBy("shard").count().agg(F.max("count")).first()[0] or 1
    deals = -(-largest // rows_per_file)
    dealt = sharded.withColumn("_deal", F.monotonically_increasing_id() % deals)
    writer = dealt.repartition("shard", "_deal").drop("_deal").write.mode("errorifexists")
    writer.option("maxRecordsPerFile", rows_per_file).partitionBy("shard").parquet(path)


def oracle_sql(n_shards):
    """The same by comparing digests in SQL."""
    from .sql_parts import crc32_sql

    def draw(shard):
        return f"md5(coalesce(doc_id::varchar, '') || ':' || {shard})[1:{DRAW_DIGITS}]"

    return f"""
    with d as (
        select doc_id, octet_length(encode(coalesce(text, ''))) + {EXTRA_BYTES} as size,
               {crc32_sql("digits")} as text_crc32,
               list_sort(list_transform(range({n_shards}),
                   lambda s: {{'score': {draw("s::varchar")}, 'less': -s}}))[{n_shards}] as best,
               {draw(f"'{n_shards}'")} as next
        from (select doc_id, text, hex(encode(coalesce(text, ''))) as digits from documents) h)
    select doc_id, cast(size as bigint) as size, cast(text_crc32 as bigint) as text_crc32,
           'key' as law, cast(-best.less as int) as shard,
           row_number() over (partition by best.less
               order by doc_id nulls first, size, text_crc32) - 1 as slot,
           cast(case when next > best.score then {n_shards} else -best.less end as int)
               as grown_shard
    from d"""
