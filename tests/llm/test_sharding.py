"""Rendezvous sharding: shares, moves, places, files, awkward rows."""

import zlib
from collections import Counter

import pytest

from feedsieve.llm import sharding

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def keys(spark, n):
    return spark.range(n).withColumnRenamed("id", "doc_id")


def shards(df, weights):
    return {r.doc_id: r.shard for r in sharding.assign_shards(df, "doc_id", weights).collect()}


def test_shares_follow_the_weights(spark):
    found = Counter(shards(keys(spark, 20000), [1, 1, 2, 4]).values())
    for shard, weight in enumerate([1, 1, 2, 4]):
        assert abs(found[shard] / 20000 - weight / 8) < 0.015


@pytest.mark.parametrize("more", [1.0, 3.0])
def test_new_shards_only_take(spark, more):
    df = keys(spark, 4000)
    old, new = shards(df, [1.0] * 7), shards(df, [1.0] * 7 + [more])
    moved = {k for k in old if old[k] != new[k]}
    assert {new[k] for k in moved} == {7}
    assert abs(len(moved) / 4000 - more / (7 + more)) < 0.03
    counted = sharding.moved_rows(df, "doc_id", [1.0] * 7, [1.0] * 7 + [more]).collect()
    assert sum(r.rows for r in counted) == len(moved)


def test_a_larger_weight_only_takes(spark):
    df = keys(spark, 4000)
    old, new = shards(df, [1.0] * 5), shards(df, [1.0, 1.0, 1.5, 1.0, 1.0])
    assert {new[k] for k in old if old[k] != new[k]} == {2}


def test_equal_weights_are_weights(spark):
    df = keys(spark, 2000)
    plain = shards(df, [5.0] * 6)
    scored = df.select(
        "doc_id",
        *[
            sharding._score(sharding._draw(df.doc_id.cast("string"), sharding.F.lit(s)), 5.0).alias(f"s{s}")
            for s in range(6)
        ],
    )
    assert all(plain[r.doc_id] == max(range(6), key=lambda s: r[f"s{s}"]) for r in scored.collect())


def test_places_and_awkward_rows(spark):
    rows = [(None, None), (None, "x"), (1, ""), (2, "é" * 50000), (3, "a"), (3, "a"), (3, "b")]
    rows += [(4, "hot")] * 60 + [(i, "same text") for i in range(5, 60)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    docs = docs.selectExpr("*", "1 as shard", "2 as slot", "3 as size", "4 as _place", "5 as _tie")
    got = sharding.shard_documents(docs, 5).collect()
    assert len(got) == len(rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter(
        (i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows
    )
    for shard in range(5):
        places = sorted(r.slot for r in got if r.shard == shard)
        assert places == list(range(len(places)))
    assert all(r.grown_shard in (r.shard, 5) for r in got)
    assert len({(r.doc_id, r.shard) for r in got}) == len({i for i, _ in rows})
    assert sharding.shard_documents(docs.limit(0), 5).collect() == []


def test_written_shards(spark, tmp_path):
    path = str(tmp_path / "shards")
    docs = keys(spark, 3000).selectExpr("doc_id", "'x' as text", "1 as slot")
    sharding.write_shards(docs, path, "doc_id", [1.0, 2.0], rows_per_file=400)
    back = spark.read.parquet(path)
    assert {r.doc_id: r.shard for r in back.collect()} == shards(docs, [1.0, 2.0])
    sizes = [r["count"] for r in back.groupBy(sharding.F.input_file_name()).count().collect()]
    assert max(sizes) <= 400 and sum(sizes) == 3000


def test_arguments(spark):
    for weights in ([], [0.0], [1.0, -1.0], [float("nan")], [float("inf")]):
        with pytest.raises(ValueError):
            sharding.assign_shards(keys(spark, 1), "doc_id", weights)
    with pytest.raises(ValueError):
        sharding.assign_shards(keys(spark, 1), "doc_id", [1.0], name="doc_id")
