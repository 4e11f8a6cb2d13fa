"""Operators on posts."""

import random

from pyspark.sql import functions as F

from feedsieve.operators import extract
from feedsieve.operators import posts as ops
from feedsieve.operators.extract import extract_post_details, find_posts
from feedsieve.schema import PAGE, PLACED_POST, RAW_POST

RAW_ROWS = [
    (1, 0, " a ", "Jane\n2nd", "u:1"),
    (1, 1, " \n", "Jane", "u:2"),
    (1, 2, "b", "", "u:3"),
    (1, 3, "c", "\nJane", "u:4"),
    (1, 4, None, "Jane", "u:5"),
    (1, 5, "d", None, "u:6"),
    (1, 6, "e", "Jane", None),
    (1, 7, "f", "Jane", ""),
]


def test_extraction_drops_posts_one_by_one(spark):
    df = extract_post_details(spark.createDataFrame(RAW_ROWS, RAW_POST), "http://h/")
    assert [tuple(r) for r in df.collect()] == [
        (1, 0, "a", "http://h/u:1", "Jane"),
        (1, 2, "b", "http://h/u:3", ""),
        (1, 3, "c", "http://h/u:4", ""),
    ]
    assert df.schema.names == PLACED_POST.names


def test_find_posts_over_batches(spark):
    def page(n):
        posts = "".join(
            f'<div class="feed-shared-update-v2" data-urn="{n}:{i}">'
            f'<span class="break-words">{"x" * 1000}{i}</span></div>'
            for i in range(n % 4)
        )
        return n, None, f"<html>{posts}</html>"

    pages = spark.createDataFrame([page(n) for n in range(40)] + [(99, None, None)], PAGE)
    got = {(r.page_id, r.pos, r.data_urn) for r in find_posts(pages).collect()}
    assert got == {(n, i, f"{n}:{i}") for n in range(40) for i in range(n % 4)}
    assert find_posts(pages.where("page_id < 0")).schema == RAW_POST


def test_find_posts_hands_on_what_it_has(spark, monkeypatch):
    monkeypatch.setattr(extract, "_FLUSH_CHARS", 10)
    post = '<div class="feed-shared-update-v2"><span class="break-words">12345678</span></div>'
    pages = spark.createDataFrame([(n, None, post * 2) for n in range(50)], PAGE).coalesce(1)
    assert find_posts(pages).count() == 100


def placed_posts(spark, rows):
    return spark.createDataFrame(rows, PLACED_POST)


def test_first_per_url_with_a_hot_url(spark):
    """A third of all rows share one url, and copies cross pages."""
    rng = random.Random(5)
    rows = []
    for n in range(6000):
        url = "hot" if n % 3 == 0 else f"u{rng.randint(0, 1500)}"
        rows.append((rng.randint(0, 300), n, f"content {n}", url, "p"))
    expected = {}
    for row in sorted(rows):
        expected.setdefault(row[3], row)
    rng.shuffle(rows)
    got = ops.first_per_url(placed_posts(spark, rows).repartition(7))
    assert sorted(map(tuple, got.collect())) == sorted(expected.values())


def test_search(spark):
    rows = [(1, 0, "Senior DATA scientist", "a", ""), (1, 1, "data engineer", "b", "")]
    posts = placed_posts(spark, rows)

    def urls(search):
        return [r.url for r in ops.search_posts(posts, search).collect()]

    assert urls("Scientist  data") == ["a"]
    assert urls("data") == ["a", "b"]
    assert urls("") == ["a", "b"]
    assert urls("nurse") == []


def test_latest_first_and_position(spark):
    rng = random.Random(3)
    rows = [(n, f"2024-01-{rng.randint(1, 28):02d} 10:00:00", f"u{n:04d}") for n in range(3000)]
    df = spark.createDataFrame(rows, "n int, at string, url string")
    df = df.withColumn("at", F.to_timestamp("at")).repartition(9)
    ordered = ops.latest_first(df, "at")
    expected = [r[2] for r in sorted(sorted(rows, key=lambda r: r[2]), key=lambda r: r[1], reverse=True)]
    assert [r.url for r in ordered.collect()] == expected
    numbered = {r.position: r.url for r in ops.with_position(ordered).collect()}
    assert [numbered[n] for n in range(1, 3001)] == expected


def test_limits(spark):
    pages = spark.createDataFrame([(n, None, "h") for n in (5, 3, 9, 1)], PAGE).repartition(3)
    assert [r.page_id for r in ops.limit_pages(pages, 2).collect()] == [1, 3]
    assert ops.limit_pages(pages, 9).count() == 4
    assert ops.limit_pages(pages.where("page_id < 0"), 2).count() == 0
    copies = pages.union(pages)
    assert [r.page_id for r in ops.limit_pages(copies, 3).collect()] == [1, 1, 3]
    posts = placed_posts(spark, [(n // 2, n % 2, "c", f"u{n}", "") for n in range(30)]).repartition(3)
    assert [r.url for r in ops.limit_posts(posts, 3).collect()] == ["u0", "u1", "u2"]
    assert ops.limit_posts(posts).count() == 30
    assert ops.limit_posts(posts, None).count() == 30


def test_union_keeps_copies_and_fills_missing_columns(spark):
    old = spark.createDataFrame([("a", 1), ("a", 1)], "url string, x int")
    new = spark.createDataFrame([(0, "a")], "hiring_post bigint, url string")
    got = ops.union_posts(old, new)
    assert got.columns == ["url", "x", "hiring_post"]
    assert sorted(map(tuple, got.collect()), key=repr) == [
        ("a", 1, None),
        ("a", 1, None),
        ("a", None, 0),
    ]


def test_filter_relevant(spark):
    rows = [(1, 0, "Hiring, send your CV", "a", ""), (1, 1, "hello", "b", "")]
    assert [r.url for r in ops.filter_relevant(placed_posts(spark, rows)).collect()] == ["a"]


def test_pages_without_an_id_come_last(spark):
    pages = spark.createDataFrame([(None, "a"), (1, "b"), (2, "c")], "page_id long, html string")
    for n, ids in ((0, []), (2, [1, 2]), (3, [1, 2, None]), (9, [1, 2, None])):
        assert [r.page_id for r in ops.limit_pages(pages, n).collect()] == ids
