"""Operators on posts: search, order, limit, de-duplicate, unite, filter."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.fixed_values import JOB_KEYWORDS
from ..session import write_shared


def search_posts(posts, search_text):
    """Posts whose content holds every blank-separated term, case ignored.

    An empty search keeps all posts.
    """
    return posts.where(text.mentions_all("content", search_text.lower().split()))


def latest_first(posts, ts_col):
    """Posts by falling time; the url decides between equal times."""
    return posts.orderBy(F.col(ts_col).desc(), "url")


def with_position(ordered, name="position"):
    """Number the rows of an ordered DataFrame from 1, without a one-task window.

    The ordered rows are written with ids that rise along the partitions; the
    size of each partition then turns them into positions.  Only one number per
    partition is gathered, so the second window is as small as the plan.
    """
    row_bits = 33  # monotonically_increasing_id: partition number, then row number
    numbered = write_shared(ordered.withColumn("_id", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("_id", row_bits)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        numbered.groupBy(part.alias("_part"))
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    )
    # One row per partition of the sort: small enough to broadcast at any scale.
    return (
        numbered.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_before") + F.col("_id").bitwiseAND((1 << row_bits) - 1) + 1)
        .select(*ordered.columns, name)
    )


def limit_pages(pages, n):
    """The first ``n`` pages.

    The ids alone decide where to stop, and the scan skips what lies behind:
    the HTML of the other pages is not read where the table is sorted by id.
    Pages without an id come last, and fill up what is missing to ``n``.
    """
    numbered = F.col("page_id").isNotNull()
    first_ids = pages.select("page_id").where(numbered).orderBy("page_id").limit(n)
    last_id = first_ids.agg(F.max("page_id")).scalar()
    first = pages.where(F.col("page_id") <= last_id).union(pages.where(~numbered).limit(n))
    return first.orderBy(F.col("page_id").asc_nulls_last()).limit(n)


def limit_posts(posts, n=None):
    """The first ``n`` posts in document order; ``None`` keeps all."""
    return posts if n is None else posts.orderBy("page_id", "pos").limit(n)


def first_per_url(posts):
    """The first post per url in document order.

    One shuffle.  Spark puts a group limit of one below it, so a task sends at
    most one row per url: a url that holds a third of all rows arrives as one
    row per task.  The hash in front of the url is for the sort: urls have long
    common beginnings, hashes are told apart by their first bytes.  The last two
    sort columns only settle equal places.
    """
    order = Window.partitionBy(F.xxhash64("url"), "url").orderBy(
        "page_id", "pos", "profile_name", "content"
    )
    return (
        posts.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") == 1).drop("_rank")
    )


def union_posts(old, new):
    """All rows of both, columns matched by name, missing ones null."""
    return old.unionByName(new, allowMissingColumns=True)


def filter_relevant(posts, keywords=JOB_KEYWORDS):
    """Keep the posts that pass the job-post test; an opt-in step of the run."""
    return posts.where(text.is_relevant_post("content", keywords))
