"""Physical plans: one shuffle, early filters, narrow scans."""

import re

import pytest
from pyspark.sql import functions as F

from feedsieve.functions.clients import RuleClient
from feedsieve.operators import posts as ops
from feedsieve.operators.classify import classify_jobs
from feedsieve.operators.extract import extract_post_details, find_posts
from feedsieve.plans import catalog, fixtures
from feedsieve.plans.run import RunOptions, plan_posts
from feedsieve.sources.pages import read_pages


def plan_of(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.split("== Initial Plan ==")[-1]


def lines(df):
    return [re.sub(r"^[\s:+*()\-0-9]+", "", line) for line in plan_of(df).splitlines()]


def index(found, start):
    return next(n for n, line in enumerate(found) if line.startswith(start))


@pytest.fixture
def pages(spark, sf_dir):
    return read_pages(spark, f"{sf_dir}/pages.parquet")


def test_first_per_url_limits_groups_on_both_sides_of_one_shuffle(spark, sf_dir):
    found = lines(ops.first_per_url(extract_post_details(fixtures.raw_posts(spark, sf_dir))))
    assert sum(line.startswith("Exchange") for line in found) == 1
    limits = [n for n, line in enumerate(found) if line.startswith("WindowGroupLimit")]
    exchange = index(found, "Exchange hashpartitioning(_w0")
    assert len(limits) == 2 and limits[0] < exchange < limits[1]


def test_extraction_reads_two_columns_and_does_not_shuffle(pages):
    plan = plan_of(extract_post_details(find_posts(pages)))
    assert "ReadSchema: struct<page_id:bigint,html:string>" in plan
    assert "Exchange" not in plan


def test_filters_come_before_the_model(pages):
    options = RunOptions(search_text="data", only_relevant=True)
    found = lines(classify_jobs(plan_posts(pages, options), RuleClient()))
    model = index(found, "MapInArrow run(page_id")
    assert all(n > model for n, line in enumerate(found) if line.startswith(("Filter", "Exchange")))
    assert sum(line.startswith("MapInArrow") for line in found) == 2
    assert sum(line.startswith("Exchange") for line in found) == 1


def test_scores_read_one_text_column(spark, sf_dir):
    plan = plan_of(catalog.is_job_post(spark, sf_dir))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_limited_pages_skip_the_rest_of_a_sorted_table(spark, tmp_path):
    path = str(tmp_path / "pages")
    html = F.repeat(F.lit("x"), 1000).alias("html")
    pages = spark.range(0, 4000, 1, 8).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), html)
    pages.write.parquet(path)
    limited = ops.limit_pages(read_pages(spark, path), 20)
    assert [r.page_id for r in limited.collect()] == list(range(20))
    plan = plan_of(limited)
    assert "TakeOrderedAndProject" in plan and "ReadSchema: struct<page_id:bigint>" in plan
    assert rows_read(limited) == 500


def rows_read(df):
    """Rows that came out of the scan of all columns."""
    found, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif node.nodeName().startswith("Scan parquet") and "html" in node.toString():
            found.append(node.metrics().apply("numOutputRows").value())
        else:
            children = node.children()
            todo += [children.apply(n) for n in range(children.size())]
            if hasattr(node, "plan") and "QueryStage" in node.getClass().getSimpleName():
                todo.append(node.plan())
    (count,) = found
    return count


@pytest.fixture
def settings(spark):
    """Set session options for one test."""
    changed = []

    def set_all(**options):
        for key, value in options.items():
            key = "spark.sql." + key.replace("__", ".")
            changed.append((key, spark.conf.get(key, None)))
            spark.conf.set(key, value)

    yield set_all
    for key, value in changed:
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_reused_answers_travel_by_digest(spark, sf_dir, settings):
    posts = extract_post_details(fixtures.raw_posts(spark, sf_dir))
    settings(autoBroadcastJoinThreshold=-1)
    found = lines(classify_jobs(posts, RuleClient(), reuse_answers=True))
    assert not any("BroadcastNestedLoop" in line or "Cartesian" in line for line in found)
    assert sum(line.startswith("Exchange hashpartitioning(_digest") for line in found) == 2


def test_a_text_with_many_copies_is_split(spark, settings):
    settings(
        autoBroadcastJoinThreshold=-1,
        adaptive__advisoryPartitionSizeInBytes="20KB",
        adaptive__skewJoin__skewedPartitionThresholdInBytes="40KB",
        adaptive__skewJoin__skewedPartitionFactor="1.5",
        shuffle__partitions=16,
    )
    hot = F.when(F.col("id") % 3 == 0, F.lit("hiring, send cv")).otherwise(F.col("id").cast("string"))
    posts = spark.range(0, 30_000, 1, 8).select("id", hot.alias("content"))
    labelled = classify_jobs(posts, RuleClient(), reuse_answers=True)
    counts = {row.hiring_post: row["count"] for row in labelled.groupBy("hiring_post").count().collect()}
    assert counts == {0: 20_000, 1: 10_000}
    labelled.collect()
    assert "skew=true" in labelled._jdf.queryExecution().executedPlan().toString()


def test_no_window_over_a_whole_table(spark, sf_dir):
    for name in ("latest_first", "dedup_posts", "limit_posts", "find_posts"):
        found = lines(catalog.QUERIES[name](spark, sf_dir))
        windows = [line for line in found if line.startswith("Window ")]
        for line in windows:
            assert "url#" in line or "_part#" in line, line


def test_shared_text_is_lowered_once_in_a_filter(spark, sf_dir):
    posts = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("text").alias("content"))
    (line,) = [line for line in lines(ops.filter_relevant(posts)) if line.startswith("Filter")]
    assert line.count("lower(") <= 4
