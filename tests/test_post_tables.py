"""CSV and Parquet tables of posts."""

import glob
import os

import pandas as pd
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from feedsieve.schema import LABELLED_POST, POST
from feedsieve.sources.post_tables import (
    PostSink,
    append_core_csv,
    append_posts_csv,
    csv_columns,
    read_posts_csv,
    write_posts_csv,
)

TEXTS = [
    'comma, "quote"\nand line', "ends with \\", "a\r\nb", "a\rb", " outer ", "#c", "NA", "N/A", "x",
    '"', '""', "\\\"", "\t", "null", "1.0", "'", "a;b|c", " ", "é́ 日本",
]


def labelled(spark, start=0):
    rows = [(text, f"u{start + n}", "p", n - 1) for n, text in enumerate(TEXTS)]
    return spark.createDataFrame(rows, LABELLED_POST)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_csv_keeps_any_text(spark, tmp_path):
    path = str(tmp_path / "t")
    write_posts_csv(labelled(spark).repartition(3), path)
    assert rows(read_posts_csv(spark, path)) == rows(labelled(spark))


def test_csv_is_readable_by_pandas(spark, tmp_path):
    path = str(tmp_path / "t")
    write_posts_csv(labelled(spark).coalesce(1), path)
    (part,) = glob.glob(f"{path}/part-*.csv")
    frame = pd.read_csv(part, keep_default_na=False, lineterminator=None)
    assert list(frame.columns) == LABELLED_POST.names
    assert len(frame) == len(TEXTS)
    assert list(frame["url"]) == [f"u{n}" for n in range(len(TEXTS))]


def test_csv_written_by_pandas(spark, tmp_path):
    """A label column that once held a gap comes with decimals."""
    frame = pd.DataFrame(
        {"content": ["a\nb", "c"], "url": ["u1", "u2"], "profile_name": ["p", ""], "hiring_post": [1.0, None]}
    )
    frame.to_csv(tmp_path / "t.csv", index=False)
    got = rows(read_posts_csv(spark, str(tmp_path / "t.csv")))
    assert got == [("a\nb", "u1", "p", 1), ("c", "u2", None, None)]


def test_bad_csv_is_an_error(spark, tmp_path):
    (tmp_path / "label.csv").write_text("content,url,profile_name,hiring_post\na,u,p,yes\n")
    (tmp_path / "header.csv").write_text("content,url,name,hiring_post\na,u,p,1\n")
    (tmp_path / "short.csv").write_text("content,url,profile_name,hiring_post\na,u\n")
    for name in ("label", "header", "short"):
        with pytest.raises(Exception):
            read_posts_csv(spark, str(tmp_path / f"{name}.csv")).collect()


def test_empty_text_and_null_are_one_in_csv(spark, tmp_path):
    df = spark.createDataFrame([("c", "u", ""), ("c", "v", None)], POST)
    write_posts_csv(df, str(tmp_path / "t"))
    assert {r.profile_name for r in read_posts_csv(spark, str(tmp_path / "t"), POST).collect()} == {None}
    sink = PostSink(str(tmp_path / "p"))
    sink.write(df)
    assert {r.profile_name for r in sink.read(spark, POST).collect()} == {"", None}


def test_append_returns_old_and_new_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    assert csv_columns(spark, path) is None
    first = append_posts_csv(labelled(spark), path)
    assert first.count() == len(TEXTS)
    second = labelled(spark, 100).select("hiring_post", "profile_name", "url", "content")
    both = append_posts_csv(second, path)
    expected = labelled(spark).unionByName(labelled(spark, 100))
    assert rows(both.select(*LABELLED_POST.names)) == rows(expected)
    assert append_posts_csv(labelled(spark), path).count() == 3 * len(TEXTS)


def test_append_with_other_columns(spark, tmp_path):
    path, union_path = str(tmp_path / "t"), str(tmp_path / "u")
    append_posts_csv(labelled(spark), path)
    new = labelled(spark, 100).drop("hiring_post").withColumnRenamed("profile_name", "name")
    both = append_posts_csv(new, path, union_path)
    assert both.columns == [*LABELLED_POST.names, "name"]
    assert both.where("name is null").count() == both.where("hiring_post is null").count() == len(TEXTS)
    assert dict(both.dtypes)["hiring_post"] == "bigint"
    assert read_posts_csv(spark, path).count() == len(TEXTS)
    with pytest.raises(AnalysisException):
        append_posts_csv(new, path, union_path)
    assert read_posts_csv(spark, union_path, both.schema).count() == 2 * len(TEXTS)


def test_append_core(spark, tmp_path):
    path = str(tmp_path / "t")
    append_core_csv(labelled(spark), path)
    append_core_csv(labelled(spark), path)
    assert csv_columns(spark, path) == POST.names
    assert rows(read_posts_csv(spark, path, POST)) == sorted(rows(labelled(spark).select(*POST.names)) * 2, key=repr)


@pytest.mark.parametrize("format", ["csv", "parquet"])
def test_sink_batches_replace_themselves(spark, tmp_path, format):
    sink = PostSink(str(tmp_path / "t"), format)
    sink.write(labelled(spark), batch_id=0)
    sink.write(labelled(spark, 100), batch_id=1)
    sink.write(labelled(spark, 100), batch_id=1)
    expected = labelled(spark).unionByName(labelled(spark, 100))
    got = sink.read(spark)
    assert got.columns == LABELLED_POST.names
    assert rows(got) == rows(expected)


@pytest.mark.parametrize("format", ["csv", "parquet"])
def test_sink_appends(spark, tmp_path, format):
    sink = PostSink(str(tmp_path / "t"), format)
    sink.write(labelled(spark))
    sink.write(labelled(spark))
    assert sink.read(spark).count() == 2 * len(TEXTS)
    with pytest.raises(ValueError):
        PostSink("x", "orc")


def test_parquet_sinks_take_new_columns(spark, tmp_path):
    sink = PostSink(str(tmp_path / "t"))
    sink.write(labelled(spark).drop("hiring_post"))
    sink.write(labelled(spark, 100), batch_id=0, run_id="r")
    assert sink.read(spark).where("hiring_post is null").count() == len(TEXTS)
    assert sink.total(spark) == 2 * len(TEXTS)


def files_of(path):
    return {f: os.path.getmtime(f) for f in glob.glob(f"{path}/**/*.csv", recursive=True)}


def test_csv_tables_take_new_columns(spark, tmp_path):
    """New columns get a folder of their own; no file is written again."""
    path = str(tmp_path / "t")
    append_posts_csv(labelled(spark).drop("hiring_post"), path)
    before = files_of(path)
    both = append_posts_csv(labelled(spark, 100), path)
    assert both.columns == LABELLED_POST.names
    expected = labelled(spark).withColumn("hiring_post", F.lit(None).cast("long")).unionByName(labelled(spark, 100))
    assert rows(both) == rows(expected)
    assert before.items() <= files_of(path).items()
    again = append_posts_csv(labelled(spark, 200).withColumn("more", F.lit(None).cast("string")), path)
    assert again.columns == [*LABELLED_POST.names, "more"] and again.count() == 3 * len(TEXTS)
    assert append_posts_csv(labelled(spark).drop("hiring_post"), path).count() == 4 * len(TEXTS)


def test_csv_sinks_take_new_columns(spark, tmp_path):
    sink = PostSink(str(tmp_path / "c"), "csv")
    sink.write(labelled(spark).drop("hiring_post"), batch_id=0, run_id="r")
    before = files_of(sink.path)
    sink.write(labelled(spark, 100), batch_id=1, run_id="r")
    assert before.items() <= files_of(sink.path).items()
    assert sink.read(spark).where("hiring_post is null").count() == len(TEXTS)
    assert sink.total(spark) == 2 * len(TEXTS)
    assert [sink.batch_total(spark, "r", n) for n in (0, 1, 2)] == [len(TEXTS), len(TEXTS), 0]
    batches = sink.read(spark, batches=True)
    assert {tuple(r) for r in batches.select("run", "batch_id").collect()} == {("r", 0), ("r", 1)}
    # A later attempt of a batch replaces the earlier one, also with other columns.
    sink.write(labelled(spark), batch_id=0, run_id="r")
    assert rows(sink.read(spark)) == rows(labelled(spark).unionByName(labelled(spark, 100)))


def test_csv_table_without_notes(spark, tmp_path):
    path = str(tmp_path / "t")
    write_posts_csv(labelled(spark).drop("hiring_post"), path)
    assert append_posts_csv(labelled(spark, 100), path).count() == 2 * len(TEXTS)
