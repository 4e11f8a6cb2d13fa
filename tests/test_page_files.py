"""Files of arriving pages: bounded, and whole batches of them."""

import duckdb
import pytest
from pyspark.sql import functions as F

from feedsieve.plans import catalog

ROWS = [(n, "word " * (n % 7), "src1") for n in range(900)] + [(None, "lost", "src1")]


@pytest.fixture
def documents(spark, tmp_path):
    # Two ids occur twice; texts of one remainder are longer than those of the others.
    rows = ROWS + [ROWS[41], ROWS[48]]
    rows += [(n, "long " * 400, "src1") for n in range(900, 1500) if n // 20 % 3 == 1]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(
        str(tmp_path / "documents.parquet")
    )
    return str(tmp_path)


def pages_by_file(spark, path):
    name = F.input_file_name()
    files = spark.read.parquet(path).groupBy(name.alias("name")).agg(F.collect_list("page_id").alias("ids"))
    return {row.name: set(row.ids) for row in files.collect()}


def test_batches_are_the_remainders(spark, documents, monkeypatch):
    monkeypatch.setattr(catalog, "FILE_BYTES", 20_000)
    path, n_files = catalog._page_files(spark, documents)
    assert n_files > 1
    arrived = [s.getPath().getName() for s in catalog._arrived(spark, path)]
    assert len(arrived) == catalog.STREAM_FILES * n_files
    found = {name.rpartition("/")[2]: ids for name, ids in pages_by_file(spark, path).items()}
    for n in range(catalog.STREAM_FILES):
        batch = arrived[n * n_files : (n + 1) * n_files]
        assert {page % catalog.STREAM_FILES for name in batch for page in found.get(name, ())} == {n}
    assert max(len(ids) for ids in found.values()) <= 12  # of 25 pages in a remainder


def test_ranges_are_bounded(spark, documents, monkeypatch):
    monkeypatch.setattr(catalog, "FILE_BYTES", 60_000)
    path, n_files = catalog._page_ranges(spark, documents, 2)
    found = pages_by_file(spark, path)
    assert n_files > 1 and len(found) > 4
    assert max(map(len, found.values())) <= 20
    assert sum(map(len, found.values())) == len(set().union(*found.values()))


@pytest.mark.parametrize(
    "name", ["run_two_streams", "stream_replay", "batch_progress", "stream_backlog", "stream_batch_numbers"]
)
def test_results_do_not_depend_on_the_files(spark, documents, monkeypatch, name):
    monkeypatch.setattr(catalog, "FILE_BYTES", 150_000)
    df = catalog.QUERIES[name](spark, documents)
    connection = duckdb.connect()
    connection.execute(f"create view documents as select * from '{documents}/documents.parquet/*.parquet'")
    relation = connection.sql(catalog.ORACLES[name])
    columns = sorted(df.columns)
    places = [relation.columns.index(column) for column in columns]
    expected = sorted(repr(tuple(row[p] for p in places)) for row in relation.fetchall())
    assert sorted(repr(tuple(row)) for row in df.select(*columns).collect()) == expected
