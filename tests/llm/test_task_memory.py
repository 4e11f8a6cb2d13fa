"""What the tasks of the classifiers and of the packing hold in memory."""

import tracemalloc

import numpy as np
import pytest
import tokenizers

from feedsieve.llm import packing, parity_join, toxicity
from feedsieve.llm.text_blocks import BLOCK_BYTES


@pytest.mark.parametrize("size", [0, 2, 5, 1000, toxicity.PART_BYTES + 3, 3 * toxicity.PART_BYTES])
def test_running_sums_are_those_of_the_whole(size):
    rng = np.random.default_rng(size)
    data = rng.integers(32, 128, size).astype(np.uint8)
    table = rng.normal(size=1 << 12).astype(np.float32)
    for n in toxicity.NGRAMS:
        whole = np.concatenate([[0.0], np.cumsum(table[toxicity.gram_buckets(data, n, 12)])])
        assert np.array_equal(toxicity.running_sums(data, table, n, 12), whole)


def test_a_block_takes_a_bounded_multiple_of_its_bytes():
    data = np.frombuffer(b"subword " * (BLOCK_BYTES // 8), np.uint8)
    table = np.ones(1 << toxicity.BUCKET_BITS, np.float32)
    tracemalloc.start()
    toxicity.word_values(data, table, toxicity.BUCKET_BITS)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 32 * BLOCK_BYTES


def test_the_tokenizer_is_loaded_for_special_texts_only(monkeypatch):
    files = packing.tokenizer_files()
    special = packing.special_tokens(files[0])
    whole = tokenizers.Tokenizer.from_file(files[0])
    loaded = []

    class Counting:
        @staticmethod
        def from_file(path):
            loaded.append(path)
            return whole

    monkeypatch.setattr(tokenizers, "Tokenizer", Counting)
    encode = packing.load_encoder(*files, special)
    plain, spelt = "two words", f"two {special[0]} words"
    assert list(encode(plain)) == whole.encode(plain, add_special_tokens=False).ids and not loaded
    for _ in range(2):
        assert list(encode(spelt)) == whole.encode(spelt, add_special_tokens=False).ids
    assert len(loaded) == 1


def test_tables_of_the_join_have_as_many_files_as_the_documents_ask_for(spark, monkeypatch):
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(words[: 59 - i % 7] + [f"x{i % 40}"])) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    files, write = {}, parity_join.write_shared

    def counted(df, name):
        table = write(df, name)
        files[name] = max(files.get(name, 0), len(table.inputFiles()))
        return table

    held = {"spark.sql.shuffle.partitions": "97", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {key: spark.conf.get(key) for key in held}
    monkeypatch.setattr(parity_join, "write_shared", counted)
    try:
        for key, value in held.items():
            spark.conf.set(key, value)
        found = {r["doc_id"]: r["component_id"] for r in parity_join.join_documents(docs).collect()}
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert set(found.values()) == {0} and len(found) == 120
    least = spark.sparkContext.defaultParallelism
    assert {"groups", "near", "links"} <= set(files)
    assert max(files.values()) <= least


def test_files_grow_with_the_documents(spark):
    scratch = parity_join.Scratch(10 * parity_join.DOCS_PER_FILE)
    rows = spark.range(0, 1000, 1, 70)
    assert len(scratch.write(rows, "some").inputFiles()) == 10
    assert len(scratch.write(rows, "texts", parity_join.DOCS_PER_WORK_FILE).inputFiles()) == 50
    scratch.drop()
    assert parity_join.few_files(rows, 10**9, parity_join.DOCS_PER_FILE).rdd.getNumPartitions() == 70


def test_long_documents_count_as_several(spark):
    sizes = [0, 3, parity_join.LONG_SET, 10 * parity_join.LONG_SET]
    nodes = spark.createDataFrame([(n,) for n in sizes], "n long")
    assert parity_join.documents_in(nodes) == 13
    assert parity_join.documents_in(nodes.where("false")) == 0
