"""Operators on rows that are null, empty, long, tied, repeated or clash by name."""

import glob
import gzip
import hashlib
import random
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from feedsieve.llm import mixing, packing, suffix_dedup, warc

DOCS = "doc_id long, text string, lang string, source string"
CLASHES = ("_doc", "_tokens", "_topic", "text_id", "p", "k", "lo", "hi", "places", "piece", "length")


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "en", "src0") for i, t in texts], DOCS)


def with_clashes(table, names=CLASHES):
    return table.select("*", *(F.lit("x").alias(n) for n in names))


# --- op2: archives ---------------------------------------------------------------

PAGES = "page_id long, url string, html string"


def page_rows():
    same, small = "é" * 50, "s" * 99  # 100 bytes, and one less than that
    return [
        (5, "u:5", same), (3, "u:3", same), (9, None, same), (None, "u", same), (4, "u:4", small),
        (2, "u:2", small), (7, "u:7", None), (8, "u:8", ""), (1, "u:1\r\nX: y", "long\r\n\r\n" * 300_000),
        (6, "u:6", "WARC/1.1\r\n\r\n" + "w" * 200), (6, "u:6", "WARC/1.1\r\n\r\n" + "w" * 200),
    ]


def test_pages_come_back(spark, tmp_path):
    pages = with_clashes(
        spark.createDataFrame(page_rows(), PAGES), ("payload", "record_type", "_first", "payload_digest")
    )
    warc.write_warc(warc.page_records(pages), str(tmp_path / "w"), max_file_bytes=1000)
    got = []
    for r in warc.read_warc(spark, str(tmp_path / "w")).collect():
        page = int(r.record_id[10:-1]) if r.record_id != "<urn:page:>" else None
        got.append((page, r.record_type, r.refers_to, r.payload_digest, r.payload_bytes, r.payload))
    wanted = []
    for page, _, html in page_rows():
        data = (html or "").encode()
        revisit = data == b"\xc3\xa9" * 50 and page != 3
        kind = ("revisit", "<urn:page:3>") if revisit else ("response", None)
        kept = None if revisit else data
        wanted.append((page, *kind, hashlib.sha256(data).hexdigest(), len(data), kept))
    assert sorted(map(repr, ((*g[:-1], g[-1] and bytes(g[-1])) for g in got))) == sorted(
        repr((*w[:-1], w[-1] or w[-1])) for w in wanted
    )


def test_no_pages(spark, tmp_path):
    pages = spark.createDataFrame(page_rows(), PAGES).limit(0)
    warc.write_warc(warc.page_records(pages), str(tmp_path / "w"))
    assert warc.read_warc(spark, str(tmp_path / "w")).collect() == []


def test_unwanted_payloads_are_not_read(spark, tmp_path):
    """What header filters drop is not unpacked: its bytes may be broken."""
    noise = "".join(random.Random(4).choices("abcdefghij", k=60_000))
    rows = [(k, f"u:{k}", f"{noise}{k // 2}") for k in range(20)]
    path = str(tmp_path / "w")
    warc.write_warc(warc.page_records(spark.createDataFrame(rows, PAGES).coalesce(1)), path)
    for name in glob.glob(f"{path}/*.warc.gz"):
        data = bytearray(open(name, "rb").read())
        at = 0
        while at < len(data):
            length = warc.member_length(bytes(data[at : at + 64]))
            if length > 8192:
                data[at + 6000 : at + length - 8] = bytes(length - 6008)
            at += length
        open(name, "wb").write(data)
    revisits = warc.read_warc(spark, path, where={"record_type": "revisit"})
    assert sorted(r.refers_to for r in revisits.collect()) == sorted(f"<urn:page:{k}>" for k in range(0, 20, 2))
    both = {"target_uri": ["u:3", "u:4", "u:5"], "record_type": ["revisit"]}
    assert {r.target_uri for r in warc.read_warc(spark, path, where=both).collect()} == {"u:3", "u:5"}
    assert warc.read_warc(spark, path, where={"refers_to": None}, payload=False).count() == 10
    assert warc.read_warc(spark, path, payload=False).count() == 20
    with pytest.raises(Exception, match="record"):
        warc.read_warc(spark, path).collect()
    with pytest.raises(ValueError):
        warc.read_warc(spark, path, where={"payload_bytes": 3})


def test_filtered_frames_can_be_read_whole(spark, tmp_path):
    rows = [(k, f"u:{k}", "n" * 300 + f"{k // 2}") for k in range(20)]
    warc.write_warc(warc.page_records(spark.createDataFrame(rows, PAGES)), str(tmp_path / "w"))
    records = warc.read_warc(spark, str(tmp_path / "w"))
    revisits, others = (records.where(F.col("record_type") == t) for t in ("revisit", "response"))
    assert [x.count() for x in (records, revisits, records, others, records)] == [20, 10, 20, 10, 20]
    assert revisits.union(records).count() == 30 and records.union(others).count() == 30
    named = revisits.alias("a").join(records.alias("b"), F.expr("a.refers_to = b.record_id"))
    assert named.count() == 10


def test_archives_of_other_tools(spark, tmp_path):
    """Members without a note of their length, uncompressed archives, other record types."""
    page = {"record_type": "response", "record_id": "<a>", "target_uri": "u", "refers_to": None,
            "payload_digest": None, "payload_bytes": None, "payload": b"body\r\n\r\n" * 9000}
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <i>\r\nContent-Length: 5\r\n\r\nx: y\n\r\n\r\n"
    records = [info, warc.encode_record(page), warc.encode_record({**page, "record_id": "<b>"})]
    folder = tmp_path / "other"
    folder.mkdir()
    (folder / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    (folder / "b.warc").write_bytes(b"".join(records))
    found = warc.read_warc(spark, str(folder))
    got = sorted((r.record_type, r.record_id, r.payload and bytes(r.payload)) for r in found.collect() if r.payload)
    assert got == sorted([("response", i, page["payload"]) for i in ("<a>", "<b>")] * 2)
    assert found.where("record_type = 'warcinfo'").count() == 2
    assert found.where("record_id = '<b>'").count() == 2


# --- op4: repeated passages ------------------------------------------------------


def brute_removed(data):
    """Digest columns of each text, by looking at all windows."""
    seen = {}
    for i, b in enumerate(data):
        for at in range(len(b) - 199):
            seen.setdefault(b[at : at + 200], []).append((i, at))
    gone = [np.zeros(len(b), bool) for b in data]
    for places in seen.values():
        for i, at in places if len(places) > 1 else ():
            gone[i][at : at + 200] = True
    return [
        (len(b), int(g.sum()), int(g[:1].sum() + (g[1:] & ~g[:-1]).sum()),
         hashlib.sha256(np.frombuffer(b, np.uint8)[~g].tobytes()).hexdigest())
        for b, g in zip(data, gone)
    ]


def test_passages_in_awkward_rows(spark):
    rng = random.Random(5)
    words = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    common = words(40)
    texts = [words(rng.randrange(1, 30)) + common[rng.randrange(0, 40) :] + words(3) for _ in range(120)]
    texts += [common] * 30 + ["", None, "😀" * 49, "😀" * 50, "😀" * 50, words(30_000)]
    texts += [texts[-1][100_000:200_000] + words(5), "a" * 199, "a" * 50_000, "ab" * 20_000]
    table = with_clashes(documents(spark, list(enumerate(texts))))
    wanted = brute_removed([(t or "").encode() for t in texts])
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.remove_repeats(table.repartition(7)).collect()}
    assert [got[i] for i in range(len(texts))] == wanted
    assert suffix_dedup.remove_repeats(table.limit(0)).collect() == []


def test_rows_without_an_id_and_repeated_ids(spark):
    text = "".join(random.Random(6).choices("abcdef", k=300))
    rows = [(None, text), (1, text), (1, "short"), (1, "short")]
    got = suffix_dedup.remove_repeats(documents(spark, rows)).collect()
    assert sorted((r.n_bytes, r.n_removed, r.n_spans) for r in got) == [(5, 0, 0)] * 2 + [(300, 300, 1)] * 2


# --- op8: packing ----------------------------------------------------------------


def test_ids_are_those_of_the_tokenizer(spark, sf_dir):
    """Whole documents of the table, and texts of odd letters, by the other library."""
    from tokenizers import Tokenizer

    import public_tokenizers

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(7)
    letters = "abAB 01\n\t\r\x00\x85\xa0 '’.,éß한😀👩‍👩‍👧́‍﻿中文ا"
    texts = [row["text"] for row in pq.read_table(f"{sf_dir}/documents.parquet", columns=["text"]).to_pylist()]
    texts += ["".join(rng.choices(letters, k=rng.randrange(0, 60))) for _ in range(2000)]
    texts += [None, "", "<|endoftext|>", "a<|endoftext|> b", "x" * 5000, " " * 3000, "I'll we'VE 1234567"]
    table = with_clashes(documents(spark, list(enumerate(texts))))
    got = {}
    for r in packing.token_pieces(table).collect():
        got.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
    for i, text in enumerate(texts):
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        first = len(ids) % 1024 if len(ids) > 1024 else len(ids)
        cuts = [0, *range(first, len(ids) + 1, 1024)] if first else list(range(0, len(ids) + 1, 1024))
        wanted = [
            (k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))
        ]
        assert sorted(got[i]) == wanted, text


def test_packing_nears_the_bound(spark, sf_dir):
    rows = packing.pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()
    used = len({r.sequence_id for r in rows})
    assert used <= -(-sum(r.length for r in rows) // 1024) * 1.02 + 1
    assert packing.pack_documents(documents(spark, [(1, "a")]).limit(0)).collect() == []


# --- op10: mixing ----------------------------------------------------------------


def mixed_docs(spark):
    rng = random.Random(8)
    rows = []
    for i in range(6000):
        text = " ".join(["word"] * rng.randrange(1, 40))
        text += rng.choice(["", "", "", " copyright", " a@b.c"])
        lang = rng.choice(["en", "de", "fr", "es", None])
        rows.append((i, text, lang, "src0" if i % 3 == 0 else rng.choice(["s1", None])))
    return spark.createDataFrame(rows, DOCS)


def test_shares_against_brute_force(spark):
    docs = mixed_docs(spark)
    targets = mixing.Targets(keep=0.2)
    mixed = mixing.mix_documents(docs, targets)
    got = {(r.marginal, r.category): r for r in mixing.shares_reached(mixed, targets).collect()}
    rows = [(r["_source"], r["_lang"], r["_topic"], r["_tokens"], r["_probability"], r["_drawn"], r["_doc"])
            for r in mixed.collect()]
    assert len(rows) == 6000 and {len(r[6].text.split()) for r in rows if r[3] == 3} == {3}
    total = sum(r[3] * r[4] for r in rows)
    for axis, marginal in enumerate(mixing.MARGINALS):
        shares = getattr(targets, marginal)
        for category, target in shares.items():
            row = got[marginal, category]
            expected = sum(r[3] * r[4] for r in rows if r[axis] == category) / total
            drawn = sum(r[3] for r in rows if r[axis] == category and r[5]) / sum(r[3] for r in rows if r[5])
            assert np.isclose(row.expected, expected) and np.isclose(row.drawn, drawn)
            assert abs(row.expected - target) < 2e-3 and abs(row.drawn - target) < 0.03
            assert row.met == (abs(row.expected - target) <= mixing.SHARE_TOLERANCE)
    assert abs(total / sum(r[3] for r in rows) - 0.2) < 1e-3


def test_targets_that_cannot_be_met_are_told(spark):
    targets = mixing.Targets(lang={"en": 0.9, mixing.REST: 0.1}, keep=0.8)
    mixed = mixing.mix_documents(mixed_docs(spark), targets)
    got = {(r.marginal, r.category): r for r in mixing.shares_reached(mixed, targets).collect()}
    english = got["lang", "en"]
    assert not english.met and english.corpus < english.expected < 0.5 and english.target == 0.9
    # Where cells suffice, all targets are met.
    easy = mixing.Targets(lang={"en": 0.3, mixing.REST: 0.7}, keep=0.1)
    mixed = mixing.mix_documents(mixed_docs(spark), easy)
    assert all(r.met for r in mixing.shares_reached(mixed, easy).collect())


def test_draws_of_awkward_rows(spark):
    docs = mixed_docs(spark).limit(50)
    odd = spark.createDataFrame([(None, None, None, None), (1, "", "en", "src0"), (2, " \n", "xx", "")], DOCS)
    table = with_clashes(docs.union(docs).union(odd))
    rows = mixing.mix_documents(table).collect()
    assert len(rows) == 103 and min(r["_tokens"] for r in rows) == 1
    by_row = {}
    for r in rows:
        by_row.setdefault((r["_doc"].doc_id, r["_doc"].text), set()).add(r["_drawn"])
    assert all(len(drawn) == 1 for drawn in by_row.values())  # repeated rows go together
    sample = mixing.sample_mix(table)
    assert sample.columns == table.columns
    assert sorted(map(repr, sample.collect())) == sorted(map(repr, mixing.sample_mix(table).collect()))
    empty = mixing.mix_documents(table.limit(0))
    assert empty.collect() == []
    assert {(r.expected, r.drawn) for r in mixing.shares_reached(empty).collect()} == {(0.0, 0.0)}
