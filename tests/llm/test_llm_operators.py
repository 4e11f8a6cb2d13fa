"""The training-data operators against brute force, SQL and awkward rows."""

import hashlib
import re
import time
import zlib

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from pyspark.sql import functions as F
from feedsieve.llm import binary_codes, hnsw, mixing, packing, parity_join, queries, secrets, suffix_dedup

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts):
    rows = [(i, t, "en", "src0", None if t is None else len(t)) for i, t in texts]
    return spark.createDataFrame(rows, DOCS)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_equal_their_sql(spark, sf_dir, name):
    got = queries.QUERIES[name](spark, sf_dir)
    db = duckdb.connect()
    for table in ("documents", "pages", "conversations"):
        db.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    wanted = db.execute(queries.ORACLES[name]).fetchall()
    order = [c[0] for c in db.description]
    rows = [tuple(r) for r in got.select(*order).collect()]
    assert sorted(rows, key=repr) == sorted(wanted, key=repr)


def brute_parts(texts):
    """Shingle counts and components by comparing all pairs."""
    sets, part = {}, {i: i for i, _ in texts}
    for i, text in texts:
        words = (text or "").encode().lower().split()
        many = [tuple(words[k : k + 5]) for k in range(len(words) - 4)] or [tuple(words)]
        sets[i] = set(many) if words else set()
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * len(sets[a] | sets[b]):
                old, new = max(part[a], part[b]), min(part[a], part[b])
                part = {k: new if v == old else v for k, v in part.items()}
    return {i: (len(sets[i]), part[i]) for i in sets}


def near_texts():
    rng = np.random.default_rng(5)
    base = [f"w{n}" for n in rng.integers(0, 500, 120)]
    texts = [(0, None), (1, ""), (2, " \t"), (3, "One two"), (4, "one TWO"), (5, "one three")]
    for i in range(6, 40):
        words = list(base)
        for at in rng.integers(0, len(words), i % 7):
            words[at] = f"x{rng.integers(0, 9)}"
        texts.append((i, " ".join(words)))
    texts += [(i, " ".join(f"w{n}" for n in rng.integers(0, 500, 60))) for i in range(40, 60)]
    return texts + [(60, texts[-1][1]), (61, "very long " * 20000)]


def test_join_finds_all_links(spark):
    texts = near_texts()
    got = parity_join.join_documents(documents(spark, texts)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_parts(texts)


def test_crowds_lose_no_near_pair(spark, monkeypatch):
    monkeypatch.setattr(parity_join, "TILE", 7)
    rng = np.random.default_rng(3)
    base, sets = rng.integers(0, 2**64, 900, dtype=np.uint64), {}
    for node in range(60):
        own = rng.integers(0, 2**64, int(rng.integers(0, 200)), dtype=np.uint64)
        sets[node] = np.unique(np.concatenate([base[: rng.integers(30, 900)], own]))
    rows = [(k, len(v), bytearray(parity_join.dense_sketch(v))) for k, v in sets.items()]
    nodes = spark.createDataFrame(rows, "node long, n long, sketch binary")
    crowd = [(t, k, k % 9) for t in (1, 2) for k in sets]
    members = spark.createDataFrame(crowd, "token long, node long, part long")
    got = parity_join.compare_crowds(members, nodes).distinct().collect()
    sketch = {k: parity_join.dense_sketch(v) for k, v in sets.items()}
    wanted = {
        (a, b)
        for a in sets
        for b in sets
        if a < b and a % 9 != b % 9
        and 3 * max(len(sets[a]), len(sets[b])) <= 4 * min(len(sets[a]), len(sets[b]))
        and 7 * parity_join.hamming(sketch[a], sketch[b]) <= len(sets[a]) + len(sets[b])
    }
    assert {(min(r.u, r.v), max(r.u, r.v)) for r in got} == wanted and wanted


def test_one_of_each_group_stays(spark):
    texts = near_texts()
    parts = brute_parts(texts)
    docs = documents(spark, texts)
    kept = parity_join.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    wanted = sorted(i for i, (_, part) in parts.items() if i == part)
    assert sorted(r.doc_id for r in kept.collect()) == wanted


def test_repeated_passages_go(spark):
    rng = np.random.default_rng(7)
    words = lambda n: " ".join(f"ü{k}" for k in rng.integers(0, 10**6, n))
    shared, other = words(60), words(60)
    texts = [
        (0, None), (1, ""), (2, "short"), (3, words(40) + shared + words(40)),
        (4, shared + words(9)), (5, other + words(30) + other), (6, "ab" * 150),
        (7, words(50)), (8, "z" * 199), (9, "z" * 199), (10, "q" * 200), (11, "q" * 200),
    ]
    data = {i: (t or "").encode() for i, t in texts}
    seen = {}
    for i, b in data.items():
        for at in range(len(b) - 199):
            seen.setdefault(b[at : at + 200], []).append((i, at))
    gone = {i: np.zeros(len(b), bool) for i, b in data.items()}
    for places in seen.values():
        for i, at in places if len(places) > 1 else ():
            gone[i][at : at + 200] = True
    for row in suffix_dedup.remove_repeats(documents(spark, texts)).collect():
        b, g = data[row.doc_id], gone[row.doc_id]
        kept = bytes(x for x, out in zip(b, g) if not out)
        spans = int(g[:1].sum() + (g[1:] & ~g[:-1]).sum())
        assert tuple(row)[1:] == (len(b), int(g.sum()), spans, hashlib.sha256(kept).hexdigest())


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_vectors_link_by_cosine(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 16)).astype(np.float32)
    x[30:] = x[:30] + 0.25 * rng.normal(size=(30, 16))
    rows = [(i, v.tolist(), i % 2) for i, v in enumerate(x)]
    rows += [(60, None, 0), (61, [0.0] * 16, 0), (62, [float("nan")] * 16, 0), (63, rows[0][1], None)]
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = unit @ unit.T >= 0.93
    near &= np.equal.outer(np.arange(60) % 2, np.arange(60) % 2) & ~np.eye(60, dtype=bool)
    got = {r.vec_id: r for r in binary_codes.near_duplicates(vectors(spark, rows)).collect()}
    assert sorted(got) == list(range(64))
    for i in range(64):
        assert got[i].n_links == (near[i].sum() if i < 60 else 0)
        assert got[i].kept == (got[i].component_id == i)
    assert all(got[i].component_id == got[j].component_id for i, j in zip(*np.nonzero(near)))


def test_nearest_vectors_are_found(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 12)).astype(np.float32)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(400, None, 0), (500, [0.0] * 12, 0)]
    got = {}
    for r in hnsw.nearest_neighbours(vectors(spark, rows)).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    assert sorted(got) == [0, 100, 200, 300]
    hits = 0
    for q, found in got.items():
        dist = ((x.astype(float) - x[q].astype(float)) ** 2).sum(1)
        dist[q] = np.inf
        assert [r for r, _ in sorted(found)] == list(range(1, 11))
        hits += len(set(np.argsort(dist)[:10]) & {v for _, v in found})
    assert hits >= 36


def recall(spark, x, shard_rows=hnsw.SHARD_ROWS, extra=()):
    """Share of the ten nearest by distance that a search finds, and all its rows."""
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + list(extra)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    rows = hnsw.comparable(table)
    index = hnsw.build_index(rows, 11, shard_rows)
    got = {}
    for r in hnsw.search(index, rows.where("vec_id % 100 = 0")).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hits = wanted = 0
    for q in range(0, len(x), 100):
        apart = x.astype(float) - x[q].astype(float)
        dist = np.abs(apart).max(1, keepdims=True)
        dist = (dist * np.sqrt(((apart / np.where(dist > 0, dist, 1)) ** 2).sum(1, keepdims=True)))[:, 0]
        dist[q] = np.inf
        best = np.sort(dist)[: min(10, len(x) - 1)]
        found = sorted(got[q])
        assert [r for r, _, _ in found] == list(range(1, len(best) + 1))
        assert all(np.isclose(s, dist[v], rtol=1e-12) for _, v, s in found)
        assert [(s, v) for _, v, s in found] == sorted((s, v) for _, v, s in found)
        hits += sum(s <= b * (1 + 1e-12) for (_, _, s), b in zip(found, best))
        wanted += len(best)
    return hits / wanted, got


def test_equal_vectors_hide_no_neighbours(spark):
    x = np.random.default_rng(6).normal(size=(3500, 16)).astype(np.float32)
    x[250:3250] = x[250]
    x[3300:] = x[3300]  # a second group
    share, got = recall(spark, x)
    assert share >= 0.9
    assert [v for _, v, _ in sorted(got[300])] == list(range(250, 260))
    assert [v for _, v, _ in sorted(got[3300])] == list(range(3301, 3311))


def test_near_copies_hide_no_neighbours(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(3500, 16))
    x[500:] = x[500] + 1e-3 * rng.normal(size=(3000, 16))
    assert recall(spark, x)[0] >= 0.9


@pytest.mark.parametrize("size", [1e22, 1e-30, 1e200, 1e-200])
def test_neighbours_of_any_size(spark, size):
    x = np.random.default_rng(8).normal(size=(130, 8)) * size
    assert recall(spark, x)[0] == 1


def test_neighbours_over_several_shards(spark):
    x = np.random.default_rng(9).normal(size=(3000, 16)).astype(np.float32)
    x[100] *= 1e20
    awkward = [(3000, None, 0), (3100, [0.0] * 16, 0), (3200, [float("inf")] * 16, 0), (7, None, 1)]
    share, got = recall(spark, x, 700, awkward)
    assert share >= 0.9
    assert sorted(got) == list(range(0, 3000, 100))
    assert hnsw.nearest_neighbours(vectors(spark, []).limit(0)).collect() == []


def test_packing_loses_nothing(spark):
    texts = [(0, None), (1, ""), (2, "a b c"), (2, "a b c"), (3, "long words " * 3000)]
    rows = packing.pack_documents(documents(spark, texts)).collect()
    assert {r.ids_crc32 for r in rows if r.doc_id in (0, 1)} == {zlib.crc32((2).to_bytes(4, "little"))}
    filled = {}
    for r in rows:
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in filled.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    pieces = sorted((r.piece, r.start, r.length) for r in rows if r.doc_id == 3)
    assert all(n == 1024 for _, _, n in pieces[1:])
    assert [s for _, s, _ in pieces] == list(np.cumsum([0] + [n for _, _, n in pieces[:-1]]))


def test_secrets_are_masked(spark):
    texts = [(0, None), (1, ""), (2, "password = hunter22x"), (3, "token: abc"), (4, "x " * 50000)]
    got = {r.doc_id: r for r in secrets.scan_secrets(documents(spark, texts)).collect()}
    assert {i: r.n_assign for i, r in got.items()} == {0: 0, 1: 0, 2: 1, 3: 0, 4: 0}
    masked = {r.doc_id: r.text for r in secrets.mask_secrets(documents(spark, texts)).collect()}
    assert "hunter22x" not in masked[2]
    assert [masked[i] for i in (0, 1, 3, 4)] == [t for i, t in texts if i != 2]


def brute_spans(text):
    """All spans of the rules, by Python's own matching."""
    found = []
    for number, rule in enumerate(secrets.ALL_RULES):
        for m in re.finditer(rule.pattern, text, re.ASCII):
            if len(m[rule.group]) >= rule.min_length:
                found.append((m.start(), number, m.end()))
    return sorted(found)


def brute_mask(text):
    out, at = [], 0
    for start, _, end in brute_spans(text):
        if start >= at:
            out += [text[at:start], "[SECRET]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def secret_texts():
    rng = np.random.default_rng(10)
    parts = [
        "password=", "api_key: ", "Token='", "AKIA", "ABCDEFGH01234567", "deadbeef" * 3, "0123456789",
        " ", "\n", "é", "😀", "eyJ", "eyJhbGciOi.eyJzdWIiOiIx.", "abcdefghijklmnopqrstuv_-", ".", "'",
        "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a1" * 18, "x" * 1500,
    ]
    texts = ["".join(rng.choice(parts, rng.integers(1, 60))) for _ in range(300)]
    # More matches than a block holds, and ends at the borders of pages.
    texts.append("password=hunter22 " * 1000)
    texts += ["y" * (n - 17) + "password=hunter22" + "z" * m for n in (1023, 1024, 1025) for m in (0, 1, 1024)]
    return texts + ["", None, "deadbeef" * 400, "password=" + "deadbeef" * 300 + "AKIA" + "Z" * 30]


def test_secrets_equal_brute_force(spark):
    names = [rule.kind for rule in secrets.ALL_RULES]
    texts = secret_texts()
    table = documents(spark, list(enumerate(texts)))
    # Repeated rows, a null id, and columns named like those inside.
    table = table.union(table.where("doc_id < 5")).union(
        documents(spark, [(None, "secret=abcdef12")])
    )
    for name in ("_key", "_doc", "spans", "_spans", "gram", "start"):
        table = table.withColumn(name, F.lit(7))
    got = {}
    for r in secrets.scan_secrets(table).collect():
        got.setdefault(r.doc_id, []).append(r.spans)
    assert got.pop(None) == ["assign:0:15"]
    for i, text in enumerate(texts):
        wanted = ",".join(f"{names[k]}:{a}:{b}" for a, k, b in brute_spans(text or ""))
        assert got[i] == [wanted] * (2 if i < 5 else 1)
    masked = secrets.mask_secrets(table)
    assert masked.columns == table.columns
    for r in masked.where("doc_id is not null").collect():
        text = texts[r.doc_id]
        assert r.text == (None if text is None else brute_mask(text))
        assert r["_key"] == 7 and r["start"] == 7
    assert secrets.scan_secrets(table.limit(0)).collect() == []


def test_long_texts_full_of_secrets_take_linear_time(spark):
    texts = ["eyJ" * 350_000, "eyJ-" * 250_000, "password=hunter22, " * 100_000, "eyJa.eyJ" * 120_000]
    table = documents(spark, list(enumerate(texts)))
    start = time.monotonic()
    got = {r.doc_id: r.n_assign for r in secrets.scan_secrets(table).collect()}
    assert got == {0: 0, 1: 0, 2: 100_000, 3: 0}
    masked = {r.doc_id: r.text for r in secrets.mask_secrets(table).collect()}
    assert masked[0] == texts[0]
    assert masked[2] == "[SECRET], " * 100_000
    assert time.monotonic() - start < 40


def test_raking_meets_the_marginals():
    tokens = np.random.default_rng(1).integers(10, 1000, (3, 2, 2)).astype(float)
    shares = [np.array([0.5, 0.3, 0.2]), np.array([0.6, 0.4]), np.array([0.5, 0.5])]
    mass = tokens * mixing.rake(tokens, shares, keep=0.05)
    for axis, share in enumerate(shares):
        rest = tuple(k for k in range(3) if k != axis)
        assert np.allclose(mass.sum(rest) / mass.sum(), share, atol=0.01)


def test_held_out_accuracy(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    for name, label in (("op1_quality_compression", "quality"), ("op6_toxicity_subwords", "toxic")):
        rows = queries.QUERIES[name](spark, sf_dir).join(labels, "doc_id").collect()
        assert all(0 <= r.score <= 1 for r in rows)
        out = [r for r in rows if r.held_out and r[label] is not None]
        assert sum(r.predicted == r[label] for r in out) >= 0.8 * len(out)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_take_empty_and_null_rows(spark, sf_dir, name, stage):
    docs = spark.createDataFrame(
        [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0)], DOCS
    )
    for table, most in ((docs, 3), (docs.limit(0), 0)):
        out = stage(spark, table, sf_dir)
        assert len(out.collect()) <= most
        assert name == "packing" or out.columns == docs.columns
