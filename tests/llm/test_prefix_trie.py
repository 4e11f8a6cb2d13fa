"""The prefix trie against brute force, with bands and blocks of awkward sizes."""

import hashlib
import zlib

import numpy as np
import pytest

from feedsieve.llm import prefix_trie

TURNS = "conv_id long, turn long, role string, text string"


def in_order(rows):
    found = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            digest = hashlib.sha256((text or "").encode()).hexdigest()
            key = (turn is not None, turn or 0, role or "", digest)
            found.setdefault(conv, []).append((key, (role or "", text or "")))
    return {c: [t for _, t in sorted(turns)] for c, turns in found.items()}


def rebuild(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - c % 5, [])[:h] + own[h:]
    return out


def brute(convs):
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for prefix, cs in members.items():
        under = [p for p in members if p[: len(prefix)] == prefix]
        children = [p for p in under if len(p) == len(prefix) + 1]
        leaves = [p for p in under if not any(q[:-1] == p for q in members if q)]
        saved = sum((len(members[p]) - 1) * len(p[-1][1].encode()) for p in under if p)
        ends = ",".join(str(c) for c in sorted(cs) if len(convs[c]) == len(prefix))
        parent = min(members[prefix[:-1]]) if prefix else None
        out.append(
            (min(cs), len(prefix), parent, len(cs), len(children), len(leaves), saved,
             hashlib.sha256(ends.encode()).hexdigest())
        )
    return sorted(out, key=repr)


def nodes(df):
    return sorted(map(tuple, df.collect()), key=repr)


def conversations():
    rng = np.random.default_rng(11)
    rows = [(None, 0, "user", "no id"), (700, None, None, None), (701, 0, "", ""), (702, 0, None, "")]
    for c in range(40):
        for turn in range(int(rng.integers(1, 12))):
            rows.append((c, turn, ("user", "assistant")[turn % 2], f"ü{rng.integers(0, 2)}"))
    # Copies, ties, repeated rows, a text that is very long, ids that are far apart.
    rows += [(c, t, "user", f"copy {t}") for c in range(50, 80) for t in range(6)]
    rows += [(90, 1, "user", "b"), (90, 1, "user", "a"), (90, None, "user", "z"), (90, 1, "user", "a")]
    rows += [(10**15 + 7, 0, "user", "long " * 20000), (10**15 + 5, 0, "user", "long " * 20000)]
    rows += [(101, t, "user", "deep") for t in range(90)] + [(102, t, "user", "deep") for t in range(70)]
    return rows


@pytest.mark.parametrize("band", [2, 3, 16])
def test_nodes_equal_brute_force(spark, monkeypatch, band):
    monkeypatch.setattr(prefix_trie, "BAND", band)
    monkeypatch.setattr(prefix_trie, "PIECE_IDS", 3)
    rows = conversations()
    df = spark.createDataFrame(rows, TURNS).selectExpr("*", "1 as conv", "2 as depth", "3 as _block")
    assert nodes(prefix_trie.rebuilt_trie(df)) == brute(rebuild(in_order(rows)))
    if band == 3:
        assert nodes(prefix_trie.trie_of(df)) == brute(in_order(rows))


def test_a_conversation_may_fill_several_blocks(spark):
    """Every row a block of its own range, copies included."""
    rows = [(5, 0, "user", "same")] * 40 + [(5, t, "user", "x") for t in range(1, 60)] + [(6, 0, "user", "same")]
    df = spark.createDataFrame(rows, TURNS)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 9)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        placed, parts = prefix_trie.place_turns(prefix_trie.turn_digests(df))
        assert parts.where("conv = 5").count() > 4
        assert sorted(r.pos for r in placed.where("conv = 5").collect()) == list(range(99))
        assert nodes(prefix_trie.rebuilt_trie(df)) == brute(rebuild(in_order(rows)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_no_conversations(spark):
    df = spark.createDataFrame([], TURNS)
    got = prefix_trie.rebuilt_trie(df)
    assert got.collect() == [] and got.columns[0] == "conv_id"
    assert prefix_trie.rebuilt_trie(spark.createDataFrame([(None, 1, "user", "x")], TURNS)).collect() == []
