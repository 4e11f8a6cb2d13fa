"""Repair of turns against a search over all edits."""

import hashlib
import heapq
import re
import zlib

import numpy as np
import pytest

from feedsieve.llm import turn_repair

TURNS = "conv_id long, turn long, role string, text string"
GRAMMAR = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def damage(rows):
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        code = zlib.crc32(key.encode()) % 20
        if code == 0:
            continue
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        for _ in range(2 if code == 3 else 1):
            yield conv, turn, "user" if code == 4 else role, text


def in_order(rows):
    found = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            key = (turn is not None, turn or 0, role, sha(text))
            found.setdefault(conv, []).append((key, turn, role, text))
    return {c: [t[1:] for t in sorted(turns, key=lambda t: t[0])] for c, turns in found.items()}


def faults(turns):
    seen, out = set(), []
    for _, role, text in turns:
        last = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
        fault = "" if last and last[0] in ".!?" else "truncated"
        fault = "blank" if not last else "duplicate" if (role, text) in seen else fault
        seen.add((role, text))
        out.append(fault)
    return out


def cheapest(turns, found):
    """Least (cost, audit) by Dijkstra over whole audits."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, at, state, kept = heapq.heappop(heap)
        if at == len(turns) and state in ("", "a"):
            return cost, audit, "\n".join(kept)
        if (at, state) in done:
            continue
        done.add((at, state))
        for role in ("user", "assistant"):
            to = GRAMMAR.get((state, role[0]))
            if to:
                heapq.heappush(heap, (cost + 2, audit + "I", at, to, (*kept, role + ":")))
        if at == len(turns):
            continue
        heapq.heappush(heap, (cost + 3, audit + "D", at + 1, state, kept))
        if found[at] in ("blank", "duplicate"):
            continue
        more, (_, own, text) = found[at] == "truncated", turns[at]
        to = GRAMMAR.get((state, own[:1]))
        if to:
            heapq.heappush(heap, (cost + more, audit + "K", at + 1, to, (*kept, f"{own}:{text}")))
        for role in ("user", "assistant"):
            to = GRAMMAR.get((state, role[0]))
            if to:
                heapq.heappush(heap, (cost + 2 + more, audit + "R", at + 1, to, (*kept, f"{role}:{text}")))


def brute(rows, ids):
    convs, out = in_order(rows), []
    for c in ids:
        turns = convs.get(c, [])
        found = faults(turns)
        numbers = [t for t, _, _ in turns if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(turns, turns[1:])]
        cost, audit, text = cheapest(turns, found)
        out.append((c, gaps, *[found.count(f) for f in ("blank", "duplicate", "truncated")],
                    sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, sha(text)))
    return sorted(out)


def conversations(n=60):
    rng = np.random.default_rng(12)
    rows = [(None, 0, "user", "no id."), (900, None, None, None), (901, 3, "", "Empty role."), (901, 9, "user", "")]
    roles = ["system", "user", "assistant", "tool", "", None, "user", "assistant", "user", "assistant"]
    texts = ["Yes.", "no", "What?\n", " \t", "", None, "Ü!", "...", "a long one. " * 9]
    for c in range(n):
        for _ in range(int(rng.integers(0, 14))):
            turn = None if rng.random() < 0.1 else int(rng.integers(0, 12))
            rows.append((c, turn, roles[rng.integers(0, 10)], texts[rng.integers(0, 9)]))
    rows += [(902, t, "user", f"Row {t}.") for t in range(50)] + [(903, 1, "user", "copy.")] * 30
    return rows + [(904, 0, "user", "long " * 30000 + "."), (905, 7, "assistant", "Alone.")]


def report(df):
    return sorted(map(tuple, df.collect()))


def test_repair_equals_search(spark):
    rows = conversations()
    ids = {r[0] for r in rows if r[0] is not None}
    df = spark.createDataFrame(rows, TURNS).selectExpr("*", "1 as conv", "'x' as letter", "3 as cost")
    assert report(turn_repair.repair_damaged(df)) == brute(list(damage(rows)), ids)


def test_conversations_in_several_blocks(spark):
    rng = np.random.default_rng(5)
    roles = ["system", "user", "assistant", "tool"]
    rows = [
        (c, t, roles[rng.integers(0, 4)], f"text {rng.integers(0, 90)}{'.' if rng.random() < 0.6 else ''}")
        for c, n in ((1, 150), (2, 3), (3, 80), (4, 1), (5, 120))
        for t in range(n)
    ]
    rows += [(6, None, "user", "same.")] * 60
    df = spark.createDataFrame(rows, TURNS)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 11)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        marked = turn_repair.mark_faults(df)
        assert marked.where("conv = 1").select("_block").distinct().count() > 2
        got = report(turn_repair.repair_report(df, df))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert got == brute(rows, {r[0] for r in rows})


def test_repaired_turns_are_what_is_hashed(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Hi."), (1, 2, "tool", "Yes."), (1, 3, "user", "Go on"),
            (2, None, "assistant", "First."), (2, 4, "assistant", "Last.")]
    df = spark.createDataFrame(rows, TURNS)
    kept = {}
    for r in sorted(turn_repair.repaired_turns(df).collect(), key=lambda r: (r.conv_id, r._block, r.step)):
        kept.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    hashes = {r.conv_id: r.repaired_sha256 for r in turn_repair.repair_report(df, df).collect()}
    assert hashes == {c: sha("\n".join(lines)) for c, lines in kept.items()}


def test_ranks_order_the_audits():
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 9, 20)
    kinds = rng.integers(0, turn_repair.KINDS, sizes.sum())
    ways = turn_repair.Ways(kinds, sizes, np.tile(turn_repair.LAST, (20, 1)), np.ones(20, bool))
    audits = {}
    for state in range(4):
        part, _, node = ways.edits(np.full(20, state))
        for p in range(20):
            letters = "".join(turn_repair.LETTERS[ways.letter[n]] for n in node[part == p])
            audits[int(ways.first[p] * 4 + state)] = letters
    order = sorted(audits, key=lambda n: ways.rank[n])
    assert [audits[n] for n in order] == sorted(audits.values())


@pytest.mark.parametrize("rows", [[], [(None, 1, "user", "x")]])
def test_no_conversations(spark, rows):
    df = spark.createDataFrame(rows, TURNS)
    assert turn_repair.repair_damaged(df).collect() == []
