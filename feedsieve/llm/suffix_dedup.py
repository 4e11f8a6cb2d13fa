"""Removal of long repeated passages, by parsing the corpus into phrases.

Texts are parsed by triggers of a rolling hash: the trigger of a 200-byte window is
the smallest hash of the 16-byte strings at its beginning, so equal windows have
equal triggers wherever they stand.  Consecutive windows with one trigger are a
phrase.  Like in prefix-free parsing, the corpus is then ordered by phrases instead
of by bytes: a phrase whose text occurs a second time has only repeated windows; one
whose trigger is followed by a text that occurs nowhere else has none; and only
where phrases share the text behind the trigger but differ around it, the windows
in them are compared themselves, those of equal phrases once.

Only whether two suffixes agree for 200 bytes matters here, not which is the
smaller, so the order is by hashes of that many bytes, and no suffix array is kept:
one over a dictionary and a parse of the whole corpus would have to fit in a task.

Equal texts are one, named by a 64-bit hash; such texts are repeats as a whole.  A
null text is empty.  Texts of fewer than 200 bytes have nothing to remove.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..session import write_shared
from .text_blocks import batches_of, mix, powers, to_bytes

LENGTH = 200
GRAM = 16
REACH = (LENGTH - GRAM + 1) // 2  # 16-byte strings at a window's beginning that are looked at
SURE = LENGTH - REACH + 1  # bytes from the trigger on that are inside each of its windows
HELD_ROWS = 50_000

_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)
_LOW = np.uint64(0xFFFFFFFF)

PHRASES = "p long, k long, text_id long, lo int, hi int"
KINDS = "kind int, text_id long, lo int, hi int"
RANGES = "text_id long, lo int, hi int"
REPEATED, UNSURE = 0, 1
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


class Block:
    """Texts joined to one array, with hashes of any stretch of it."""

    def __init__(self, texts, up, down):
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        self.ends = np.cumsum([len(t) for t in texts])
        self.down = down
        terms = (self.data.astype(np.uint64) + np.uint64(1)) * up[: len(self.data)]
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])

    def hashes(self, starts, ends):
        value = (self.sums[ends] - self.sums[starts]) * self.down[starts]
        return mix(value ^ mix((ends - starts).astype(np.uint64)))

    def phrases(self):
        """First and last window start of each phrase, its trigger and its text's number."""
        n = len(self.data)
        if n < LENGTH:
            return [np.zeros(0, np.int64)] * 4
        at = np.arange(n - GRAM + 1)
        key = self.hashes(at, at + GRAM)
        # The rightmost of equal hashes: later places have smaller low halves.
        low = (key & ~_LOW) | (_LOW - at.astype(np.uint64))
        width = 1
        while 2 * width <= REACH:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        windows = n - LENGTH + 1
        low = np.minimum(low[:windows], low[REACH - width : REACH - width + windows])
        trigger = (_LOW - (low & _LOW)).astype(np.int64)
        start = np.arange(windows)
        text = np.searchsorted(self.ends, start, "right")
        whole = start + LENGTH <= self.ends[text]
        start, trigger, text = start[whole], trigger[whole], text[whole]
        if not len(start):
            return [np.zeros(0, np.int64)] * 4
        first = np.ones(len(start), bool)
        first[1:] = (trigger[1:] != trigger[:-1]) | (text[1:] != text[:-1])
        last = np.append(first[1:], True)
        return start[first], start[last], trigger[first], text[first]


def blocks_of(texts):
    """``(number of the first text, Block)`` of the texts, a part of them at a time."""
    parts = list(batches_of(texts))
    longest = max((sum(map(len, texts[a:b])) for a, b in parts), default=0)
    up, down = powers(longest, _BASE), powers(longest + 1, _INVERSE)
    for a, b in parts:
        yield a, Block(texts[a:b], up, down)


def _signed(values):
    return values.view(np.int64)


def _with_ids(docs):
    return docs.select(
        F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")
    ).withColumn("text_id", F.xxhash64("text"))


def text_phrases(docs):
    """Phrases of the texts: hash behind the trigger, hash of all windows, place.

    A text that repeats within a task is parsed once.
    """

    def run(batches):
        seen = set()
        for batch in batches:
            texts, ids = [], []
            for text, text_id in zip(batch.column(0), batch.column(1).to_pylist()):
                if text_id not in seen:
                    seen.add(text_id)
                    texts.append(to_bytes(text.as_py()))
                    ids.append(text_id)
            ids = np.array(ids, np.int64)
            for number, block in blocks_of(texts):
                lo, hi, trigger, text = block.phrases()
                if not len(lo):
                    continue
                behind = block.hashes(trigger, trigger + SURE)
                around = block.hashes(lo, hi + LENGTH)
                around = mix(around ^ (trigger - lo).astype(np.uint64))
                begin = np.concatenate([[0], block.ends[:-1]])[text]
                columns = (
                    _signed(behind),
                    _signed(around),
                    ids[number + text],
                    (lo - begin).astype(np.int32),
                    (hi - begin).astype(np.int32),
                )
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c) for c in columns], names=["p", "k", "text_id", "lo", "hi"]
                )

    return docs.select("text", "text_id").mapInArrow(run, PHRASES)


def sort_out(phrases):
    """Phrases that are repeated as a whole, and those whose windows must be compared.

    Rows come sorted by ``p`` and ``k``.  A group of one ``p`` is held back until it is
    over, or has so many rows that a part of it is worked on; of equal phrases, the
    windows of one stand for all.
    """

    def work(p, k, text_id, lo, hi, split):
        fresh = np.ones(len(p), bool)
        fresh[1:] = (k[1:] != k[:-1]) | (text_id[1:] != text_id[:-1]) | (lo[1:] != lo[:-1])
        p, k, text_id, lo, hi = (x[fresh] for x in (p, k, text_id, lo, hi))
        new_p = np.concatenate([[True], p[1:] != p[:-1]])
        new_k = new_p | np.concatenate([[True], k[1:] != k[:-1]])
        first = np.flatnonzero(new_k)
        sizes = np.diff(np.append(first, len(p)))
        # How many different phrases share the text behind the trigger.
        group = np.cumsum(new_p[first]) - 1
        several = np.bincount(group)[group] > 1
        if split is not None:
            several |= p[first] == split
        whole = np.repeat(sizes > 1, sizes)
        unsure = np.zeros(len(p), bool)
        unsure[first[several]] = True
        at = np.concatenate([np.flatnonzero(whole), np.flatnonzero(unsure)])
        kind = np.repeat([REPEATED, UNSURE], [whole.sum(), unsure.sum()]).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (kind, text_id[at], lo[at], hi[at])],
            names=["kind", "text_id", "lo", "hi"],
        )

    def run(batches):
        held, split = None, None  # split: the ``p`` of a group that is done in part
        for batch in batches:
            rows = [batch.column(i).to_numpy() for i in range(5)]
            if held is not None:
                rows = [np.concatenate(x) for x in zip(held, rows)]
            if not len(rows[0]):
                continue
            cut = int(np.searchsorted(rows[0], rows[0][-1], "left"))
            if cut:
                yield work(*(x[:cut] for x in rows), split)
            held = [x[cut:] for x in rows]
            if len(held[0]) > HELD_ROWS:
                split = held[0][0]
                yield work(*held, split)
                held = None
        if held is not None and len(held[0]):
            yield work(*held, split)

    return phrases.repartition("p").sortWithinPartitions("p", "k", "text_id", "lo").mapInArrow(
        run, KINDS
    )


def window_hashes(texts, unsure):
    """``w, text_id, lo``: hash and start of each window of the unsure phrases."""
    lists = unsure.groupBy("text_id").agg(F.collect_set(F.struct("lo", "hi")).alias("places"))
    # All columns of the texts: the exchange is then the one ``remove_repeats`` uses again.
    rows = texts.join(lists, "text_id").select("text", "text_id", "places", "doc_id")

    def run(batches):
        seen = set()
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                texts, ids, places = [], [], []
                for text, text_id, own in zip(*(part.column(i) for i in range(3))):
                    if text_id.as_py() not in seen:
                        seen.add(text_id.as_py())
                        texts.append(to_bytes(text.as_py()))
                        ids.append(text_id.as_py())
                        places.append([(x["lo"], x["hi"]) for x in own.as_py()])
                for number, block in blocks_of(texts):
                    begin = np.concatenate([[0], block.ends[:-1]])
                    spans = np.array(
                        [
                            (i, lo, hi)
                            for i in range(len(block.ends))
                            for lo, hi in places[number + i]
                        ]
                    ).reshape(-1, 3)
                    sizes = spans[:, 2] - spans[:, 1] + 1
                    text = np.repeat(spans[:, 0], sizes)
                    step = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                    lo = np.repeat(spans[:, 1], sizes) + step
                    at = begin[text] + lo
                    columns = (
                        _signed(block.hashes(at, at + LENGTH)),
                        np.array(ids, np.int64)[number + text],
                        lo.astype(np.int32),
                    )
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c) for c in columns], names=["w", "text_id", "lo"]
                    )

    return rows.mapInArrow(run, "w long, text_id long, lo int")


def repeated_windows(windows):
    """The windows whose hash is that of another place, too, as ranges of one."""

    def run(batches):
        before = None
        for batch in batches:
            w, text_id, lo = (batch.column(i).to_numpy() for i in range(3))
            if before is not None:
                w, text_id, lo = (np.concatenate([[b], x]) for b, x in zip(before, (w, text_id, lo)))
            if not len(w):
                continue
            other = (text_id[1:] != text_id[:-1]) | (lo[1:] != lo[:-1])
            twin = (w[1:] == w[:-1]) & other
            hit = np.zeros(len(w), bool)
            hit[1:] |= twin
            hit[:-1] |= twin
            before = (w[-1], text_id[-1], lo[-1])
            start = lo[hit].astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (text_id[hit].astype(np.int64), start, start)],
                names=["text_id", "lo", "hi"],
            )

    sorted_rows = windows.repartition("w").sortWithinPartitions("w", "text_id", "lo")
    return sorted_rows.mapInArrow(run, RANGES)


def repeated_ranges(texts):
    """``text_id, lo, hi``: ranges of window starts that occur elsewhere."""
    found = write_shared(sort_out(text_phrases(texts)), "phrases")
    whole = found.where(F.col("kind") == REPEATED).select("text_id", "lo", "hi")
    unsure = found.where(F.col("kind") == UNSURE).select("text_id", "lo", "hi")
    single = repeated_windows(window_hashes(texts, unsure))
    size = F.octet_length("text")
    copies = (
        texts.where(size >= LENGTH)
        .groupBy("text_id")
        .agg(F.count(F.lit(1)).alias("_n"), F.min(size).alias("_size"))
        .where("_n > 1")
        .select("text_id", F.lit(0).alias("lo"), (F.col("_size") - LENGTH).cast("int").alias("hi"))
    )
    return whole.union(single).union(copies)


def _mask(size, places):
    """Which bytes of a text are covered."""
    edges = np.zeros(size + 1, np.int32)
    if places:
        lo, hi = np.array(places).T
        np.add.at(edges, lo, 1)
        np.add.at(edges, hi + LENGTH, -1)
    return np.cumsum(edges[:-1]) > 0


def remove_repeats(docs):
    """Per document: bytes, bytes and runs removed, and the digest of what is kept.

    Each byte goes that is covered by a 200-byte string which also starts elsewhere,
    in this or another document; rows that repeat are documents of their own.
    """
    texts = _with_ids(docs)
    lists = repeated_ranges(texts).groupBy("text_id").agg(
        F.collect_set(F.struct("lo", "hi")).alias("places")
    )
    rows = texts.join(lists, "text_id", "left")

    def run(batches):
        for batch in batches:
            out = []
            for doc_id, text, own in zip(*(batch.column(i) for i in range(3))):
                data = np.frombuffer(to_bytes(text.as_py()), np.uint8)
                places = [(x["lo"], x["hi"]) for x in own.as_py() or []]
                gone = _mask(len(data), places)
                spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                digest = hashlib.sha256(data[~gone].tobytes()).hexdigest()
                out.append((doc_id.as_py(), len(data), int(gone.sum()), spans, digest))
            columns = list(zip(*out)) or [()] * 5
            types = [*[pa.int64()] * 4, pa.string()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)],
                names=[part.split()[0] for part in RESULT.split(", ")],
            )

    return rows.select("doc_id", "text", "places").mapInArrow(run, RESULT)
