"""Similarity join of documents on word shingles by parity sketches.

A document is the set of its five-word shingles.  Each shingle flips one bit of a
long sketch, so two sketches differ in at most as many bits, and in at most as many
blocks of bits, as the sets differ in shingles.  Sets of ``a`` and ``b`` shingles
with a Jaccard similarity of 3/4 differ in at most ``(a + b) / 7``, which is never
more than a third of either.  By the pigeonhole principle their sketches agree in
all but that many blocks; so if each document names, in an order that all share,
one block more than it may differ in, any two similar ones name a common block.
Sketch widths go by bands of sizes, and documents at the lower edge of a band are
named in the band below as well.  Blocks are kept sparse: a block is known by the
hash of the bits that are set in it.

The order decides how many documents meet in vain, not what is found.  Blocks that
more than ``CROWD`` documents name (passages that many share) are moved to its end,
and the documents that named one of them name their blocks anew, until no crowd is
left or the rounds are over.  A part of the documents goes ahead to find most of
those blocks; all documents then name theirs.  What still crowds in the end are
families of near copies: their members are compared with one of them.  Crowds whose
members are not all connected after that are gathered by their largest part, since a
family's many blocks hold much the same members, and the members that are still apart
are compared with each other there: each with its nearest one first.

Candidates must pass the Hamming distance of dense sketches, and are then verified
on the whole sets; each document first with the smallest of its candidates, and
other pairs only if they are not connected by then.

Copies are one node; the join's nodes are distinct sets, known by a 64-bit hash.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..session import drop_shared, write_shared
from .components import connected_components
from .text_blocks import batches_of, lower_ascii, mix, powers, to_bytes, word_bounds

SHINGLE_WORDS = 5
CROWD = 48
SCOUT_PART = 8  # one document in so many goes ahead
SCOUT_CROWD = 6
SCOUT_ROUNDS = 3
ROUNDS = 3
TILE = 1024  # members of a crowd in each half of a comparison
LOCAL_LINKS = 2_000_000  # 32 MB; the components of more links are found in rounds
HOT_TOKENS = 2_000_000  # 16 MB; with more of them the last step comes at once
BROADCAST_IDS = 1_000_000  # 8 MB; more ids are joined by a shuffle
DENSE_BITS = (64, 1 << 14)
FLUSH_PAIRS = 100_000
FLUSH_NAMES = 100_000
LONG_SET = 500  # shingles; larger sets count as several documents
DOCS_PER_FILE = 20_000  # of a table of ids
DOCS_PER_WORK_FILE = 4_000  # of one that texts, sketches or names are read for
HELD_TEXTS = 512
BAND = 16

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_STEPS = mix(np.arange(1, SHINGLE_WORDS + 2, dtype=np.uint64)) | np.uint64(1)


# --- shingle sets ----------------------------------------------------------------


def word_hashes(data, starts, ends, up, down):
    """Hash of each word of a block, by the prefix sums of a polynomial.

    ``up`` and ``down`` are the powers of its base and of the inverse.
    """
    terms = (data.astype(np.uint64) + np.uint64(1)) * up[: len(data)]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
    # Divided by the power at its start, a word has the same value wherever it stands.
    value = (sums[ends] - sums[starts]) * down[starts]
    return mix(value ^ mix((ends - starts).astype(np.uint64)))


def shingle_sets(texts):
    """Sorted distinct shingle hashes of each text (bytes)."""
    blocks = list(batches_of(texts))
    longest = max((sum(len(t) + 1 for t in texts[a:b]) for a, b in blocks), default=0)
    up, down = powers(longest, _BASE), powers(longest, _INVERSE)
    for first, last in blocks:
        part = texts[first:last]
        data = lower_ascii(np.frombuffer(b"\n".join(part) + b"\n", np.uint8))
        starts, ends = word_bounds(data)
        hashes = word_hashes(data, starts, ends, up, down)
        limits = np.cumsum([len(t) + 1 for t in part])
        cuts = np.concatenate([[0], np.searchsorted(starts, limits, "left")])
        n = max(0, len(hashes) - SHINGLE_WORDS + 1)
        rolled = np.zeros(n, np.uint64)
        for k in range(SHINGLE_WORDS):
            rolled += hashes[k : k + n] * _STEPS[k]
        rolled = mix(rolled)
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if b - a >= SHINGLE_WORDS:
                own = rolled[a : b - SHINGLE_WORDS + 1]
                own.sort()
                fresh = np.empty(len(own), bool)
                fresh[0] = True
                np.not_equal(own[1:], own[:-1], out=fresh[1:])
                yield own[fresh]
            elif b > a:
                few = (hashes[a:b] * _STEPS[: b - a]).sum(dtype=np.uint64, keepdims=True)
                yield mix(few + _STEPS[-1:] * np.uint64(b - a))
            else:
                yield np.zeros(0, np.uint64)


def node_of(shingles):
    """The hash that stands for a set."""
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


# --- sketches ----------------------------------------------------------------------


def bands_of(size):
    """Bands whose sketches a set of this size is named in."""
    band, low = 0, 1
    while size >= low * BAND:
        band, low = band + 1, low * BAND
    # The smallest possible partner has three quarters of the size.
    return [band - 1, band] if band and 3 * size < 4 * low else [band]


def sketch_blocks(shingles, band):
    """Tokens of the blocks with set bits; sets of a band have as many blocks as it has sizes."""
    blocks = max(64, BAND ** (band + 1))
    # The upper half of a hash gives the block, so blocks come in rising order.
    block = ((shingles >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
    bits = mix(shingles & np.uint64(0xFFFFFFFF))
    first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
    parity = np.bitwise_xor.reduceat(bits, first)
    at, parity = block[first][parity != 0], parity[parity != 0]
    return mix(parity ^ mix(at + np.uint64(band << 40))), at, blocks


def named_blocks(shingles, band, hot):
    """The tokens a set names: a third of its size and one, hot ones last, by their crowds."""
    tokens, at, blocks = sketch_blocks(shingles, band)
    need = len(shingles) // 3 + 1
    order = np.lexsort((tokens, crowd_sizes(tokens, hot)))
    named = tokens[order[:need]]
    if len(named) < need:
        # Blocks without set bits end the order; hardly ever are they needed.
        empty = np.setdiff1d(np.arange(blocks, dtype=np.uint64), at)[: need - len(named)]
        named = np.concatenate([named, mix(empty + np.uint64((band << 40) | (1 << 63)))])
    return named


def crowd_sizes(tokens, hot):
    """Size of each token's crowd, 0 where it is not hot; ``hot``: sorted tokens, sizes."""
    some, sizes = hot
    if not len(some):
        return np.zeros(len(tokens), np.int64)
    at = np.minimum(np.searchsorted(some, tokens), len(some) - 1)
    return np.where(some[at] == tokens, sizes[at], 0)


def with_more(hot, more):
    """Both tables of hot tokens as one, with the larger size of each."""
    tokens, sizes = (np.concatenate(x) for x in zip(hot, more))
    order = np.lexsort((-sizes, tokens))
    tokens, sizes = tokens[order], sizes[order]
    fresh = np.ones(len(tokens), bool)
    fresh[1:] = tokens[1:] != tokens[:-1]
    return tokens[fresh], sizes[fresh]


NO_TOKENS = (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _signed(tokens):
    return tokens.view(np.int64)


def dense_sketch(shingles):
    """Packed parity sketch of about two bits per shingle, a power of two of them."""
    low, high = DENSE_BITS
    bits = min(max(low, 1 << (2 * len(shingles)).bit_length()), high)
    flips = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((flips & 1).astype(np.uint8), bitorder="little").tobytes()


def hamming(a, b):
    """Distance of two packed sketches; the longer one is folded to the shorter."""
    x, y = sorted((np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)), key=len)
    y = np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)
    return int(np.bitwise_count(x ^ y).sum())


# --- tasks ---------------------------------------------------------------------------

SETS = "doc_id long, copy long, node long, n long, sketch binary"
NAMES = "token long, node long, n int"
FOUND = "kind int, token long, u long, v long, n int"
PAIR, MEMBER = 0, 1


def _sets_of(column):
    """Shingle sets of a column of texts, few of which are held at a time."""
    for start in range(0, len(column), HELD_TEXTS):
        yield from shingle_sets([to_bytes(v.as_py()) for v in column.slice(start, HELD_TEXTS)])


def document_nodes(docs):
    """``doc_id, copy, node, n, sketch``: hash of the text, set, its size, dense sketch.

    Without words node and sketch are null.
    """

    def run(batches):
        for batch in batches:
            nodes, sizes, sketches = [], [], []
            for shingles in _sets_of(batch.column(2)):
                nodes.append(node_of(shingles) if len(shingles) else None)
                sizes.append(len(shingles))
                sketches.append(dense_sketch(shingles) if len(shingles) else None)
            added = [(nodes, pa.int64()), (sizes, pa.int64()), (sketches, pa.binary())]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], *(pa.array(c, t) for c, t in added)],
                names=["doc_id", "copy", "node", "n", "sketch"],
            )

    return docs.select("doc_id", F.xxhash64("text"), "text").mapInArrow(run, SETS)


def name_blocks(docs, hots):
    """``token, node, n`` of the documents that take part in a round.

    ``hots`` has the hot tokens known before each round so far.
    From the second round on, only documents that named a token which proved hot
    take part.  A set is named once per task.
    """
    hot = hots[-1]

    def is_out(shingles, band):
        return any(
            not crowd_sizes(named_blocks(shingles, band, old), new).any()
            for old, new in zip(hots[:-1], hots[1:])
        )

    def run(batches):
        seen, held, waiting = set(), [], 0
        for batch in batches:
            for shingles in _sets_of(batch.column(0)):
                node = node_of(shingles)
                if not len(shingles) or node in seen:
                    continue
                seen.add(node)
                for band in bands_of(len(shingles)):
                    if not is_out(shingles, band):
                        held.append((_signed(named_blocks(shingles, band, hot)), node, len(shingles)))
                        waiting += len(held[-1][0])
                if waiting >= FLUSH_NAMES:
                    yield _names(held)
                    held, waiting = [], 0
        if held:
            yield _names(held)

    return docs.select("text").mapInArrow(run, NAMES)


def _names(held):
    tokens, nodes, sizes = zip(*held)
    lengths = [len(t) for t in tokens]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate(tokens)),
            pa.array(np.repeat(np.array(nodes, np.int64), lengths)),
            pa.array(np.repeat(np.array(sizes, np.int32), lengths)),
        ],
        names=["token", "node", "n"],
    )


class Groups:
    """Reads names sorted by token, size and node, and gathers what the groups give.

    Small groups give all pairs that sizes allow.  Of a crowd, its members; in the last
    round each with the leader it is compared with, and a leader with the one before.
    The rows of a group are held back until it is over, or known to be a crowd.
    """

    def __init__(self, last, crowd):
        self.last, self.crowd = last, crowd
        self.held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)]
        self.crowded, self.leader = None, None  # the crowd that is being read
        self.pairs, self.others, self.waiting = [], [], 0

    def add(self, token, node, n, over=False):
        """The next rows; ``over``: they are the last."""
        token, node, n = (np.concatenate(x) for x in zip(self.held, (token, node, n)))
        if not len(token):
            return
        fresh = np.ones(len(token), bool)
        fresh[1:] = (token[1:] != token[:-1]) | (node[1:] != node[:-1])
        token, node, n = token[fresh], node[fresh], n[fresh]
        first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        sizes = np.diff(np.append(first, len(token)))
        # The last group may go on; it is held back as long as it may be a small one.
        whole = len(token)
        if not over and sizes[-1] <= self.crowd and token[-1] != self.crowded:
            whole = first[-1]
        self.held = [token[whole:], node[whole:], n[whole:]]
        big = (sizes > self.crowd) | (token[first] == self.crowded)
        for start, size in zip(first[big].tolist(), sizes[big].tolist()):
            self._crowd(token[start], node[start : start + size], n[start : start + size])
        small = np.repeat(~big, sizes)[:whole]
        for k in range(1, int(min(sizes.max(), self.crowd))):
            i = np.flatnonzero((token[k:whole] == token[: max(whole - k, 0)]) & small[k:])
            if not len(i):
                break
            i = i[3 * n[i + k].astype(np.int64) <= 4 * n[i].astype(np.int64)]
            self._pair(node[i], node[i + k])

    def _pair(self, u, v):
        self.pairs.append((np.minimum(u, v), np.maximum(u, v)))
        self.waiting += len(u)

    def _crowd(self, token, node, n):
        if token != self.crowded:
            self.crowded, self.leader = token, None
        leaders = [None] * len(node)
        start = 0
        while self.last and start < len(node):
            # A member too large for the leader leads the next ones.
            if self.leader is None or 3 * int(n[start]) > 4 * self.leader[1]:
                leaders[start] = None if self.leader is None else self.leader[0]
                self.leader = (node[start], int(n[start]))
                start += 1
                continue
            stop = int(np.searchsorted(n, self.leader[1] * 4 // 3, "right"))
            leaders[start:stop] = [self.leader[0]] * (stop - start)
            start = stop
        for x, leader, size in zip(node.tolist(), leaders, n.tolist()):
            self.others.append((MEMBER, token, x, leader, size))
        self.waiting += len(node)

    def take(self, least):
        """What has been gathered, once there is enough of it."""
        if self.waiting < least:
            return None
        columns = [list(c) for c in zip(*self.others)] or [[], [], [], [], []]
        if self.pairs:
            u, v = (np.concatenate(x) for x in zip(*self.pairs))
            order = np.lexsort((v, u))
            u, v = u[order], v[order]
            fresh = np.ones(len(u), bool)
            fresh[1:] = (u[1:] != u[:-1]) | (v[1:] != v[:-1])
            none = [None] * int(fresh.sum())
            columns[0] += [PAIR] * len(none)
            columns[1] += none
            columns[2] += u[fresh].tolist()
            columns[3] += v[fresh].tolist()
            columns[4] += none
        self.pairs, self.others, self.waiting = [], [], 0
        types = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, types)], names=["kind", "token", "u", "v", "n"]
        )


def gather_groups(names, last, crowd=CROWD):
    """Candidate pairs and the members of crowds, from the names of all documents."""

    def run(batches):
        groups = Groups(last, crowd)
        for batch in batches:
            groups.add(*(batch.column(i).to_numpy() for i in range(3)))
            out = groups.take(FLUSH_PAIRS)
            if out is not None:
                yield out
        groups.add(*(x[:0] for x in groups.held), over=True)
        out = groups.take(1)
        if out is not None:
            yield out

    return (
        names.repartition("token").sortWithinPartitions("token", "n", "node").mapInArrow(run, FOUND)
    )


# --- verification ----------------------------------------------------------------------


def _texts_of(docs, nodes, wanted):
    """``node, text`` of the wanted nodes, the text of one document of each."""
    ids = (
        nodes.join(wanted, "node", "left_semi")
        .groupBy("node")
        .agg(F.min("doc_id").alias("_wanted"))
        .select("_wanted")
        .distinct()
    )
    if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    rows = docs.join(ids, F.col("doc_id").eqNullSafe(F.col("_wanted")), "left_semi").select("text")

    def run(batches):
        for batch in batches:
            found = [node_of(s) if len(s) else None for s in _sets_of(batch.column(0))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(found, pa.int64()), batch.column(0)], names=["node", "text"]
            )

    found = rows.mapInArrow(run, "node long, text string").where(F.col("node").isNotNull())
    return found.join(wanted, "node", "left_semi").groupBy("node").agg(F.min("text").alias("text"))


def near_sketches(pairs, nodes):
    """The pairs whose sketches do not rule out a similarity of 3/4."""
    known = nodes.where(F.col("node").isNotNull()).groupBy("node").agg(
        F.min("n").alias("n"), F.min("sketch").alias("sketch")
    )

    def run(batches):
        for batch in batches:
            rows = zip(*(batch.column(i).to_pylist() for i in range(2, 6)))
            keep = [7 * hamming(a, b) <= n + m for n, a, m, b in rows]
            yield batch.filter(pa.array(keep, pa.bool_())).select(["u", "v"])

    first = known.select(F.col("node").alias("u"), F.col("n").alias("nu"), F.col("sketch").alias("a"))
    second = known.select(F.col("node").alias("v"), F.col("n").alias("nv"), F.col("sketch").alias("b"))
    joined = pairs.join(first, "u").join(second, "v").where("4 * nu >= 3 * nv and 4 * nv >= 3 * nu")
    return joined.select("u", "v", "nu", "a", "nv", "b").mapInArrow(run, "u long, v long")


def verify(pairs, texts):
    """The pairs ``(u, v)`` whose sets have a Jaccard similarity of at least 3/4."""

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(_sets_of(batch.column(2)), _sets_of(batch.column(3))):
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= 75 * (len(x) + len(y) - both))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["u", "v"])

    return (
        pairs.join(texts.select(F.col("node").alias("u"), F.col("text").alias("a")), "u")
        .join(texts.select(F.col("node").alias("v"), F.col("text").alias("b")), "v")
        .select("u", "v", "a", "b")
        .mapInArrow(run, "u long, v long")
    )


def _apart(pairs, parts):
    """The pairs whose ends are not of one component."""
    first = parts.select(F.col("node").alias("u"), F.col("component").alias("cu"))
    second = parts.select(F.col("node").alias("v"), F.col("component").alias("cv"))
    joined = pairs.join(first, "u", "left").join(second, "v", "left")
    return joined.where(F.coalesce("cu", "u") != F.coalesce("cv", "v")).select("u", "v")


def _smallest_reachable(u, v):
    """Nodes of the links that reach a smaller one, and the smallest they reach."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    least = np.arange(len(nodes))
    while (least[a] != least[b]).any():
        low = np.minimum(least[a], least[b])
        np.minimum.at(least, least[a], low)
        np.minimum.at(least, least[b], low)
        while (least[least] != least).any():
            least = least[least]
    apart = np.flatnonzero(least != np.arange(len(nodes)))
    return nodes[apart], nodes[least[apart]]


def parts_of(links):
    """``node, component`` as ``connected_components`` gives them.

    Links up to a bounded number are solved by one task, without rounds.
    """
    if links.limit(LOCAL_LINKS + 1).count() > LOCAL_LINKS:
        return connected_components(links, "u", "v")

    def run(batches):
        found = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if found:
            columns = _smallest_reachable(*(np.concatenate(x) for x in zip(*found)))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["node", "component"])

    return links.select("u", "v").coalesce(1).mapInArrow(run, "node long, component long")


def linked(pairs, docs, nodes, scratch, before=None):
    """Links among candidate pairs that decide the components, those of ``before`` included."""
    near = scratch.write(near_sketches(pairs, nodes), "near", DOCS_PER_WORK_FILE)
    wanted = near.select(F.col("u").alias("node")).union(near.select("v")).distinct()
    texts = scratch.write(_texts_of(docs, nodes, wanted), "texts", DOCS_PER_WORK_FILE)
    first = near.groupBy("v").agg(F.min("u").alias("u")).select("u", "v")
    links = verify(first, texts)
    if before is not None:
        links = links.union(before)
    links = scratch.write(links, "links", DOCS_PER_WORK_FILE)
    rest = _apart(near, scratch.write(parts_of(links), "components"))
    found = scratch.write(links.union(verify(rest, texts)), "links", DOCS_PER_WORK_FILE)
    scratch.drop(near, texts)
    return found


def _hot_tokens(found, weight=1):
    """Tokens of the crowds and their sizes, None if they are too many to send round."""
    crowds = found.where(F.col("kind") == MEMBER).groupBy("token").count()
    rows = crowds.limit(HOT_TOKENS + 1).toArrow()
    if rows.num_rows > HOT_TOKENS:
        return None
    tokens, sizes = (rows.column(c).to_numpy() for c in ("token", "count"))
    order = np.argsort(tokens.view(np.uint64))
    return tokens.view(np.uint64)[order], sizes[order] * weight


def documents_in(nodes):
    """Number of documents, long ones counted by their shingles."""
    size = F.greatest(F.lit(1.0), F.col("n") / F.lit(float(LONG_SET)))
    return int(nodes.agg(F.coalesce(F.sum(size), F.lit(0.0))).first()[0])


def few_files(df, n_docs, docs_per_file):
    """``df`` in as many partitions as the documents ask for, one for each core at any rate.

    They grow with the documents and never exceed those of the shuffle.  A file of a few
    rows costs a task and, on a local disk, the processes that set its permissions.
    """
    least = df.sparkSession.sparkContext.defaultParallelism
    return df.coalesce(max(least, -(-n_docs // docs_per_file)))


class Scratch:
    """Tables in the shared folder that go when they are no longer read; ``n_docs`` bounds their files."""

    def __init__(self, n_docs):
        self._n_docs = n_docs
        self._tables = []

    def write(self, df, name, docs_per_file=DOCS_PER_FILE):
        self._tables.append(write_shared(few_files(df, self._n_docs, docs_per_file), name))
        return self._tables[-1]

    def drop(self, *tables):
        """Remove the tables, all that are left if none is named."""
        for table in tables or tuple(self._tables):
            if any(table is kept for kept in self._tables):
                drop_shared(table)
                self._tables = [kept for kept in self._tables if kept is not table]


def scout_tokens(docs):
    """Blocks that crowd in a part of the documents, whatever their number."""
    part = docs.where(F.pmod(F.xxhash64("text"), F.lit(SCOUT_PART)) == 0)
    hots = [NO_TOKENS]
    for _ in range(SCOUT_ROUNDS):
        groups = gather_groups(name_blocks(part, hots), False, SCOUT_CROWD)
        hot = _hot_tokens(groups, SCOUT_PART)
        if hot is None or not len(hot[0]):
            break
        hots.append(with_more(hots[-1], hot))
    return hots[-1]


def _of_nodes(docs, nodes, wanted):
    """The documents whose id belongs to a wanted node, or all if those are very many."""
    ids = nodes.join(wanted, "node", "left_semi").select(F.col("doc_id").alias("_id")).distinct()
    if ids.limit(BROADCAST_IDS + 1).count() > BROADCAST_IDS:
        return docs
    return docs.join(F.broadcast(ids), F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")


def similar_sets(docs, nodes):
    """``node, component`` of the sets that are linked to a smaller one."""
    scratch = Scratch(documents_in(nodes))
    hots, found, last, some = [scout_tokens(docs)], [], False, docs
    while True:
        last = last or len(hots) == ROUNDS
        groups = gather_groups(name_blocks(some, hots), last)
        found.append(scratch.write(groups, "groups", DOCS_PER_WORK_FILE))
        hot = NO_TOKENS if last else _hot_tokens(found[-1])
        if hot is None:
            # Too many to send round: all documents take part in the last round.
            hots, last, some = hots[-1:], True, docs
        elif not len(hot[0]):
            break
        else:
            hots.append(with_more(hots[-1], hot))
            last = len(hots[-1][0]) == len(hots[-2][0])
            crowds = found[-1].where(F.col("kind") == MEMBER).select(F.col("u").alias("node"))
            some = _of_nodes(docs, nodes, crowds)
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.union(more)
    pairs = pairs.where(F.col("kind") == PAIR).select("u", "v").distinct()
    if last:
        members = found[-1].where(F.col("kind") == MEMBER).select("token", "u", "v")
        stars = scratch.write(_in_order(members.where("v is not null")), "stars")
        pairs = pairs.union(stars).distinct()
        links = linked(pairs, docs, nodes, scratch)
        links = _join_crowds(members, stars, links, docs, nodes, scratch)
    else:
        links = linked(pairs, docs, nodes, scratch)
    parts = write_shared(parts_of(links), "components")
    scratch.drop()
    return parts


def _in_order(pairs):
    u, v = F.col("u"), F.col("v")
    return pairs.select(F.least(u, v).alias("u"), F.greatest(u, v).alias("v")).distinct()


def nearest_only(u, v, far):
    """Of the pairs, those that are the nearest of one of their ends; ties to the smaller ends."""
    order = np.lexsort((v, u, far))
    keep = np.zeros(len(u), bool)
    for ends in (u, v):
        keep[order[np.unique(ends[order], return_index=True)[1]]] = True
    return keep


def close_sketches(group, nearest):
    """Pairs of a tile of a crowd that sizes and sketches allow, of different parts.

    Each member is compared with the next larger ones by the width of its own sketch,
    to which the wider ones are folded.  ``nearest``: only the nearest pairs of each.
    """
    group = group.sort_values(["n", "node"])
    node, n, part, tile = (group[c].to_numpy() for c in ("node", "n", "part", "tile"))
    one_tile = group["i"].iloc[0] == group["j"].iloc[0]
    sketches = [np.frombuffer(s, np.uint64) for s in group["sketch"]]
    widths = np.array([len(s) for s in sketches])
    last = np.searchsorted(n, n * 4 // 3, "right")
    us, vs, fars = [], [], []
    for width in np.unique(widths).tolist():
        own = np.flatnonzero(widths == width)
        base, stop = int(own[0]), int(last[own[-1]])
        folded = np.stack(
            [np.bitwise_xor.reduce(s.reshape(-1, width), axis=0) for s in sketches[base:stop]]
        )
        for x in own.tolist():
            ys = np.arange(x + 1, last[x])
            fits = part[ys] != part[x]
            if not one_tile:
                fits &= tile[ys] != tile[x]
            ys = ys[fits]
            far = np.bitwise_count(folded[ys - base] ^ folded[x - base]).sum(axis=1, dtype=np.int64)
            close = 7 * far <= n[x] + n[ys]
            us.append(np.full(int(close.sum()), node[x]))
            vs.append(node[ys[close]])
            fars.append(far[close])
    u, v, far = (np.concatenate(x) for x in (us, vs, fars))
    if nearest:
        keep = nearest_only(u, v, far)
        u, v = u[keep], v[keep]
    return pd.DataFrame({"u": u, "v": v})


def compare_crowds(members, nodes, nearest=False):
    """Pairs of unconnected members of a crowd whose sketches are near enough.

    ``members``: ``token, node, part``.  Pairs are compared by their sketches in place and
    only near ones become rows.  A crowd is cut into tiles by hash, and each two tiles
    are a group of their own: no task holds more than two of them, however large the
    crowd.
    """
    known = nodes.where(F.col("node").isNotNull()).groupBy("node").agg(
        F.min("n").alias("n"), F.min("sketch").alias("sketch")
    )
    sizes = members.groupBy("token").agg(F.count(F.lit(1)).alias("_members"))
    tiles = F.ceil(F.col("_members") / F.lit(TILE))
    tile = F.pmod(F.xxhash64("node", F.lit("tile")), tiles)
    rows = members.join(sizes, "token").select("token", "node", "part", tile.alias("tile"), tiles.alias("tiles"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    rows = rows.join(known, "node").select(
        "token",
        F.least("tile", "other").alias("i"),
        F.greatest("tile", "other").alias("j"),
        "tile", "node", "n", "part", "sketch",
    )

    def compare(group):
        return close_sketches(group, nearest)

    return rows.groupBy("token", "i", "j").applyInPandas(compare, "u long, v long")


def _with_parts(members, parts):
    """Members with their part, of the crowds that have more than one."""
    known = members.select("token", "node").join(parts, "node", "left")
    known = known.select("token", "node", F.coalesce("component", "node").alias("part"))
    several = known.groupBy("token").agg(F.min("part").alias("a"), F.max("part").alias("b"))
    return known.join(several.where("a <> b").select("token"), "token", "left_semi")


def gathered_crowds(members, stars, links, scratch):
    """``token, node`` of the crowds whose members are not all connected, as few as may be.

    Crowds whose largest parts are the same hold much the same members: they become one
    crowd, unless that had more pairs to compare than they have by themselves.
    """
    parts = scratch.write(parts_of(links), "components")
    apart = _apart(stars, parts).select(F.col("u").alias("_a"), F.col("v").alias("_b"))
    same = (F.least("u", "v") == F.col("_a")) & (F.greatest("u", "v") == F.col("_b"))
    torn = members.join(apart, same, "left_semi").select("token").distinct()
    torn = scratch.write(members.join(torn, "token", "left_semi"), "torn")
    known = torn.select("token", F.col("u").alias("node")).join(parts, "node", "left")
    sizes = known.groupBy("token", F.coalesce("component", "node").alias("part")).count()
    largest = F.max_by("part", F.struct("count", "part"))
    led = scratch.write(sizes.groupBy("token").agg(largest.alias("lead"), F.sum("count").alias("k")), "led")
    rows = torn.select("token", F.col("u").alias("node")).join(led.select("token", "lead"), "token")
    whole = rows.select("lead", "node").distinct()
    pairs = F.col("k").cast("double") * F.col("k")
    cost = led.groupBy("lead").agg(F.sum(pairs).alias("alone"))
    cost = cost.join(whole.groupBy("lead").agg(F.count(F.lit(1)).alias("k")), "lead")
    cost = scratch.write(cost.select("lead", (pairs <= F.col("alone")).alias("_one")), "leads")
    one = whole.join(cost.where("_one"), "lead").select(F.xxhash64(F.lit("lead"), "lead").alias("token"), "node")
    alone = rows.join(cost.where("not _one"), "lead").select("token", "node")
    return scratch.write(one.union(alone), "crowds"), parts


def _join_crowds(members, stars, links, docs, nodes, scratch):
    """Links after comparing those members of crowds that are not connected yet.

    First each with the nearest one of another part, then all that are still apart.
    """
    crowds, parts = gathered_crowds(members, stars, links, scratch)
    for nearest in (True, False):
        apart = scratch.write(_with_parts(crowds, parts), "apart")
        if apart.isEmpty():
            break
        pairs = _in_order(compare_crowds(apart, nodes, nearest))
        pairs = scratch.write(pairs, "candidates", DOCS_PER_WORK_FILE)
        links = linked(pairs, docs, nodes, scratch, links)
        parts = scratch.write(parts_of(links), "components")
    return links


def document_parts(docs):
    """``document_nodes`` with ``part``, the same for connected ones, null without words."""
    nodes = write_shared(document_nodes(docs), "nodes")
    parts = similar_sets(docs, nodes)
    joined = nodes.join(parts, "node", "left")
    return joined.select("doc_id", "copy", "n", F.coalesce("component", "node").alias("part"))


def join_documents(docs):
    """``doc_id, n_shingles, component_id``: one row per document.

    The component is the smallest id that is reached over links.  A null or empty
    text, or one without words, has no shingles and links with nothing; with fewer
    than five words the whole sequence is one shingle.  Rows that repeat are copies
    of each other.  A null id is a document like others, but never the smallest of a
    component that has another.
    """
    rows = document_parts(docs.select(F.col("doc_id").cast("long"), "text"))
    least = (
        rows.where(F.col("part").isNotNull()).groupBy("part").agg(F.min("doc_id").alias("_first"))
    )
    first = F.when(F.col("part").isNull(), F.col("doc_id")).otherwise(F.col("_first"))
    return rows.join(least, "part", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), first.alias("component_id")
    )


def keep_one_of_each(docs):
    """The documents with one of each component, in the columns they have.

    It is the one with the smallest id; of rows that repeat it, one.  Documents
    without words are all kept.
    """
    rows = write_shared(
        document_parts(docs.select(F.col("doc_id").cast("long"), "text")), "parts"
    )
    # A null id comes last.
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "copy")
    worded = F.col("part").isNotNull()
    winners = rows.where(worded).groupBy("part").agg(F.min(place).alias("_w"))
    winners = winners.select("_w.doc_id", "_w.copy", F.lit(True).alias("_one")).distinct()
    wordless = rows.where(~worded).select("doc_id", "copy", F.lit(False).alias("_one")).distinct()
    kept = winners.union(wordless).withColumnsRenamed({"doc_id": "_kid", "copy": "_kcopy"})
    boxed = docs.select(
        F.struct(*docs.columns).alias("_doc"),
        F.col("doc_id").cast("long").alias("_id"),
        F.xxhash64("text").alias("_copy"),
    )
    boxed = boxed.join(
        kept, F.col("_id").eqNullSafe(F.col("_kid")) & (F.col("_copy") == F.col("_kcopy"))
    )
    order = Window.partitionBy("_id", "_copy").orderBy(F.xxhash64("_doc"))
    ones = boxed.where("_one").withColumn("_row", F.row_number().over(order)).where("_row = 1")
    every = ones.select("_doc").union(boxed.where(~F.col("_one")).select("_doc"))
    every = every.select(*(F.col(f"_doc.{c}") for c in docs.columns))
    return few_files(every, documents_in(rows), DOCS_PER_WORK_FILE)
