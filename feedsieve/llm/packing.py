"""Best-fit packing: documents into sequences by patterns of lengths.

Documents are turned into token ids and cut into pieces.  What decides the
packing is the histogram of piece lengths, ``seq_len`` numbers whatever the
corpus holds: patterns of one to three lengths that fill a sequence exactly are
fitted to it by non-negative least squares, their repeat counts are rounded,
and what is left is packed best fit first, again on the histogram.  The pieces
are then dealt out to the places of the plan by their rank within their length;
ranks are counted in salted groups, so a length that a third of the pieces
share is nobody's single task.

Null and empty texts are a single end token.  Repeated rows are packed as often
as they occur.  An empty table gives an empty result.
"""

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..session import write_shared

SEQ_LEN = 1024
END_ID = 2
TOKENIZER = "byte_bpe_50k"
ROWS_PER_RANK_GROUP = 20_000
MIN_RANK_GROUPS = 64
FIT_STEPS = 1500
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = f"{PIECES}, sequence_id long, offset long"


def tokenizer_files(name=TOKENIZER):
    """The vocabulary as a tokenizer file and, the same, as merge ranks."""
    import public_tokenizers

    return public_tokenizers.path(f"{name}.json"), public_tokenizers.path(f"{name}.tiktoken")


def special_tokens(json_path):
    """Texts that the tokenizer takes for a token of their own."""
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(json_path)
    return [token.content for token in whole.get_added_tokens_decoder().values()]


def load_encoder(json_path, ranks_path, special=None):
    """Function from a text to its ids; ``special`` are the special tokens, where known.

    Both libraries give the same ids; the ranks are read four times as fast.
    They know no special tokens, so texts that spell one take the other.  That one is
    large, and not loaded before such a text comes.
    """
    import base64
    from functools import cache

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    whole = cache(lambda: Tokenizer.from_file(json_path))
    special = special_tokens(json_path) if special is None else special
    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding(
        "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )

    def encode(text):
        if any(token in text for token in special):
            return whole().encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return encode


def cut_points(n, seq_len):
    """Starts of the pieces of ``n`` ids; only the first may be shorter."""
    if n <= seq_len:
        return [0]
    return ([0] if n % seq_len else []) + list(range(n % seq_len, n, seq_len))


def token_pieces(docs, seq_len=SEQ_LEN, end_id=END_ID, files=None):
    """One row per piece of each document, with the checksum of its ids."""
    json_path, ranks_path = files or tokenizer_files()
    special = special_tokens(json_path)

    def run(batches):
        encode = load_encoder(json_path, ranks_path, special)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.array([*encode(text.as_py() or ""), end_id], "<u4")
                starts = cut_points(len(ids), seq_len)
                for i, (start, stop) in enumerate(zip(starts, [*starts[1:], len(ids)])):
                    crc = zlib.crc32(ids[start:stop].tobytes())
                    rows.append((doc_id, i, start, stop - start, crc))
            columns = list(zip(*rows)) or [()] * 5
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


def exact_patterns(seq_len):
    """All ways to fill a sequence with one, two or three lengths, as rows of three."""
    a = np.arange(1, seq_len + 1)
    first, second = (x.ravel() for x in np.meshgrid(a, np.arange(seq_len + 1), indexing="ij"))
    third = seq_len - first - second
    keep = (first >= second) & (second >= third) & (third >= 0)
    return np.stack([first[keep], second[keep], third[keep]], axis=1)


def fit_repeats(patterns, histogram, steps=FIT_STEPS):
    """Repeat counts ``x >= 0`` with ``patterns * x`` nearest to the histogram.

    Accelerated projected gradient; a pattern has three entries at most, so a
    step is a few look-ups per pattern.
    """
    size = len(histogram)
    want = histogram.astype(float)
    want[0] = 0.0
    used = np.all((patterns == 0) | (histogram[patterns] > 0), axis=1)
    columns = patterns[used]
    x = np.zeros(len(columns))
    if not len(columns):
        return np.zeros(len(patterns))

    def total(weights):
        out = sum(np.bincount(columns[:, j], weights, size) for j in range(3))
        out[0] = 0.0
        return out

    def back(residual):
        residual = residual.copy()
        residual[0] = 0.0
        return residual[columns].sum(axis=1)

    v = np.ones(len(columns))
    for _ in range(30):  # largest eigenvalue, by power iteration
        v = back(total(v))
        norm = np.linalg.norm(v)
        v /= norm
    step, y, t = 1.0 / (1.05 * norm), x, 1.0
    for _ in range(steps):
        new = np.maximum(y - step * back(total(y) - want), 0.0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    out = np.zeros(len(patterns))
    out[used] = x
    return out


def best_fit(histogram, seq_len):
    """Best fit of lengths in falling order, whole groups of equal bins at a time.

    Returns ``(lengths, repeats)`` pairs.
    """
    bins, spaces = {}, []

    def put(space, lengths, n):
        if space not in bins:
            bins[space] = []
            insort(spaces, space)
        bins[space].append((lengths, n))

    for length in range(seq_len, 0, -1):
        left = int(histogram[length])
        while left:
            at = bisect_left(spaces, length)
            if at == len(spaces):
                fits = min(seq_len // length, left)
                n, rest = divmod(left, fits)
                put(seq_len - fits * length, (length,) * fits, n)
                if rest:
                    put(seq_len - rest * length, (length,) * rest, 1)
                left = 0
                continue
            space = spaces[at]
            lengths, n = bins[space].pop()
            if not bins[space]:
                del bins[space], spaces[at]
            took = min(n, left)
            if took < n:
                put(space, lengths, n - took)
            put(space - length, (*lengths, length), took)
            left -= took
    return [group for groups in bins.values() for group in groups]


def packing_plan(histogram, seq_len=SEQ_LEN):
    """``(lengths, repeats)`` pairs that use up the histogram of lengths."""
    left = np.array(histogram, np.int64)
    patterns = exact_patterns(seq_len)
    repeats = fit_repeats(patterns, left)
    plan = []
    for i in np.argsort(-repeats, kind="stable"):
        if repeats[i] < 0.5:
            break
        lengths, counts = np.unique(patterns[i][patterns[i] > 0], return_counts=True)
        n = int(min(round(repeats[i]), *(left[lengths] // counts)))
        if n:
            left[lengths] -= n * counts
            plan.append((tuple(int(x) for x in patterns[i] if x), n))
    return plan + best_fit(left, seq_len)


def places(plan, seq_len):
    """Per length, the ranks from which its pieces go to a place of the plan.

    Four arrays sorted by (length, first rank): both of these, then the number
    of the first sequence and the offset.
    """
    rows, taken, sequence = [], np.zeros(seq_len + 1, np.int64), 0
    for lengths, repeats in plan:
        offset = 0
        for length in lengths:
            rows.append((length, taken[length], sequence, offset))
            taken[length] += repeats
            offset += length
        sequence += repeats
    rows.sort()
    return [np.array(column, np.int64) for column in zip(*rows)] or [np.zeros(0, np.int64)] * 4


def _ranked(pieces, total):
    """Add ``rank``: the place of a piece among those of its length, from 0."""
    groups = max(MIN_RANK_GROUPS, -(-total // ROWS_PER_RANK_GROUP))
    salt = F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(groups))
    salted = pieces.withColumn("_salt", salt)
    sizes = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        "length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    order = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    return (
        salted.withColumn("_row", F.row_number().over(order))
        .join(starts, ["length", "_salt"])
        .withColumn("rank", F.col("_before") + F.col("_row") - 1)
        .drop("_salt", "_row", "_before")
    )


def pack_documents(docs, seq_len=SEQ_LEN, end_id=END_ID, files=None):
    """Pieces of ``docs`` with the sequence and offset that each is packed to."""
    pieces = write_shared(token_pieces(docs, seq_len, end_id, files), "pieces")
    histogram = np.zeros(seq_len + 1, np.int64)
    for row in pieces.groupBy("length").count().collect():  # seq_len rows at most
        histogram[row["length"]] = row["count"]
    plan = packing_plan(histogram, seq_len)
    length_at, rank_at, sequence_at, offset_at = places(plan, seq_len)
    stride = int(histogram.max()) + 1 if len(histogram) else 1
    key_at = length_at * stride + rank_at

    def run(batches):
        for batch in batches:
            length, rank = (batch.column(n).to_numpy() for n in ("length", "rank"))
            at = np.searchsorted(key_at, length * stride + rank, "right") - 1
            sequence = sequence_at[at] + rank - rank_at[at]
            out = [batch.column(n) for n in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays(
                [*out, pa.array(sequence), pa.array(offset_at[at])],
                names=[part.split()[0] for part in PLACED.split(", ")],
            )

    return _ranked(pieces, int(histogram.sum())).mapInArrow(run, PLACED)
