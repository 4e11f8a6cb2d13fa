"""Nearest neighbours by hierarchical navigable small-world graphs, one per shard.

Equal vectors are one node of a graph, which keeps their smallest ids: as ties go
to the smaller id, no others of them can be among the nearest.  Nodes are dealt to
shards of bounded size by the hash of their vector.  A shard's graph is built in one
task and kept as flat neighbour arrays, one row of the index table per shard.  Queries come in blocks; a task walks one shard's graph for a
whole block at once, and the shards' results are merged per query.

The graph is built as by inserting one vector after another, each linked to
diverse ones of its nearest predecessors and these back to it; as a shard is
small, the predecessors are found exactly, a batch at a time.  Nodes that no link
leads to get one from a neighbour, and the lowest layer is entered at nodes far from
each other too, so that no dense part of a shard hides the rest.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..session import write_shared
from .vectors import comparable, matrix, numbers

SHARD_ROWS = 4096
QUERY_ROWS = 256
LINKS = 16
CANDIDATES = 48
BEAM = 128
SPARE = 10  # candidates per shard beyond k that are measured in double precision
PIVOTS = 16  # nodes far from each other where the lowest layer is entered
SINGLE = 1e15  # parts beyond it, or all below its inverse, take double precision in walks
SEED = 5
INDEX = (
    "_dim int, shard int, ids binary, starts binary, vectors binary, entries binary,"
    " levels array<struct<nodes:binary,links:binary,width:int>>"
)


def distances(x, y):
    """Squared Euclidean distances of all pairs, in the precision of the vectors."""
    d = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * (x @ y.T)
    return np.maximum(d, 0)


def choose_diverse(dist, nodes, candidates, width):
    """Up to ``width`` of each node's candidates (nearest first, -1 for none).

    One that is nearer to a chosen candidate than to the node is passed over;
    what is left of the width is filled with the nearest that were passed over.
    """
    chosen = np.full((len(nodes), width), -1, np.int32)
    count = np.zeros(len(nodes), np.int64)
    passed = np.zeros(candidates.shape, bool)
    rows = np.arange(len(nodes))
    for c in range(candidates.shape[1]):
        j = candidates[:, c]
        away = dist[nodes, j]
        near = (chosen >= 0) & (dist[chosen, j[:, None]] < away[:, None])
        good = (j >= 0) & (count < width) & ~near.any(axis=1)
        chosen[rows[good], count[good]] = j[good]
        count[good] += 1
        passed[:, c] = (j >= 0) & ~good
    for c in range(candidates.shape[1]):
        more = passed[:, c] & (count < width)
        chosen[rows[more], count[more]] = candidates[more, c]
        count[more] += 1
    return chosen


def _nearest(dist, nodes, lists):
    """The candidates of each node by distance, nearest first, each once."""
    lists = np.sort(lists, axis=1)
    lists[:, 1:][lists[:, 1:] == lists[:, :-1]] = -1
    away = np.where(lists >= 0, dist[np.asarray(nodes)[:, None], lists], np.inf)
    order = np.argsort(away, axis=1, kind="stable")
    return np.take_along_axis(lists, order, axis=1)


def _incoming(links, nodes, n, width):
    """For each of ``n`` nodes up to ``width`` of ``nodes`` that link to it."""
    source = np.repeat(nodes, links.shape[1])
    target = links.ravel()
    source, target = source[target >= 0], target[target >= 0]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    place = np.arange(len(target)) - np.searchsorted(target, target, "left")
    out = np.full((n, width), -1, np.int32)
    fits = place < width
    out[target[fits], place[fits]] = source[fits]
    return out


def build_layer(dist, nodes, width):
    """Links of the nodes of a layer, given in the order of their insertion."""
    links = np.full((len(dist), width), -1, np.int32)
    done = 1
    while done < len(nodes):
        batch = nodes[done : 2 * done]
        seen = nodes[: 2 * done]
        away = dist[np.ix_(batch, seen)].copy()
        away[np.arange(len(seen))[None, :] >= (done + np.arange(len(batch)))[:, None]] = np.inf
        k = min(CANDIDATES, len(seen))
        near = np.argpartition(away, k - 1, axis=1)[:, :k]
        known = np.isfinite(np.take_along_axis(away, near, axis=1))
        lists = np.where(known, seen[near], -1).astype(np.int32)
        links[batch] = choose_diverse(dist, batch, _nearest(dist, batch, lists), width)
        back = _incoming(links[batch], batch, len(dist), 4 * width)
        touched = np.flatnonzero((back >= 0).any(axis=1))
        lists = np.concatenate([links[touched], back[touched]], axis=1)
        links[touched] = choose_diverse(dist, touched, _nearest(dist, touched, lists), width)
        done *= 2
    return np.concatenate([links, _links_to_orphans(links, nodes)], axis=1)


def _links_to_orphans(links, nodes):
    """Links to the nodes that have no incoming one, from the nodes that they link to."""
    linked = np.zeros(len(links), bool)
    linked[links[links >= 0]] = True
    waiting = nodes[1:][~linked[nodes[1:]]]
    found = [np.empty((len(links), 0), np.int32)]
    for c in range(links.shape[1]):
        waiting = waiting[links[waiting, c] >= 0]
        if not len(waiting):
            break
        extra = _incoming(links[waiting, c : c + 1], waiting, len(links), LINKS // 4)
        extra = extra[:, (extra >= 0).any(axis=0)]
        found.append(extra)
        linked[extra[extra >= 0]] = True
        waiting = waiting[~linked[waiting]]
    return np.concatenate(found, axis=1)


def far_apart(dist, first, many):
    """Up to ``many`` nodes, each the farthest from those before it."""
    chosen, away = [first], dist[first].copy()
    while len(chosen) < many and away.max() > 0:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, dist[chosen[-1]])
    return np.array(chosen, np.int64)


def scale_of(*arrays):
    """Power of two that brings the largest part into the range of squares, mostly 1."""
    big = max((np.abs(a).max(initial=0) for a in arrays), default=0)
    return 1.0 if big == 0 or 1e-150 < big < 1e150 else 2.0 ** np.floor(np.log2(big))


def walking(*arrays):
    """The arrays as walks take them: single precision unless parts are too large or small."""
    scale = scale_of(*arrays)
    arrays = [a / scale for a in arrays]
    big = [np.abs(a).max(initial=0) for a in arrays]
    single = max(big) < SINGLE and max(big) > 1 / SINGLE
    return [a.astype(np.float32) if single else a for a in arrays]


def build_graph(vectors, seed=SEED):
    """``(entries, layers)``: per layer, lowest first, its nodes and their links.

    The first entry is the one of the top layer, the others lie far from each other.
    """
    n = len(vectors)
    rng = np.random.default_rng(seed)
    order = rng.permutation(n)
    height = np.floor(rng.exponential(1 / np.log(LINKS), n)).astype(int)
    (walked,) = walking(vectors)
    dist = distances(walked, walked)
    layers = []
    for level in range(height.max(initial=0) + 1):
        nodes = order[height[order] >= level]
        width = 2 * LINKS if level == 0 else LINKS
        layers.append((nodes.astype(np.int32), build_layer(dist, nodes, width)[nodes]))
    return far_apart(dist, int(layers[-1][0][0]), PIVOTS), layers


def search_layer(vectors, links, queries, entries, beam):
    """The ``beam`` nearest nodes found from the entries, for all queries at once."""
    q, n = len(queries), len(vectors)
    rows = np.arange(q)
    seen = np.zeros((q, n + 1), bool)  # the last column stands for "no node"
    ids = np.full((q, beam), -1, np.int64)
    away = np.full((q, beam), np.inf, vectors.dtype)
    fresh = np.zeros((q, beam), bool)
    width = min(entries.shape[1], beam)
    ids[:, :width] = entries[:, :width]
    for c in range(width):
        known = ids[:, c] >= 0
        again = seen[rows, ids[:, c]]
        seen[rows, ids[:, c]] = True
        ok = known & ~again
        away[ok, c] = ((vectors[ids[ok, c]] - queries[ok]) ** 2).sum(1)
        fresh[:, c] = ok
        ids[~ok, c] = -1
    seen[:, n] = True
    while True:
        waiting = np.where(fresh, away, np.inf)
        best = waiting.argmin(axis=1)
        active = np.flatnonzero(np.isfinite(waiting[rows, best]))
        if not len(active):
            return ids, away
        best = best[active]
        fresh[active, best] = False
        around = links[ids[active, best]]
        new = ~seen[active[:, None], around]
        seen[active[:, None], around] = True
        d = ((vectors[around] - queries[active][:, None, :]) ** 2).sum(2)
        d = np.where(new, d, np.inf).astype(vectors.dtype)
        all_d = np.concatenate([away[active], d], axis=1)
        all_ids = np.concatenate([ids[active], np.where(new, around, -1)], axis=1)
        all_fresh = np.concatenate([fresh[active], new], axis=1)
        keep = np.argpartition(all_d, beam - 1, axis=1)[:, :beam]
        away[active] = np.take_along_axis(all_d, keep, axis=1)
        ids[active] = np.take_along_axis(all_ids, keep, axis=1)
        fresh[active] = np.take_along_axis(all_fresh, keep, axis=1) & np.isfinite(away[active])


def search_graph(vectors, starts, layers, queries, beam=BEAM):
    """Nodes near each query, by walking down the layers (-1 for none)."""
    single, wanted = walking(vectors, queries)
    entries = np.full((len(queries), 1), starts[0], np.int64)
    for level in range(len(layers) - 1, -1, -1):
        nodes, own = layers[level]
        links = np.full((len(vectors), own.shape[1]), -1, np.int32)
        links[nodes] = own
        width = beam if level == 0 else max(8, beam // 8)
        if level == 0:
            far = np.broadcast_to(starts[1:], (len(queries), len(starts) - 1))
            entries = np.concatenate([entries, far], axis=1)
        entries, away = search_layer(single, links, wanted, entries, width)
        order = np.argsort(away, axis=1)
        entries = np.take_along_axis(entries, order, axis=1)
    return entries


def _build_row(table):
    ids = numbers(table["vec_id"])
    vectors, node = np.unique(matrix(table["_vector"]), axis=0, return_inverse=True)
    node = node.reshape(-1)
    order = np.lexsort((ids, node))
    entries, layers = build_graph(vectors)
    levels = [
        {"nodes": n.astype("<i4").tobytes(), "links": x.astype("<i4").tobytes(), "width": x.shape[1]}
        for n, x in layers
    ]
    row = {
        "_dim": vectors.shape[1],
        "shard": int(numbers(table["shard"])[0]),
        "ids": ids[order].astype("<i8").tobytes(),
        "starts": np.searchsorted(node[order], np.arange(len(vectors) + 1)).astype("<i8").tobytes(),
        "vectors": vectors.astype("<f8").tobytes(),
        "entries": entries.astype("<i8").tobytes(),
        "levels": levels,
    }
    level = pa.struct([("nodes", pa.binary()), ("links", pa.binary()), ("width", pa.int32())])
    types = [pa.int32()] * 2 + [pa.binary()] * 4 + [pa.list_(level)]
    return pa.table({k: pa.array([v], t) for (k, v), t in zip(row.items(), types)})


def build_index(rows, ties, shard_rows=SHARD_ROWS):
    """Index table of ``comparable`` rows: one row per shard, and shards per length.

    Of equal vectors the ``ties`` smallest ids are kept, which is enough for searches
    of ``k < ties``.  Each shard is built in a task of its own.
    """
    different = rows.select("_dim", F.xxhash64("_vector").alias("_hash")).distinct()
    shards = different.groupBy("_dim").agg(
        F.ceil(F.count(F.lit(1)) / shard_rows).cast("int").alias("_shards")
    )
    tasks = shards.agg(F.sum("_shards")).first()[0] or 1
    equal = Window.partitionBy("_dim", "_vector").orderBy("vec_id")
    nodes = rows.withColumn("_place", F.row_number().over(equal)).where(F.col("_place") <= ties)
    shard = F.pmod(F.xxhash64("_vector"), F.col("_shards")).cast("int")
    dealt = nodes.join(shards, "_dim").select("_dim", shard.alias("shard"), "vec_id", "_vector")
    dealt = dealt.repartition(int(tasks), "_dim", "shard")
    return write_shared(dealt.groupBy("_dim", "shard").applyInArrow(_build_row, INDEX), "hnsw")


def _pack_queries(table):
    ids = numbers(table["vec_id"])
    return pa.table(
        {
            "_dim": pa.array([int(numbers(table["_dim"])[0])], pa.int32()),
            "query_ids": pa.array([ids.astype("<i8").tobytes()], pa.binary()),
            "queries": pa.array([matrix(table["_vector"]).astype("<f8").tobytes()], pa.binary()),
        }
    )


def search(index, queries, k=10, beam=BEAM, query_rows=QUERY_ROWS):
    """The ``k`` nearest found for each of ``queries`` (``comparable`` rows), itself left out.

    ``query_id, rank, vec_id, score``: nearest first, equal distances by the smaller
    id; the score is the Euclidean distance in double precision.
    """
    blocks = queries.groupBy("_dim").agg(
        F.ceil(F.count(F.lit(1)) / query_rows).cast("int").alias("_blocks")
    )
    block = F.pmod(F.xxhash64("vec_id"), F.col("_blocks")).cast("int")
    packed = (
        queries.join(blocks, "_dim")
        .select("_dim", block.alias("_block"), "vec_id", "_vector")
        .groupBy("_dim", "_block")
        .applyInArrow(_pack_queries, "_dim int, query_ids binary, queries binary")
    )
    shards = index.select("_dim", "shard")
    tasks = packed.join(shards, "_dim").repartition("_dim", "shard", F.xxhash64("query_ids"))
    tasks = tasks.join(index, ["_dim", "shard"])

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                yield _search_row(batch.slice(row, 1).to_pylist()[0], k, beam)

    columns = ["_dim", "query_ids", "queries", "ids", "starts", "vectors", "entries", "levels"]
    found = tasks.select(*columns).mapInArrow(run, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def _search_row(row, k, beam):
    dim = row["_dim"]
    ids = np.frombuffer(row["ids"], "<i8")
    starts = np.frombuffer(row["starts"], "<i8")
    vectors = np.frombuffer(row["vectors"], "<f8").reshape(-1, dim)
    query_ids = np.frombuffer(row["query_ids"], "<i8")
    queries = np.frombuffer(row["queries"], "<f8").reshape(-1, dim)
    layers = [
        (
            np.frombuffer(level["nodes"], "<i4"),
            np.frombuffer(level["links"], "<i4").reshape(-1, level["width"]),
        )
        for level in row["levels"]
    ]
    entries = np.frombuffer(row["entries"], "<i8")
    near = search_graph(vectors, entries, layers, queries, max(beam, k + 1 + SPARE))
    near = near[:, : k + 1 + SPARE]
    scale = scale_of(vectors, queries)
    apart = vectors[near] / scale - queries[:, None, :] / scale
    away = np.sqrt((apart**2).sum(2)) * scale
    out = []
    for i, query_id in enumerate(query_ids):
        nodes = np.flatnonzero(near[i] >= 0)
        held = [ids[starts[j] : starts[j + 1]] for j in near[i, nodes]]
        place = np.repeat(nodes, [len(h) for h in held])
        held = np.concatenate(held)
        order = [o for o in np.lexsort((held, away[i, place])) if held[o] != query_id]
        out += [(query_id, held[o], away[i, place[o]]) for o in order[:k]]
    columns = list(zip(*out)) or [(), (), ()]
    types = (pa.int64(), pa.int64(), pa.float64())
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, types)], names=["query_id", "vec_id", "score"]
    )


def nearest_neighbours(embeddings, every=100, k=10):
    """Search all of ``embeddings`` for the rows whose id is divisible by ``every``.

    Vectors that are null, empty, zero or hold null or non-finite components take
    no part; vectors are compared with those of their own length.  Rows that repeat
    an id are one vector.  Equal vectors are ties, of which the smaller ids come
    first.  No vectors, or no queries, give no rows.
    """
    rows = comparable(embeddings)
    return search(build_index(rows, k + 1), rows.where(F.col("vec_id") % every == 0), k)
