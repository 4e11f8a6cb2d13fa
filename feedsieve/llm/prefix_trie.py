"""The prefix trie of conversations, its totals rolled up in bands of depth.

A node is a distinct sequence of first turns ``(role, text)``; it is known by its smallest
member and its depth, as every conversation has one node of each depth.  Conversations of
any length and nodes with any number of members are split over tasks: positions and
prefix digests are worked out per block of a range sort, and node totals are summed per
(node, salt) before they meet.

Totals over subtrees go up in bands of ``BAND`` depths.  A node adds its value to its
ancestors in its own band only; the roots of the bands, with their band's totals, form a
tree that is ``BAND`` times lower, which is rolled up in the same way first.  What a band
root has below it is then added to its ancestors in the band above.  So no row is
repeated more than ``BAND`` times per level, and a depth of D takes log(D) / log(BAND)
levels.

Prefixes are compared by 120 bits: the exclusive-or of the digests of ``position:turn``,
each cut from a SHA-256.  Among 1e12 prefixes two different ones agree with a
probability below 1e-12.

Rows without a conversation id belong to no conversation and are left out.  Null role or
text counts as empty.  Turns come in the order of their number, null first, ties by role
and digest of the text; repeated rows are turns of their own.  An empty table has no
nodes, not even a root.  Other columns are not read.
"""

import hashlib

import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..session import write_shared
from .sorted_blocks import BLOCK, ROW, before, inside, sorted_blocks

BAND = 16
# Bits of a prefix digest per lane: 15 hexadecimal digits.
LANE_DIGITS = 15
# Conversation ids that are joined to one piece before a list of ids is hashed.
PIECE_IDS = 4096
# Salts per shuffle partition; a node's members meet in as many groups.
SALTS_PER_PARTITION = 4


def _lanes(text):
    digest = F.sha2(text, 256)

    def lane(n):
        digits = F.substring(digest, 1 + n * LANE_DIGITS, LANE_DIGITS)
        return F.conv(digits, 16, 10).cast("long")

    return lane(0).alias("x"), lane(1).alias("y")


def turn_digests(conversations):
    """One narrow row per turn: order columns, digest of ``(role, text)``, bytes of text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    framed = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    return conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv"),
        F.col("turn"),
        role.alias("role"),
        F.sha2(text, 256).alias("text_digest"),
        F.sha2(framed, 256).alias("digest"),
        F.octet_length(text).cast("long").alias("bytes"),
    )


def place_turns(turns):
    """``(_block, _row, conv, pos, digest, bytes)`` and the table of ``(_block, conv)`` parts."""
    order = (F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text_digest"))
    sorted_turns = sorted_blocks(turns, order, "turns").select(BLOCK, ROW, "conv", "digest", "bytes")
    parts = sorted_turns.groupBy(BLOCK, "conv").agg(F.count(F.lit(1)).alias("rows"))
    parts = parts.withColumn("start", F.coalesce(F.sum("rows").over(before("conv")), F.lit(0)))
    parts = write_shared(parts, "parts")
    local = sorted_turns.withColumn("pos", F.row_number().over(inside("conv")) - 1)
    placed = local.join(parts, [BLOCK, "conv"]).withColumn("pos", F.col("pos") + F.col("start"))
    return placed.select(BLOCK, ROW, "conv", "pos", "digest", "bytes"), parts


def shared_heads(placed, parts, every=5, heads=9):
    """Rebuild conversations: the first turns of one that ``every`` share, then their own.

    Conversation c takes the first h turns of c - c % every, h = crc32(c) % heads, and its
    own turns behind its first h.  Returns rows ``(_block, conv, depth, digest, bytes)``,
    depth from 1, heads in block -1, and ``(conv, size)`` for every conversation.
    """
    head_size = F.crc32(F.col("conv").cast("string").cast("binary")) % heads
    convs = parts.groupBy("conv").agg(F.sum("rows").alias("own"))
    convs = convs.select("conv", "own", head_size.alias("h"), (F.col("conv") - F.col("conv") % every).alias("base"))
    # At most heads - 1 turns of a conversation.
    first_turns = (
        placed.where((F.col("conv") % every == 0) & (F.col("pos") < heads - 1))
        .groupBy(F.col("conv").alias("base"))
        .agg(F.sort_array(F.collect_list(F.struct("pos", "digest", "bytes"))).alias("heads"))
    )
    convs = write_shared(
        convs.join(first_turns, "base", "left").select(
            "conv",
            "h",
            F.slice("heads", F.lit(1), F.col("h").cast("int")).alias("heads"),
            F.least(F.coalesce(F.size("heads"), F.lit(0)), F.col("h")).alias("taken"),
            F.greatest(F.col("own") - F.col("h"), F.lit(0)).alias("rest"),
        ),
        "rebuilt",
    )
    head_rows = convs.select("conv", F.explode("heads").alias("t")).select(
        F.lit(-1).alias(BLOCK), "conv", (F.col("t.pos") + 1).alias("depth"), "t.digest", "t.bytes"
    )
    # The shift of a conversation reaches its turns by (block, conversation).
    shifts = parts.select(BLOCK, "conv").join(
        convs.select("conv", "h", (F.col("taken") - F.col("h")).alias("shift")), "conv"
    )
    own_rows = (
        placed.join(shifts, [BLOCK, "conv"])
        .where("pos >= h")
        .select(BLOCK, "conv", (F.col("pos") + F.col("shift") + 1).alias("depth"), "digest", "bytes")
    )
    sizes = convs.select("conv", (F.col("taken") + F.col("rest")).alias("size"))
    return head_rows.unionByName(own_rows), sizes


def prefix_rows(rows):
    """Rows with the digest ``(x, y)`` of the whole prefix that ends in them."""
    lanes = _lanes(F.concat(F.col("depth").cast("string"), F.lit(":"), F.col("digest")))
    rows = write_shared(rows.select(BLOCK, "conv", "depth", "bytes", *lanes), "prefixes")
    upto = Window.partitionBy(BLOCK, "conv").orderBy("depth")
    upto = upto.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = rows.groupBy(BLOCK, "conv").agg(F.bit_xor("x").alias("px"), F.bit_xor("y").alias("py"))
    earlier = before("conv")
    parts = parts.select(
        BLOCK,
        "conv",
        F.coalesce(F.bit_xor("px").over(earlier), F.lit(0)).alias("px"),
        F.coalesce(F.bit_xor("py").over(earlier), F.lit(0)).alias("py"),
    )
    local = rows.select(
        BLOCK,
        "conv",
        "depth",
        "bytes",
        F.bit_xor("x").over(upto).alias("x"),
        F.bit_xor("y").over(upto).alias("y"),
    )
    return local.join(parts, [BLOCK, "conv"]).select(
        "conv",
        F.col("depth").cast("long").alias("depth"),
        "bytes",
        F.col("x").bitwiseXOR(F.col("px")).alias("x"),
        F.col("y").bitwiseXOR(F.col("py")).alias("y"),
    )


def name_nodes(prefixes):
    """``(conv, depth, node, n_convs, bytes)`` per prefix row; ``node`` is the smallest member.

    A node may hold most conversations, so its rows are summed per (node, salt), and what
    the node comes to goes back to one row per (node, salt) before it meets the rows.
    """
    spark = prefixes.sparkSession
    salts = SALTS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = ["depth", "x", "y"]
    salted = prefixes.withColumn("salt", F.pmod(F.xxhash64("conv"), F.lit(salts)))
    some = salted.groupBy(*key, "salt").agg(
        F.min("conv").alias("node"), F.count(F.lit(1)).alias("n_convs")
    )
    whole = some.groupBy(*key).agg(F.min("node").alias("node"), F.sum("n_convs").alias("n_convs"))
    per_salt = some.select(*key, "salt").join(whole, key)
    return salted.join(per_salt, [*key, "salt"]).select("conv", "depth", "node", "n_convs", "bytes")


def _levels(deepest):
    """How many levels of bands a tree of that depth takes."""
    levels = 1
    while deepest >= BAND:
        deepest //= BAND
        levels += 1
    return levels


def roll_up(paths, values, names):
    """Sums of the values over the subtree of every node, the node included.

    ``paths`` holds ``(conv, depth, node)`` for every conversation and depth from 0 to its
    length, ``values`` one row ``(conv, depth, <names>)`` per node, known by its smallest
    member.  Returns ``(node, depth, <names>)``.
    """
    deepest = paths.agg(F.max("depth")).first()[0]
    if deepest is None:
        return values.withColumnRenamed("conv", "node")
    level = write_shared(paths.join(values, ["conv", "depth"], "left"), "level")
    levels = [level]
    band = F.expr(f"depth div {BAND}")
    for _ in range(_levels(deepest) - 1):
        # Totals of a band belong to its root, which is on the path of all its members.
        here = levels[-1].withColumn("band", band)
        per_path = here.groupBy("conv", "band").agg(
            F.min(F.when(F.col("depth") % BAND == 0, F.col("node"))).alias("node"),
            *[F.sum(n).alias(n) for n in names],
        )
        totals = per_path.groupBy("node", "band").agg(*[F.sum(n).alias(n) for n in names])
        roots = here.where(F.col("depth") % BAND == 0).select("conv", F.col("band").alias("depth"), "node")
        # A node's value stands in the row of its smallest member.
        own = totals.select(F.col("node").alias("conv"), F.col("band").alias("depth"), *names)
        levels.append(write_shared(roots.join(own, ["conv", "depth"], "left"), "level"))
    below = None
    deeper = Window.partitionBy("conv", "band").orderBy(F.col("depth").desc())
    for here in reversed(levels):
        here = here.withColumn("band", band)
        if below is not None:
            # What hangs below the band counts as a value one step under its last depth.
            hanging = below.select(
                F.col("node").alias("conv"),
                (F.col("depth") * BAND).alias("depth"),
                F.lit(None).cast("long").alias("node"),
                *names,
                (F.col("depth") - 1).alias("band"),
            ).where("band >= 0")
            here = here.select("conv", "depth", "node", *names, "band").unionByName(hanging)
        spread = here.select(
            "node", "depth", *[F.sum(n).over(deeper).alias(n) for n in names]
        ).where(F.col("node").isNotNull() & F.col(names[0]).isNotNull())
        below = write_shared(
            spread.groupBy("node", "depth").agg(*[F.sum(n).alias(n) for n in names]), "totals"
        )
    return below


_ENDS = "node long, depth long, ends_sha256 string"


def hash_ends(ends):
    """SHA-256 of the ids that end in a node, ascending and joined by commas.

    Ids are joined to pieces of bounded length first; the pieces of a node then pass
    through its hash in order, one at a time.
    """
    piece = F.expr(f"conv div {PIECE_IDS}")
    ids = F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string"))
    pieces = ends.groupBy("node", "depth", piece.alias("piece")).agg(F.array_join(ids, ",").alias("ids"))
    dealt = pieces.repartition("node", "depth").sortWithinPartitions("node", "depth", "piece")

    def run(batches):
        key, digest = None, None
        for batch in batches:
            out = []
            columns = [batch.column(n).to_pylist() for n in ("node", "depth", "ids")]
            for node, depth, ids in zip(*columns):
                if (node, depth) == key:
                    digest.update(b",")
                else:
                    if key is not None:
                        out.append((*key, digest.hexdigest()))
                    key, digest = (node, depth), hashlib.sha256()
                digest.update(ids.encode())
            yield _end_rows(out)
        if key is not None:
            yield _end_rows([(*key, digest.hexdigest())])

    return dealt.select("node", "depth", "ids").mapInArrow(run, _ENDS)


def _end_rows(rows):
    nodes, depths, digests = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays(
        [pa.array(nodes, pa.int64()), pa.array(depths, pa.int64()), pa.array(digests, pa.string())],
        names=["node", "depth", "ends_sha256"],
    )


def build_trie(rows, sizes):
    """Nodes of the trie of conversations given as ``(_block, conv, depth, digest, bytes)``.

    ``sizes`` names every conversation ``(conv, size)``, those without turns included.
    """
    summary = sizes.agg(F.min("conv"), F.count(F.lit(1))).first()
    first, n_convs = summary
    root = F.lit(first).cast("long")
    named = name_nodes(prefix_rows(rows)).select("conv", "depth", "node", "n_convs", "bytes")
    tops = sizes.select(
        "conv",
        F.lit(0).cast("long").alias("depth"),
        root.alias("node"),
        F.lit(n_convs).cast("long").alias("n_convs"),
        F.lit(0).cast("long").alias("bytes"),
    )
    paths = write_shared(named.unionByName(tops), "paths")
    # The parent of a node is on the path of its smallest member.
    above = paths.select("conv", (F.col("depth") + 1).alias("depth"), F.col("node").alias("parent"))
    nodes = write_shared(
        paths.where("conv = node").join(above, ["conv", "depth"], "left").drop("node"), "nodes"
    )
    children = (
        nodes.where("depth > 0")
        .groupBy(F.col("parent").alias("conv"), (F.col("depth") - 1).alias("depth"))
        .agg(F.count(F.lit(1)).alias("n_children"))
    )
    nodes = write_shared(
        nodes.join(children, ["conv", "depth"], "left").select(
            "conv", "depth", "parent", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "bytes"
        ),
        "nodes",
    )
    values = nodes.select(
        "conv",
        "depth",
        (F.col("n_children") == 0).cast("long").alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens"),
    )
    totals = roll_up(paths.select("conv", "depth", "node"), values, ["n_leaves", "saved_tokens"])
    last = sizes.select("conv", F.col("size").cast("long").alias("depth"))
    ends = paths.join(last, ["conv", "depth"]).select("node", "depth", "conv")
    found = (
        nodes.withColumnRenamed("conv", "node")
        .join(totals, ["node", "depth"])
        .join(hash_ends(ends), ["node", "depth"], "left")
    )
    return found.select(
        F.col("node").alias("conv_id"),
        "depth",
        F.col("parent").alias("parent_conv_id"),
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )


def trie_of(conversations):
    """Nodes of the trie of the conversations as they are."""
    placed, parts = place_turns(turn_digests(conversations))
    rows = placed.select(BLOCK, "conv", (F.col("pos") + 1).alias("depth"), "digest", "bytes")
    return build_trie(rows, parts.groupBy("conv").agg(F.sum("rows").alias("size")))


def rebuilt_trie(conversations):
    """Nodes of the trie of the conversations rebuilt on shared heads."""
    return build_trie(*shared_heads(*place_turns(turn_digests(conversations))))


def oracle_sql(every=5, heads=9):
    """The rebuilt trie by comparing whole prefixes in SQL."""
    from .sql_parts import crc32_sql

    return f"""
    with t as (
        select conv_id as c, coalesce(role, '') as r, coalesce(text, '') as x,
               row_number() over (partition by conv_id order by turn nulls first,
                   coalesce(role, ''), sha256(coalesce(text, ''))) - 1 as pos
        from conversations where conv_id is not null),
    k as (select c, c - c % {every} as base, {crc32_sql("digits")} % {heads} as h
        from (select distinct c, hex(encode(c::varchar)) as digits from t) i),
    b as (
        select k.c, 0 as part, pos, r, x from k join t on t.c = k.base and pos < h
        union all
        select k.c, 1, pos, r, x from k join t on t.c = k.c and pos >= h),
    p as (select c, r, x, row_number() over (partition by c order by part, pos) as depth from b),
    q as (
        select c, depth, x, list({{'r': r, 'x': x}}) over (partition by c order by depth) as prefix
        from p
        union all
        select c, 0, '', [] from k),
    paths as (
        select c, depth, x, min(c) over (partition by depth, prefix) as node,
               count(*) over (partition by depth, prefix) as n_convs,
               depth = max(depth) over (partition by c) as ends
        from q),
    nodes as (
        select n.node, n.depth, n.n_convs, u.node as parent,
               (n.n_convs - 1) * octet_length(encode(n.x)) as saved
        from paths n left join paths u on u.c = n.node and u.depth = n.depth - 1
        where n.c = n.node),
    children as (select parent as node, depth - 1 as depth, count(*) as n from nodes
        where depth > 0 group by all),
    below as (
        select a.node, a.depth, sum(n.saved) as saved, count(*) filter (where h.n is null) as leaves
        from nodes n left join children h on h.node = n.node and h.depth = n.depth
        join paths a on a.c = n.node and a.depth <= n.depth
        group by all),
    ends as (select node, depth, string_agg(c::varchar, ',' order by c) as ids from paths
        where ends group by all)
    select n.node as conv_id, n.depth, n.parent as parent_conv_id, n.n_convs,
           coalesce(h.n, 0) as n_children, leaves as n_leaves,
           cast(below.saved as bigint) as saved_tokens, sha256(coalesce(ids, '')) as ends_sha256
    from nodes n join below using (node, depth)
    left join children h using (node, depth) left join ends using (node, depth)"""
