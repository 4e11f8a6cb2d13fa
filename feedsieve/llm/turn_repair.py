"""Repair of the turn structure of conversations at the least cost.

Edits: keep a row (0), give it the role user or assistant (2), delete it (3; blank and
duplicate rows must go), insert an empty turn of user or assistant anywhere (2); a
truncated row that stays adds 1.  The roles that remain must read ``(s?(ua)+)?`` by their
initials.  Of the cheapest edits those with the least audit are taken, the audit being
the initials of the edits (D, I, K, R) in order.

A node is a place between two rows and a state of the grammar.  The cost to the end of
the conversation is worked out backwards; arcs on a cheapest way stay.  Nodes are then
ranked by their least audits of length 1, 2, 4, ..., each rank made from two of the
length before, along pointers that double with it.  The arcs of a node have different
letters, as a letter and a state decide the next state, so the least arc is unique and
the doubled pointers lead along the least way; they also list its edits without walking.

A conversation of any length is split: rows are sorted by ranges, and a range is a block.
Of the few conversations that lie in several blocks each part is summed up as a 4 x 4
matrix of costs first, then as the state it leaves for each state it is entered in, so
that the parts can be solved apart.  Only the hash of a repaired conversation, which is
defined over its whole text, passes through one task, turn by turn.

Rows without a conversation id belong to none and are left out.  Null roles and texts
count as one blank.  Rows are taken by turn, null first, ties by role and digest of the
text.  A role that is empty or begins with another letter than s, u, a cannot be kept.
Repeated rows are duplicates; an empty table gives no rows.  Other columns are not read.
"""

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..session import write_shared
from .sorted_blocks import BLOCK, ROW, inside, sorted_blocks

# Fixed values of the task.
RETAG_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 2, 3, 2, 1
BLANKS = " \t\n\x0b\x0c\r"
DAMAGES = 20

NONE, BLANK, DUPLICATE, TRUNCATED = range(4)
# States: nothing yet, after s, after u, after a.  Initials: s, u, a, any other.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
KEPT = np.array([[1, -1, -1, -1], [2, 2, -1, 2], [-1, -1, 3, -1], [-1, -1, -1, -1]])
# State after a turn whose role can be chosen, and that role.
CHOSEN = np.array([2, 2, 3, 2])
CHOSEN_ROLE = np.array(["user", "user", "assistant", "user"], dtype=object)
# Kind of a row: its initial, 4 more if truncated, or that it must go.
MUST_GO, KINDS = 8, 9
FAR = 1 << 40

LETTERS = np.array(["", "D", "I", "K", "R"], dtype=object)
END, DELETE, INSERT, KEEP, RETAG = range(5)


# --- Damage, faults, light rows ----------------------------------------------


def damaged(conversations):
    """Conversations with the faults of the task; nulls as one blank."""
    conv, turn = F.col("conv_id").cast("string"), F.col("turn").cast("string")
    key = F.concat(F.coalesce(conv, F.lit(" ")), F.lit(":"), F.coalesce(turn, F.lit(" ")))
    rows = conversations.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
        (F.crc32(key.cast("binary")) % DAMAGES).alias("damage"),
    )
    text = (
        F.when(F.col("damage") == 1, F.lit(""))
        .when(F.col("damage") == 2, F.regexp_replace("text", "[.!?]", ""))
        .otherwise(F.col("text"))
    )
    copies = F.when(F.col("damage") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return (
        rows.where("damage <> 0")
        .withColumn("_copy", F.explode(copies))
        .select(
            "conv_id",
            "turn",
            F.when(F.col("damage") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
            text.alias("text"),
        )
    )


def _turns(rows):
    return rows.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
    )


def mark_faults(rows):
    """A narrow row per turn, in blocks: order columns, ``initial`` and first ``fault``."""
    shown = F.rtrim("text", F.lit(BLANKS))
    last = F.substring(shown, -1, 1)
    plain = (
        F.when(shown == "", BLANK)
        .when(~last.isin(".", "!", "?"), TRUNCATED)
        .otherwise(NONE)
    )
    initial = F.instr(F.lit("sua"), F.substring("role", 1, 1))
    narrow = _turns(rows).select(
        "conv",
        "turn",
        "role",
        F.sha2("text", 256).alias("digest"),
        plain.alias("plain"),
        F.when(F.col("role") == "", 3).when(initial == 0, 3).otherwise(initial - 1).alias("initial"),
    )
    order = (F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest"))
    blocks = sorted_blocks(narrow, order, "turns")
    # The first of equal rows, found per block before the blocks meet.
    same = ["conv", "role", "digest"]
    firsts = blocks.groupBy(BLOCK, *same).agg(F.min(ROW).alias("first"))
    firsts = firsts.groupBy(*same).agg(F.min("first").alias(ROW)).select(ROW, F.lit(True).alias("is_first"))
    fault = (
        F.when(F.col("plain") == BLANK, BLANK)
        .when(F.col("is_first").isNull(), DUPLICATE)
        .otherwise(F.col("plain"))
    )
    marked = blocks.join(firsts, ROW, "left").withColumn("fault", fault)
    return write_shared(marked.drop("plain", "is_first"), "faults")


def count_faults(marked):
    """Gaps, faults and illegal neighbours per conversation."""
    legal = F.array(*[F.lit(pair) for pair in (1, 12, 21)])

    def is_illegal(before, after):
        return before.isNotNull() & ~F.array_contains(legal, before * 10 + after)

    per_block = marked.withColumn("previous", F.lag("initial").over(inside("conv")))
    parts = per_block.groupBy(BLOCK, "conv").agg(
        F.min_by("initial", ROW).alias("first"),
        F.max_by("initial", ROW).alias("last"),
        F.count_if(is_illegal(F.col("previous"), F.col("initial"))).alias("illegal"),
        *[
            F.count_if(F.col("fault") == fault).alias(name)
            for name, fault in (("blank", BLANK), ("duplicate", DUPLICATE), ("truncated", TRUNCATED))
        ],
    )
    edge = F.lag("last").over(Window.partitionBy("conv").orderBy(BLOCK))
    parts = parts.withColumn("illegal", F.col("illegal") + is_illegal(edge, F.col("first")).cast("long"))
    counts = parts.groupBy("conv").agg(
        *[F.sum(n).alias(n) for n in ("blank", "duplicate", "truncated", "illegal")]
    )
    turns = marked.groupBy("conv").agg(
        F.min("turn").alias("least"), F.max("turn").alias("most"), F.count_distinct("turn").alias("turns")
    )
    # Null where the span of the turns is no long.
    span = F.try_subtract(F.try_subtract("most", "least"), F.col("turns") - 1)
    gaps = F.when(F.col("turns") == 0, F.lit(0)).otherwise(span)
    return counts.join(turns.select("conv", gaps.cast("long").alias("gaps")), "conv")


# --- Costs and least ways, in numpy ------------------------------------------


def _arcs():
    """Costs and next states by kind of row, letter and state."""
    cost = np.full((KINDS, 5, 4), FAR)
    goal = np.zeros((KINDS, 5, 4), np.int64)
    goal[:] = np.arange(4)
    cost[:, DELETE] = DELETE_COST
    for initial in range(4):
        for more in (0, 1):
            kind = initial + 4 * more
            may = KEPT[initial] >= 0
            cost[kind, KEEP, may] = more * TRUNCATED_COST
            goal[kind, KEEP, may] = KEPT[initial][may]
            cost[kind, RETAG] = RETAG_COST + more * TRUNCATED_COST
            goal[kind, RETAG] = CHOSEN
    return cost, goal


ARC_COST, ARC_GOAL = _arcs()


def _times(left, right):
    """Product of stacks of cost matrices: sums along, least across."""
    return (left[..., :, :, None] + right[..., None, :, :]).min(-2)


def _matrices():
    insert = np.full((4, 4), FAR)
    np.fill_diagonal(insert, 0)
    once = insert.copy()
    once[np.arange(4), CHOSEN] = INSERT_COST
    twice = _times(once, once)
    rows = np.full((KINDS, 4, 4), FAR)
    for kind in range(KINDS):
        for letter in (DELETE, KEEP, RETAG):
            for state in range(4):
                at = kind, state, ARC_GOAL[kind, letter, state]
                rows[at] = min(rows[at], ARC_COST[kind, letter, state])
    return twice, np.minimum(_times(twice, rows), FAR)


# More than two inserts in a row never pay.
INSERTS, ROW_MATRIX = _matrices()
LAST = INSERTS[:, [START, AFTER_A]].min(1)


def whole_matrix(kinds):
    """Cost from each state before the rows to each state behind them."""
    stack = ROW_MATRIX[kinds]
    while len(stack) > 1:
        odd = stack[len(stack) - len(stack) % 2 :]
        stack = np.concatenate([_times(stack[0 : len(stack) - 1 : 2], stack[1::2]), odd])
        stack = np.minimum(stack, FAR)
    return stack[0]


class Ways:
    """Cheapest ways through parts of conversations that lie one behind the other.

    ``sizes`` are the numbers of rows of the parts, ``after`` the costs to the end of the
    conversation behind each part, ``last`` whether the conversation ends with it.
    """

    def __init__(self, kinds, sizes, after, last):
        self.sizes, self.kinds = sizes, kinds
        ends = np.cumsum(sizes)
        # A part of n rows has n + 1 places.
        self.first = ends - sizes + np.arange(len(sizes))
        self.end = ends + np.arange(len(sizes))
        places = len(kinds) + len(sizes)
        self.row_of = np.full(places, -1)
        inner = np.ones(places, bool)
        inner[self.end] = False
        self.row_of[inner] = np.arange(len(kinds))
        self.cost = np.zeros((places, 4), np.int64)
        self.cost[self.end] = after
        longest_first = np.argsort(-sizes, kind="stable")
        falling = sizes[longest_first]
        for step in range(int(sizes.max(initial=0))):
            live = longest_first[: np.searchsorted(-falling, -step, "left")]
            place = self.end[live] - 1 - step
            matrix = ROW_MATRIX[kinds[self.row_of[place]]]
            self.cost[place] = (matrix + self.cost[place + 1][:, None, :]).min(2)
        self._point(inner, last)

    def _point(self, inner, last):
        """Least arc of each node, then ranks and pointers of lengths 1, 2, 4, ..."""
        places = len(self.cost)
        state = np.arange(4)
        node = np.arange(places * 4).reshape(places, 4)
        letter = np.zeros((places, 4), np.int8)
        goal = node.copy()
        may_insert = inner.copy()
        may_insert[self.end] = last
        kinds = self.kinds[self.row_of[inner]]
        # From the greatest letter to the least, so that the least stays.
        for arc in (RETAG, KEEP, INSERT, DELETE):
            if arc == INSERT:
                fits = INSERT_COST + self.cost[:, CHOSEN] == self.cost
                fits &= may_insert[:, None]
                letter[fits] = arc
                goal[fits] = (node[:, :1] + CHOSEN)[fits]
            else:
                to = ARC_GOAL[kinds, arc]
                below = np.flatnonzero(inner) + 1
                fits = ARC_COST[kinds, arc] + self.cost[below[:, None], to] == self.cost[inner]
                at = np.flatnonzero(inner)[:, None] * 4 + state
                letter.reshape(-1)[at[fits]] = arc
                goal.reshape(-1)[at[fits]] = (below[:, None] * 4 + to)[fits]
        self.letter, pointer = letter.reshape(-1), goal.reshape(-1)
        self.rank = self.letter.astype(np.int64)
        self.steps = (self.letter != END).astype(np.int64)
        self.pointers = [pointer]
        while (self.letter[pointer] != END).any():
            pair = self.rank * (self.rank.max() + 1) + self.rank[pointer]
            self.rank = np.unique(pair, return_inverse=True)[1]
            self.steps = self.steps + self.steps[pointer]
            pointer = pointer[pointer]
            self.pointers.append(pointer)

    def leaves(self, states):
        """State in which each part is left, for the state it is entered in."""
        return self.pointers[-1][self.first * 4 + states] % 4

    def edits(self, states):
        """``(part, step, node)`` of the least way through each part."""
        entry = self.first * 4 + states
        lengths = self.steps[entry]
        part = np.repeat(np.arange(len(entry)), lengths)
        step = np.arange(len(part)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        node = entry[part]
        for k, pointer in enumerate(self.pointers):
            moved = (step >> k & 1).astype(bool)
            node[moved] = pointer[node[moved]]
        return part, step, node


def _kinds(initial, fault):
    kinds = initial + 4 * (fault == TRUNCATED)
    return np.where((fault == BLANK) | (fault == DUPLICATE), MUST_GO, kinds)


def _rows_in_order(table):
    table = table.sort_by(ROW)
    column = lambda name: table.column(name).to_numpy(zero_copy_only=False)
    return table, column("conv"), _kinds(column("initial").astype(np.int64), column("fault"))


# --- Conversations in several blocks -----------------------------------------


def _solve_parts(marked):
    """``(_block, conv, after, last, state)`` of the parts of conversations in several blocks.

    Blocks are sorted by conversation, so only the first and the last one of a block can
    reach into another: at most two parts per block.
    """
    edges = marked.groupBy(BLOCK).agg(F.min("conv").alias("a"), F.max("conv").alias("b"))
    parts = edges.select(BLOCK, F.explode(F.array_distinct(F.array("a", "b"))).alias("conv"))
    split = parts.groupBy("conv").count().where("count > 1").select("conv")
    parts = write_shared(parts.join(split, "conv").select(BLOCK, "conv"), "parts")
    # Two rows per block at most.
    rows = marked.join(F.broadcast(parts), [BLOCK, "conv"]).select(BLOCK, ROW, "conv", "initial", "fault")

    def sum_up(table):
        table, conv, kinds = _rows_in_order(table)
        return pa.table(
            {
                BLOCK: table.column(BLOCK).slice(0, 1),
                "conv": conv[:1],
                "matrix": pa.array([whole_matrix(kinds).reshape(-1).tolist()], pa.list_(pa.int64())),
            }
        )

    def costs_behind(parts):
        parts = parts.sort_values(BLOCK)
        after, found = LAST, []
        for matrix in reversed(parts["matrix"].tolist()):
            found.append(after.tolist())
            after = (np.array(matrix).reshape(4, 4) + after).min(1)
        last = [False] * (len(found) - 1) + [True]
        return pd.DataFrame({BLOCK: parts[BLOCK], "conv": parts["conv"], "after": found[::-1], "last": last})

    def ways_out(key, table, behind):
        if not behind.num_rows or not table.num_rows:
            return pa.table({BLOCK: pa.array([], pa.int32()), "conv": pa.array([], pa.int64()),
                             "after": pa.array([], pa.list_(pa.int64())), "last": pa.array([], pa.bool_()),
                             "leaves": pa.array([], pa.list_(pa.int64()))})
        _, _, kinds = _rows_in_order(table)
        known = behind.to_pylist()[0]
        ways = Ways(kinds, np.array([len(kinds)]), np.array([known["after"]]), np.array([known["last"]]))
        leaves = [int(ways.leaves(state)[0]) for state in range(4)]
        return pa.table({**{k: [v] for k, v in known.items()}, "leaves": [leaves]}).cast(
            pa.schema([(BLOCK, pa.int32()), ("conv", pa.int64()), ("after", pa.list_(pa.int64())),
                       ("last", pa.bool_()), ("leaves", pa.list_(pa.int64()))])
        )

    def entered(parts):
        parts = parts.sort_values(BLOCK)
        state, states = START, []
        for leaves in parts["leaves"]:
            states.append(state)
            state = int(leaves[state])
        return parts[[BLOCK, "conv", "after", "last"]].assign(state=states)

    schema = f"{BLOCK} int, conv long, after array<long>, last boolean"
    matrices = rows.groupBy(BLOCK, "conv").applyInArrow(sum_up, f"{BLOCK} int, conv long, matrix array<long>")
    behind = write_shared(matrices.groupBy("conv").applyInPandas(costs_behind, schema), "behind")
    left = rows.groupBy(BLOCK, "conv").cogroup(behind.groupBy(BLOCK, "conv"))
    left = left.applyInArrow(ways_out, schema + ", leaves array<long>")
    return left.groupBy("conv").applyInPandas(entered, schema + ", state int")


_EDITS = (
    f"conv long, {BLOCK} int, step long, letter string, new_role string, cost long,"
    " turn long, role string, digest string"
)


def find_edits(marked):
    """The edits of every conversation, one row each, ordered by ``(_block, step)``.

    ``turn, role, digest`` are those of the row that is edited, or of its neighbour for
    an insert; ``new_role`` is null for rows that are kept or deleted.
    """

    def run(key, table, known):
        table, conv, kinds = _rows_in_order(table)
        starts = np.flatnonzero(np.r_[True, conv[1:] != conv[:-1]]) if len(conv) else np.array([], int)
        sizes = np.diff(np.r_[starts, len(conv)])
        after = np.tile(LAST, (len(sizes), 1))
        last, states = np.ones(len(sizes), bool), np.zeros(len(sizes), int)
        for part in known.to_pylist():
            at = np.searchsorted(conv[starts], part["conv"])
            after[at], last[at], states[at] = part["after"], part["last"], part["state"]
        ways = Ways(kinds, sizes, after, last)
        part, step, node = ways.edits(states)
        place, state, letter = node // 4, node % 4, ways.letter[node]
        row = ways.row_of[place]
        # An insert behind the last row goes with that row.
        row = np.where(row < 0, starts[part] + sizes[part] - 1, row)
        cost = np.where(letter == INSERT, INSERT_COST, ARC_COST[kinds[row], letter, state])
        chosen = (letter == INSERT) | (letter == RETAG)
        role = np.where(chosen, CHOSEN_ROLE[state], None)
        rows = table.select(["turn", "role", "digest"]).take(pa.array(row))
        return pa.table(
            {
                "conv": pa.array(conv[starts][part], pa.int64()),
                BLOCK: pa.array(np.full(len(part), key[0].as_py()), pa.int32()),
                "step": pa.array(step, pa.int64()),
                "letter": pa.array(LETTERS[letter], pa.string()),
                "new_role": pa.array(role, pa.string()),
                "cost": pa.array(cost, pa.int64()),
                **{name: rows.column(name) for name in rows.column_names},
            }
        )

    per_block = marked.groupBy(BLOCK).cogroup(_solve_parts(marked).groupBy(BLOCK))
    return per_block.applyInArrow(run, _EDITS)


# --- Repaired conversations ---------------------------------------------------


def repaired_turns(rows):
    """The turns that remain: ``(conv_id, _block, step, letter, role, text)``, in that order."""
    edits = write_shared(find_edits(mark_faults(rows)), "edits").where("letter <> 'D'")
    texts = _turns(rows).withColumn("digest", F.sha2("text", 256))
    texts = texts.dropDuplicates(["conv", "turn", "role", "digest"]).select(
        "conv", F.col("turn").alias("t"), F.col("role").alias("r"), F.col("digest").alias("d"), "text"
    )
    same = F.col("turn").eqNullSafe(F.col("t")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    return (
        edits.alias("e")
        .join(texts.alias("x"), (F.col("e.conv") == F.col("x.conv")) & same)
        .select(
            F.col("e.conv").alias("conv_id"),
            BLOCK,
            "step",
            "letter",
            F.coalesce("new_role", "role").alias("role"),
            F.when(F.col("letter") == "I", F.lit("")).otherwise(F.col("text")).alias("text"),
        )
    )


_REPAIRED = "conv long, cost long, audit string, repaired_sha256 string"


def _hash_repaired(rows, edits):
    """Cost, audit and hash per conversation.

    Texts and edits meet by sorting: behind a text come the edits of the rows that hold
    it.  Only the audit grows in memory; the text passes by.
    """
    texts = _turns(rows).select(
        "conv", "turn", "role", F.sha2("text", 256).alias("digest"), "text",
        F.lit(-1).alias(BLOCK), F.lit(0).cast("long").alias("step"), F.lit(None).cast("string").alias("letter"),
        F.lit(None).cast("string").alias("new_role"), F.lit(0).cast("long").alias("cost"),
    )
    both = texts.unionByName(edits.withColumn("text", F.lit(None).cast("string")))
    order = ("conv", F.col("turn").asc_nulls_first(), "role", "digest", BLOCK, "step")
    dealt = both.repartition("conv").sortWithinPartitions(*order)

    def run(batches):
        current = None
        for batch in batches:
            done = []
            names = ("conv", "role", "text", "letter", "new_role", "cost")
            for conv, role, text, letter, new_role, cost in zip(*(batch.column(n).to_pylist() for n in names)):
                if current is None or current.conv != conv:
                    if current is not None:
                        done.append(current.row())
                    current = _Repaired(conv)
                if letter is None:
                    current.text = text
                else:
                    current.add(letter, new_role or role, cost)
            yield _repaired_batch(done)
        if current is not None:
            yield _repaired_batch([current.row()])

    dealt = dealt.select("conv", "role", "text", "letter", "new_role", "cost")
    return dealt.mapInArrow(run, _REPAIRED)


class _Repaired:
    def __init__(self, conv):
        self.conv, self.text, self.cost = conv, "", 0
        self.audit, self.digest, self.empty = bytearray(), hashlib.sha256(), True

    def add(self, letter, role, cost):
        self.audit += letter.encode()
        self.cost += cost
        if letter != "D":
            text = "" if letter == "I" else self.text
            self.digest.update(f"{'' if self.empty else chr(10)}{role}:{text}".encode())
            self.empty = False

    def row(self):
        return self.conv, self.cost, self.audit.decode(), self.digest.hexdigest()


def _repaired_batch(rows):
    columns = zip(*rows) if rows else ([],) * 4
    types = (pa.int64(), pa.int64(), pa.string(), pa.string())
    arrays = [pa.array(list(c), t) for c, t in zip(columns, types)]
    return pa.RecordBatch.from_arrays(arrays, names=["conv", "cost", "audit", "repaired_sha256"])


def repair_report(rows, conversations):
    """Faults, cost, audit and hash of the repaired rows, for every id of ``conversations``."""
    marked = mark_faults(rows)
    edits = write_shared(find_edits(marked), "edits")
    repaired = _hash_repaired(rows, edits)
    ids = conversations.where(F.col("conv_id").isNotNull())
    ids = ids.select(F.col("conv_id").cast("long").alias("conv")).distinct()
    found = ids.join(count_faults(marked), "conv", "left").join(repaired, "conv", "left")
    here = F.col("audit").isNotNull()
    numbers = ("blank", "duplicate", "truncated", "illegal", "cost")
    return found.select(
        F.col("conv").alias("conv_id"),
        F.when(here, F.col("gaps")).otherwise(F.lit(0)).cast("long").alias("gaps"),
        *[F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in numbers],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )


def repair_damaged(conversations):
    """The report on the conversations after the damage of the task."""
    return repair_report(damaged(conversations), conversations)


def oracle_sql():
    """The report by carrying the least audit and text of every state backwards in SQL."""
    from .sql_parts import crc32_sql

    blanks = r"\x20\x09-\x0D"
    chosen, role = "([3, 3, 4, 3])[q]", "(['user', 'user', 'assistant', 'user'])[q]"
    never = "{'cost': 1000000000::bigint, 'audit': '~', 'lines': ''}"
    none = "{'cost': 0::bigint, 'audit': '', 'lines': ''}"

    def edit(cost, letter, line, rest):
        return (
            f"{{'cost': {cost} + {rest}.cost, 'audit': '{letter}' || {rest}.audit,"
            f" 'lines': {line} || {rest}.lines}}"
        )

    def each_state(expression):
        return f"list_transform([1, 2, 3, 4], lambda q: {expression})"

    delete = edit(DELETE_COST, "D", "''", "b[q]")
    keep = edit("more", "K", "r || ':' || x || chr(10)", "b[kept[q]]")
    retag = edit(f"{RETAG_COST} + more", "R", f"{role} || ':' || x || chr(10)", f"b[{chosen}]")
    row = (
        f"list_sort([{delete}, case when gone or kept[q] = 0 then {never} else {keep} end,"
        f" case when gone then {never} else {retag} end])[1]"
    )
    insert = edit(INSERT_COST, "I", f"{role} || ':' || chr(10)", f"e[{chosen}]")
    least = f"list_sort([e[q], {insert}])[1]"
    ends = f"[{none}, {never}, {never}, {none}]"
    return f"""
    with recursive h as (
        select conv_id as c, turn as t, coalesce(role, ' ') as r, coalesce(text, ' ') as x,
               hex(encode(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')))
                   as digits
        from conversations where conv_id is not null),
    g as (select *, {crc32_sql("digits")} % {DAMAGES} as k from h),
    d as (
        select c, t, case when k = 4 then 'user' else r end as r,
               case k when 1 then '' when 2 then regexp_replace(x, '[.!?]', '', 'g') else x end as x
        from (select * from g where k <> 0 union all select * from g where k = 3) u),
    o as (select *, row_number() over (partition by c order by t nulls first, r, sha256(x)) as i
        from d),
    s as (
        select *, substr(r, 1, 1) as a, not regexp_matches(x, '[^{blanks}]') as blank,
               row_number() over (partition by c, r, x order by i) > 1 as again,
               not regexp_matches(x, '[.!?][{blanks}]*\\z') as cut,
               lag(substr(r, 1, 1)) over (partition by c order by i) as prior
        from o),
    f as (
        select c, t, i, r, x, blank, again and not blank as again, cut and not blank and not again as cut,
               prior || a not in ('su', 'ua', 'au') as illegal, blank or again as gone,
               case when cut then {TRUNCATED_COST} else 0 end as more,
               case a when 's' then [2, 0, 0, 0] when 'u' then [3, 3, 0, 3] when 'a' then [0, 0, 4, 0]
                   else [0, 0, 0, 0] end as kept
        from s),
    n as (
        select c, count(*) as rows, count(*) filter (where blank) as blank,
               count(*) filter (where again) as again, count(*) filter (where cut) as cut,
               count(*) filter (where illegal) as illegal,
               case when count(t) = 0 then 0 else max(t) - min(t) + 1 - count(distinct t) end as gaps
        from f group by c),
    w as (
        select c, rows + 1 as i, {each_state(least)} as b
        from (select c, rows, {each_state(least)} as e from (select c, rows, {ends} as e from n) z) y
        union all
        select c, i, {each_state(least)} as b
        from (select c, i, {each_state(least)} as e from (
            select w.c, f.i, {each_state(row)} as e from w join f on f.c = w.c and f.i = w.i - 1) v) u)
    select p.c as conv_id, cast(coalesce(gaps, 0) as bigint) as gaps,
           coalesce(blank, 0) as blank, coalesce(again, 0) as duplicate, coalesce(cut, 0) as truncated,
           coalesce(illegal, 0) as illegal, coalesce(b[1].cost, 0) as cost,
           coalesce(b[1].audit, '') as audit,
           sha256(coalesce(b[1].lines[:-2], '')) as repaired_sha256
    from (select distinct c from h) p left join n using (c) left join (select * from w where i = 1) z using (c)"""
