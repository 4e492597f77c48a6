"""Repair of the structure of conversations by the cheapest edits, found by divide and conquer.

What is kept must read as ``(s?(ua)+)?`` by the initials of its roles. Before the first turn and
behind a system, a user or an assistant turn there is exactly one role that an insertion or a new
role can give, so the four states and the edits' initials (the audit) state a repair whole.

A row, a block of rows or a conversation is a *step*: what it costs to come from each state to
each other, and how the least audits to these ends are ordered (the audit to one end is never the
beginning of that to another, so what stands behind does not change their order). Steps chain up:
cost vectors of four states run forward through the first half of a conversation and backward
through its second half. Where they meet, the states of least total are optimal crossings, and the
one whose audit so far is least is on the path of the least audit. Both halves are solved again
in the same way, down to single rows. Only vectors are held, so space is linear in the rows.

On Spark a conversation is cut into blocks of rows. Blocks are chained up like rows, level by
level, so a conversation that holds a third of all rows is no task's alone: its crossings at the
edges of blocks are chosen on rows of 32 numbers a block, then each block is solved by itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowtide.llm.catalog import query, table
from rowtide.operators.ordered import Order, order_groups
from rowtide.session import written

BLOCK = 1_024  # rows that one worker solves at once, and blocks that are chained up at once
BLANKS = "\t\n\x0b\x0c\r "
INITIALS = "sua"
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}  # by insertion or a new role
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
GIVEN = {USER: "user", ASSISTANT: "assistant"}
INSERT, DELETE, REROLE, TRUNCATED = 2, 3, 2, 1
FAR = 1 << 50
# What follows the last row.
END = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}


@cache
def row_steps() -> tuple[np.ndarray, np.ndarray, list]:
    """Costs, order of audits and audits of one row, by its code and the states it goes between.

    A code is 3 times the place of the role's initial in ``INITIALS`` (3: another one), plus 0,
    1 for a truncated row, 2 for one that must go. Two insertions are enough to reach any state.
    """
    cost, audit = np.full((12, 4, 4), FAR, np.int64), np.full((12, 4, 4), "", object)
    for code, start, inserted in product(range(12), range(4), range(3)):
        state = start
        for _ in range(inserted):
            state = NEXT[state]
        initial, kind = (INITIALS + "-")[code // 3], code % 3
        edits = [("D", DELETE, state)]
        if kind < 2:
            edits.append(("R", REROLE + kind * TRUNCATED, NEXT[state]))
            if (state, initial) in KEPT:
                edits.append(("K", kind * TRUNCATED, KEPT[state, initial]))
        for letter, price, end in edits:
            found = (inserted * INSERT + price, "I" * inserted + letter)
            if found < (cost[code, start, end], audit[code, start, end]):
                cost[code, start, end], audit[code, start, end] = found
    order = np.array([[[sum(x < y for x in line) for y in line] for line in table] for table in audit], np.int64)
    return cost, order, audit.tolist()


def forward(cost: np.ndarray, order: np.ndarray, step_cost: np.ndarray, step_order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least costs of the four states one step on, and the order of their least audits."""
    through = cost[..., :, None] + step_cost
    least = through.min(-2)
    # Of equal costs, the state before with the least audit decides.
    tied = np.where(through == least[..., None, :], order[..., :, None] * 4 + step_order, FAR)
    by = tied.min(-2)
    return np.minimum(least, FAR), (by[..., :, None] > by[..., None, :]).sum(-1)


def backward(cost: np.ndarray, step_cost: np.ndarray) -> np.ndarray:
    return np.minimum((step_cost + cost[..., None, :]).min(-1), FAR)


def at_state(states: np.ndarray) -> np.ndarray:
    return np.where(np.arange(4) == states[:, None], 0, FAR)


class Steps:
    """Steps of many runs end to end: ``cost[kinds[i]]`` and ``order[kinds[i]]`` are those of step i."""

    def __init__(self, cost: np.ndarray, order: np.ndarray, kinds: np.ndarray):
        self.cost, self.order, self.kinds = cost, order, kinds

    def ahead(self, low: np.ndarray, high: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All runs forward at once, from ``low`` up to ``high``; the longest come first."""
        order = np.zeros(cost.shape, np.int64)
        lengths = high - low
        by = np.argsort(-lengths, kind="stable")
        cost, order, low, falling = cost[by], order[by], low[by], -lengths[by]
        for t in range(int(lengths.max(initial=0))):
            n = int(np.searchsorted(falling, -t, "left"))  # runs longer than t
            kind = self.kinds[low[:n] + t]
            step_cost, step_order = self.cost[kind], self.order[kind]
            if cost.ndim == 3:
                step_cost, step_order = step_cost[:, None], step_order[:, None]
            cost[:n], order[:n] = forward(cost[:n], order[:n], step_cost, step_order)
        back = np.empty_like(by)
        back[by] = np.arange(len(by))
        return cost[back], order[back]

    def behind(self, low: np.ndarray, high: np.ndarray, cost: np.ndarray) -> np.ndarray:
        lengths = high - low
        by = np.argsort(-lengths, kind="stable")
        cost, high, falling = cost[by], high[by], -lengths[by]
        for t in range(int(lengths.max(initial=0))):
            n = int(np.searchsorted(falling, -t, "left"))
            cost[:n] = backward(cost[:n], self.cost[self.kinds[high[:n] - 1 - t]])
        back = np.empty_like(by)
        back[by] = np.arange(len(by))
        return cost[back]

    def whole(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every run as one step."""
        return self.ahead(low, high, np.broadcast_to(np.where(np.eye(4, dtype=bool), 0, FAR), (len(low), 4, 4)).copy())

    def crossings(self, low: np.ndarray, high: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The state behind every step, on the path of the least audit of each run between its
        first and last state: forward and backward vectors meet in the middle, then both halves."""
        found = np.zeros(len(self.kinds), np.int64)
        some = high > low
        low, high, first, last = low[some], high[some], first[some], last[some]
        while len(low):
            found[high - 1] = last
            some = high - low > 1
            low, high, first, last = low[some], high[some], first[some], last[some]
            middle = (low + high) // 2
            cost, order = self.ahead(low, middle, at_state(first))
            total = cost + self.behind(middle, high, at_state(last))
            best = total == total.min(1, keepdims=True)
            cross = np.where(best, order, 4).argmin(1)
            low, high = np.concatenate([low, middle]), np.concatenate([middle, high])
            first, last = np.concatenate([first, cross]), np.concatenate([cross, last])
        return found


def last_states(cost: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The state that the rows of a conversation end in, and what it costs to the end of all."""
    total = cost + np.array([INSERT * len(END[s]) for s in range(4)])
    best = total == total.min(1, keepdims=True)
    return np.where(best, order, 4).argmin(1), total.min(1)


# ---- Spark: faults and blocks


def faults(df: DataFrame, block: int) -> DataFrame:
    """Rows in order, with what is wrong with them: ``conv_id``, ``block``, ``pos`` from 0, ``role``,
    ``text``, ``code`` (see ``row_steps``), ``fault`` (the first: 1 blank, 2 duplicate, 3 truncated),
    ``illegal`` (does not follow the row before), ``turn`` and ``fresh`` (first of its turn).

    ``df`` has ``conv_id``, ``turn``, ``role``, ``text`` and ``tie``, which orders equal turns.
    """
    ordered = order_groups(df, ["conv_id"], Order("turn", tiebreak="tie"))
    ordered = ordered.with_column("first", F.substring("role", 1, 1)).with_column("said", F.md5(F.concat(F.length("role"), F.lit(" "), "role", "text")))
    ordered = ordered.ranks().previous("first", "before").previous("turn", "turn_before")
    rows = ordered.result().withColumn("pos", F.col("row_number") - 1).drop("row_number", "rank", "dense_rank")
    # Where no conversation is large, neither is one role and text of it, and the rows of both
    # are in one partition already.
    if ordered.split:
        rows = written(rows, "turns")
        rows = order_groups(rows, ["conv_id", "said"], Order("pos")).ranks().result()
    else:
        rows = rows.withColumn("row_number", F.row_number().over(Window.partitionBy("conv_id", "said").orderBy("pos")))
    end = F.right(F.rtrim("text", F.lit(BLANKS)), F.lit(1))
    fault = F.when(end == "", 1).when(F.col("row_number") > 1, 2).when(~end.isin(".", "!", "?"), 3).otherwise(0)
    found = F.expr(f"instr('{INITIALS}', first)")
    place = F.when((F.col("first") != "") & (found > 0), found - 1).otherwise(len(INITIALS))
    fits = F.concat("before", "first").isin("su", "ua", "au")
    return rows.select(
        "conv_id", F.floor(F.col("pos") / block).alias("block"), "pos", "role", "text", "turn", fault.alias("fault"),
        (place * 3 + F.when(fault == 3, 1).when(fault > 0, 2).otherwise(0)).alias("code"),
        ((F.col("pos") > 0) & ~fits).alias("illegal"),
        (F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.when(F.col("pos") > 0, F.col("turn_before")))).alias("fresh"),
    )


COUNTS = ("blank", "duplicate", "truncated", "illegal")
BLOCKS = "conv_id BIGINT, block BIGINT, first INT, last INT, closing BOOLEAN, t ARRAY<STRUCT<pos: BIGINT, code: INT, role: STRING, text: STRING>>"
STEP = "conv_id BIGINT, k BIGINT, cost ARRAY<BIGINT>, audits ARRAY<BIGINT>"


def blocks_of(rows: DataFrame) -> DataFrame:
    """One row per block: its rows in order as ``t``, and its counts."""
    counts = [F.sum((F.col("fault") == k + 1).cast("bigint")).alias(name) for k, name in enumerate(COUNTS[:3])]
    turns = F.array_sort(F.collect_list(F.struct("pos", F.col("code").cast("int").alias("code"), "role", "text")))
    return rows.groupBy("conv_id", "block").agg(
        turns.alias("t"), *counts, F.sum(F.col("illegal").cast("bigint")).alias("illegal"),
        F.sum(F.col("fresh").cast("bigint")).alias("turns"), F.min("turn").alias("low"), F.max("turn").alias("high"),
    )


def same_conversation(a: str, b: str) -> Column:
    return F.col(f"{a}.conv_id").eqNullSafe(F.col(f"{b}.conv_id"))


# ---- Arrow: steps of blocks, crossings between them, and blocks that are solved


def step_rows(ids: pa.Array, ks: pa.Array, cost: np.ndarray, order: np.ndarray) -> list[pa.Array]:
    ends = pa.array(np.arange(len(cost) + 1) * 16, pa.int32())
    return [ids, ks, *[pa.ListArray.from_arrays(ends, pa.array(x.reshape(-1))) for x in (cost, order)]]


def steps_of(table: pa.Table) -> Steps:
    cost, order = (table[n].combine_chunks().flatten().to_numpy().reshape(-1, 4, 4) for n in ("cost", "audits"))
    return Steps(cost, order, np.arange(len(cost)))


def code_runs(column: pa.Array) -> tuple[Steps, np.ndarray]:
    """The rows of a batch of blocks as steps, and where the rows of each block begin and end."""
    cost, order, _ = row_steps()
    return Steps(cost, order, column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)), np.append(0, np.cumsum(np.diff(column.offsets.to_numpy())))


def block_steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        steps, edges = code_runs(batch.column("codes"))
        yield pa.RecordBatch.from_arrays(step_rows(batch.column("conv_id"), batch.column("k"), *steps.whole(edges[:-1], edges[1:])), names=["conv_id", "k", "cost", "audits"])


def chain(table: pa.Table, size: int) -> pa.Table:
    """The steps of one group, in order, as one."""
    table = table.sort_by("k")
    cost, order = steps_of(table).whole(np.array([0]), np.array([table.num_rows]))
    return pa.table(step_rows(table["conv_id"][:1].combine_chunks(), pa.array([table["k"][0].as_py() // size]), cost, order), names=["conv_id", "k", "cost", "audits"])


def cross(table: pa.Table, whole: pa.Table) -> pa.Table:
    """First and last state of every step of a group, from those of the group."""
    table = table.sort_by("k")
    first, last = (whole[n].to_numpy().astype(np.int64) for n in ("first", "last"))
    ends = steps_of(table).crossings(np.array([0]), np.array([table.num_rows]), first[:1], last[:1])
    return pa.table({
        "conv_id": table["conv_id"], "k": table["k"], "first": pa.array(np.append(first[:1], ends[:-1]), pa.int32()), "last": pa.array(ends, pa.int32()),
    })


def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Audit, cost and repaired text of each block; those of a block that is a whole conversation
    start at the beginning, take the cheapest end and come with the digest of their text."""
    audits = row_steps()[2]
    for batch in batches:
        turns = batch.column("t")
        flat = turns.flatten()
        steps, edges = code_runs(pa.ListArray.from_arrays(turns.offsets, flat.field("code")))
        kinds, roles, texts = steps.kinds.tolist(), flat.field("role").to_pylist(), flat.field("text").to_pylist()
        solo = batch.column("first").is_null().to_numpy(zero_copy_only=False)
        first = batch.column("first").fill_null(START).to_numpy().astype(np.int64)
        last = batch.column("last").fill_null(0).to_numpy().astype(np.int64)
        cost, order = steps.ahead(edges[:-1][solo], edges[1:][solo], at_state(first[solo]))
        price = np.zeros(len(first), np.int64)
        last[solo], price[solo] = last_states(cost, order)
        states = steps.crossings(edges[:-1], edges[1:], first, last).tolist()
        closing = solo | batch.column("closing").fill_null(False).to_numpy(zero_copy_only=False)
        audit, pieces, digests = [], [], []
        for b, (low, high) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())):
            state, letters, lines = int(first[b]), [], []
            for i in range(low, high):
                edits = audits[kinds[i]][state][states[i]]
                letters.append(edits)
                for edit in edits:
                    if edit == "D":
                        continue
                    state = KEPT[state, roles[i][0]] if edit == "K" else NEXT[state]
                    lines.append(f"{roles[i]}:{texts[i]}" if edit == "K" else f"{GIVEN[state]}:" + (texts[i] if edit == "R" else ""))
            if closing[b]:
                letters.append(END[state])
                for _ in END[state]:
                    state = NEXT[state]
                    lines.append(f"{GIVEN[state]}:")
            audit.append("".join(letters))
            text = "\n".join(lines).encode()
            digests.append(hashlib.sha256(text).hexdigest() if solo[b] else None)
            pieces.append(text if lines and not solo[b] else None)
        kept = [n for n in batch.schema.names if n not in ("t", "first", "last", "closing")]
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(n) for n in kept], pa.array(price, mask=~solo), pa.array(audit, pa.string()), pa.array(digests, pa.string()), pa.array(pieces, pa.binary())],
            names=[*kept, "cost", "audit", "repaired_sha256", "piece"],
        )


def joined_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Audit and digest of conversations whose blocks come in order."""
    empty = True
    conv, audit, digest, several = None, [], hashlib.sha256(), False

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([conv], pa.int64()), pa.array(["".join(audit)], pa.string()), pa.array([digest.hexdigest()], pa.string())],
            names=["conv_id", "audit", "repaired_sha256"],
        )

    for batch in batches:
        for c, letters, piece in zip(*[batch.column(n).to_pylist() for n in ("conv_id", "audit", "piece")]):
            if empty or c != conv:
                if not empty:
                    yield done()
                empty, conv, audit, digest, several = False, c, [], hashlib.sha256(), False
            audit.append(letters)
            if piece is not None:
                digest.update(b"\n" * several + piece)
                several = True
    if not empty:
        yield done()


# ---- Spark: the whole


def block_ends(stored: DataFrame, block: int) -> DataFrame | None:
    """``conv_id``, ``block``, ``first``, ``last``, ``closing`` and the ``price`` of the conversation,
    for blocks of conversations that have several. None if there are none."""
    several = stored.filter("block > 0")
    if several.isEmpty():
        return None
    several = written(several.groupBy("conv_id").agg(F.max("block").alias("final")), "long")
    cut = stored.alias("s").join(several.alias("m"), same_conversation("s", "m"), "left_semi")
    steps = cut.select("conv_id", F.col("block").alias("k"), F.col("t.code").alias("codes")).mapInArrow(block_steps, STEP)
    levels = [written(steps, "steps")]
    while not levels[-1].filter("k > 0").isEmpty():
        above = levels[-1].groupBy("conv_id", F.floor(F.col("k") / block).alias("up")).applyInArrow(lambda t: chain(t, block), STEP)
        levels.append(written(above, "steps"))

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            steps = steps_of(pa.table(batch))
            last, price = last_states(steps.cost[:, START], steps.order[:, START])
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("k"), pa.array(np.full(len(last), START), pa.int32()), pa.array(last, pa.int32()), pa.array(price)],
                names=["conv_id", "k", "first", "last", "price"],
            )

    states = written(levels[-1].mapInArrow(ends, "conv_id BIGINT, k BIGINT, first INT, last INT, price BIGINT"), "states")
    prices = states.select("conv_id", "price")
    for level in reversed(levels[:-1]):
        children = level.withColumn("up", F.floor(F.col("k") / block)).groupBy("conv_id", "up")
        parents = states.select("conv_id", F.col("k").alias("up"), "first", "last").groupBy("conv_id", "up")
        states = written(children.cogroup(parents).applyInArrow(cross, "conv_id BIGINT, k BIGINT, first INT, last INT"), "states")
    found = states.alias("s").join(several.alias("m"), same_conversation("s", "m")).join(prices.alias("p"), same_conversation("s", "p"))
    return found.select(F.col("s.conv_id").alias("conv_id"), F.col("k").alias("block"), "first", "last", (F.col("k") == F.col("final")).alias("closing"), "price")


def repair_conversations(df: DataFrame, block: int = BLOCK) -> DataFrame:
    """What is wrong with each conversation and its cheapest repair.

    ``df`` has ``conv_id``, ``turn``, ``role`` and ``text`` (neither null), and ``tie``, a number
    that orders rows of one turn. Returns ``conv_id``, ``gaps``, the counts of rows by first fault
    ``blank``, ``duplicate`` and ``truncated``, ``illegal``, ``cost``, ``audit`` and
    ``repaired_sha256``. A role whose first character is none of s, u and a, or that is empty,
    cannot be kept. Rows without a conv_id are one conversation. An empty table gives no rows.
    """
    stored = written(blocks_of(faults(df, block)), "conversation-blocks")
    counts = ["turns", "low", "high", *COUNTS]
    long = block_ends(stored, block)
    if long is None:
        blocks = stored.withColumns({"first": F.lit(None).cast("int"), "last": F.lit(None).cast("int"), "closing": F.lit(None).cast("boolean"), "price": F.lit(None).cast("bigint")})
    else:
        at = same_conversation("b", "e") & (F.col("b.block") == F.col("e.block"))
        blocks = stored.alias("b").join(written(long, "block-ends").alias("e"), at, "left").select("b.*", "first", "last", "closing", "price")
    kinds = ", ".join(f"{c} BIGINT" for c in counts)
    blocks = blocks.select("conv_id", "block", "price", *counts, "first", "last", "closing", "t")
    parts = blocks.mapInArrow(solved, f"conv_id BIGINT, block BIGINT, price BIGINT, {kinds}, cost BIGINT, audit STRING, repaired_sha256 STRING, piece BINARY")
    columns = ["conv_id", *counts, "cost", "audit", "repaired_sha256"]
    if long is None:
        whole = parts.select(*columns)
    else:
        parts = written(parts, "solved-blocks")
        cut = parts.filter("cost IS NULL")
        sums = cut.groupBy("conv_id").agg(*[{"low": F.min, "high": F.max}.get(c, F.sum)(c).alias(c) for c in counts], F.max("price").alias("cost"))
        texts = cut.select("conv_id", "block", "audit", "piece").repartition("conv_id").sortWithinPartitions("conv_id", "block")
        texts = texts.select("conv_id", "audit", "piece").mapInArrow(joined_blocks, "conv_id BIGINT, audit STRING, repaired_sha256 STRING")
        joined = sums.alias("a").join(texts.alias("t"), same_conversation("a", "t"))
        joined = joined.select("a.*", "t.audit", "t.repaired_sha256")
        whole = parts.filter("cost IS NOT NULL").select(*columns).unionByName(joined.select(*columns))
    span = F.col("high").cast("decimal(38,0)") - F.col("low") + 1 - F.col("turns")
    return whole.select("conv_id", F.coalesce(span.cast("bigint"), F.lit(0).cast("bigint")).alias("gaps"), *COUNTS, "cost", "audit", "repaired_sha256")


def damaged(df: DataFrame) -> DataFrame:
    """Rows with nulls as one space, damaged by ``crc32(conv_id:turn) % 20``: 0 drops a row, 1 empties
    its text, 2 takes its sentence ends away, 3 repeats it, 4 gives it the role user."""
    space = F.lit(" ")
    role, text = F.coalesce("role", space), F.coalesce("text", space)
    place = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    tie = F.conv(F.substring(F.md5(F.concat(F.length(role), space, role, text)), 1, 15), 16, 10).cast("bigint")
    rows = df.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(place.cast("binary")) % 20).alias("d"), tie.alias("tie")).filter("d <> 0")
    rows = rows.withColumn("text", F.when(F.col("d") == 1, "").when(F.col("d") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")))
    rows = rows.withColumn("role", F.when(F.col("d") == 4, "user").otherwise(F.col("role")))
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(F.col("d") == 3, 2).otherwise(1)))).drop("d", "copy")


def repaired_after_damage(df: DataFrame, block: int = BLOCK) -> DataFrame:
    """``repair_conversations`` of the damaged rows of all conversations; one without rows left has
    zeros, an empty audit and the digest of the empty text. Rows of one turn are ordered by a
    digest of what they were before the damage; repeated rows are rows of their own."""
    found = repair_conversations(damaged(df), block)
    ids = df.select("conv_id").distinct()
    joined = ids.alias("i").join(found.alias("f"), same_conversation("i", "f"), "left")
    zero = F.lit(0).cast("bigint")
    return joined.select(
        F.col("i.conv_id").alias("conv_id"), *[F.coalesce(c, zero).alias(c) for c in ("gaps", *COUNTS, "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )


# Plain dynamic programming over whole audits, row by row, for all conversations at once.
OP13_SQL = """
WITH RECURSIVE base AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS place FROM conversations),
hit AS (
  SELECT *, md5(length(role) || ' ' || role || text) AS tie, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
    list_transform(range(1, length(place) + 1), lambda k: ascii(substr(place, k, 1))::BIGINT)), lambda c, b: list_reduce(
    list_prepend(xor(c, b), range(8)), lambda z, u: xor(z >> 1, 3988292384 * (z & 1))))) % 20 AS d FROM base),
damaged AS (
  SELECT conv_id, turn, tie, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
    CASE d WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN d = 3 THEN 2 ELSE 1 END)) AS copy
  FROM hit WHERE d <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, tie) AS pos FROM damaged),
ended AS (
  SELECT *, rtrim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS seen,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) AS nth, lag(role) OVER (PARTITION BY conv_id ORDER BY pos) AS before
  FROM placed),
faulty AS (
  SELECT *, CASE WHEN seen = '' THEN 1 WHEN nth > 1 THEN 2 WHEN NOT contains('.!?', right(seen, 1)) THEN 3 ELSE 0 END AS fault FROM ended),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 1) AS blank,
    count(*) FILTER (WHERE fault = 2) AS duplicate, count(*) FILTER (WHERE fault = 3) AS truncated,
    count(*) FILTER (WHERE pos > 1 AND left(before, 1) || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal, max(pos) AS n
  FROM faulty GROUP BY conv_id),
inserted(state, cost, letters, lines, next) AS (VALUES
  ('', 0, '', [], ''), ('', 2, 'I', ['user:'], 'u'), ('', 4, 'II', ['user:', 'assistant:'], 'a'),
  ('s', 0, '', [], 's'), ('s', 2, 'I', ['user:'], 'u'), ('s', 4, 'II', ['user:', 'assistant:'], 'a'),
  ('u', 0, '', [], 'u'), ('u', 2, 'I', ['assistant:'], 'a'), ('u', 4, 'II', ['assistant:', 'user:'], 'u'),
  ('a', 0, '', [], 'a'), ('a', 2, 'I', ['user:'], 'u'), ('a', 4, 'II', ['user:', 'assistant:'], 'a')),
edit(letter, cost) AS (VALUES ('D', 3), ('K', 0), ('R', 2)),
best AS (
  SELECT conv_id, 0::BIGINT AS pos, '' AS state, {'cost': 0, 'audit': '', 'lines': []::VARCHAR[]} AS b FROM counts
  UNION ALL
  SELECT conv_id, pos, state, min(b) FROM (
    SELECT f.conv_id, f.pos, CASE e.letter WHEN 'D' THEN i.next WHEN 'K' THEN left(f.role, 1) ELSE CASE i.next WHEN 'u' THEN 'a' ELSE 'u' END END AS state,
      {'cost': r.b.cost + i.cost + e.cost + CASE WHEN f.fault = 3 AND e.letter <> 'D' THEN 1 ELSE 0 END, 'audit': r.b.audit || i.letters || e.letter,
       'lines': list_concat(list_concat(r.b.lines, i.lines), CASE e.letter WHEN 'D' THEN [] WHEN 'K' THEN [f.role || ':' || f.text]
         ELSE [CASE i.next WHEN 'u' THEN 'assistant:' ELSE 'user:' END || f.text] END)} AS b
    FROM best r JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM r.conv_id AND f.pos = r.pos + 1 JOIN inserted i ON i.state = r.state
      JOIN edit e ON e.letter = 'D' OR f.fault NOT IN (1, 2) AND (e.letter = 'R' OR i.next || left(f.role, 1) IN ('s', 'u', 'su', 'ua', 'au') AND f.role <> '')
  ) GROUP BY conv_id, pos, state),
whole AS (
  SELECT r.conv_id, min({'cost': r.b.cost + i.cost, 'audit': r.b.audit || i.letters, 'lines': list_concat(r.b.lines, i.lines)}) AS b
  FROM best r JOIN counts c ON c.conv_id IS NOT DISTINCT FROM r.conv_id AND c.n = r.pos JOIN inserted i ON i.state = r.state
  WHERE i.next = 'a' OR i.next = '' GROUP BY r.conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, CAST(coalesce(b.cost, 0) AS BIGINT) AS cost, coalesce(b.audit, '') AS audit,
  sha256(coalesce(array_to_string(b.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
  LEFT JOIN whole w ON w.conv_id IS NOT DISTINCT FROM o.conv_id
"""


@query(OP13_SQL)
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired_after_damage(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))
