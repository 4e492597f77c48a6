"""The prefix trie of conversations, with aggregates of every node.

Every turn gets an id, a digest of role and text. Conversations become rows of ids, at most
``WIDTH`` turns in a row; a longer conversation goes on in further rows, each of which names the
turns before it by a digest of its own. Rows are range-sharded in lexicographic order, so
the members of a node stand one behind the other. A shard is one padded matrix of turn ids:

- ``lexsort`` orders it; where a column differs from the row above, a node of that depth starts,
  and so does one of every greater depth: the masks of changes are OR-accumulated over the columns;
- ``reduceat`` over the starts aggregates the nodes of one depth at once.

A node that goes over the edge of a shard lies on the path of its first or last row. Only those
nodes, twice the width a shard at most, are recombined by Spark.

Sums over subtrees take no walk up the tree: each node belongs to its smallest member. A member
brings what it owns from this depth on, so a node's sum is that of its members' suffix sums.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowtide.llm.catalog import query, table
from rowtide.operators.ordered import Order, order_groups
from rowtide.session import written

WIDTH = 32
SHARD_ROWS = 50_000
LANES, LANE = 4, 2**32  # a prefix of a long conversation: sums of so many hashes, modulo

ROW = "conv_id BIGINT, chunk BIGINT, prefix STRING, digests ARRAY<BINARY>, chars ARRAY<BIGINT>, last BOOLEAN, shard INT"
CARRY = {"after_leaves": "bigint", "after_saved": "bigint", "next_own": "boolean", "parent": "bigint"}
OUTER = "shard INT, key STRING, conv_id BIGINT, n BIGINT, ends BIGINT"
NODE = "conv_id BIGINT, depth BIGINT, parent_conv_id BIGINT, n_convs BIGINT, n_children BIGINT, n_leaves BIGINT, saved_tokens BIGINT"
PARTIAL = f"{NODE}, ends_sha256 STRING, key STRING, ends STRING, first_end BIGINT"


# ---- Spark: turns, rebuilt conversations, rows


def numbered_turns(df: DataFrame) -> DataFrame:
    """``conv_id``, ``i`` from 1 in order of turn, ``digest`` of role and text, and ``n_chars``."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    base = df.filter("conv_id IS NOT NULL").select(
        "conv_id", "turn", F.md5(F.concat(F.length(role), F.lit(" "), role, text)).alias("digest"), F.length(text).cast("bigint").alias("n_chars")
    )
    base = base.withColumn("tie", F.conv(F.substring("digest", 1, 15), 16, 10).cast("bigint"))
    ranked = order_groups(base, ["conv_id"], Order("turn", tiebreak="tie")).ranks().result()
    return ranked.select("conv_id", F.col("row_number").alias("i"), F.unhex("digest").alias("digest"), "n_chars")


def rebuilt_turns(turns: DataFrame, family: Column, shared: Column, most: int) -> DataFrame:
    """Each conversation with the first ``shared`` turns (``most`` at most) of conversation
    ``family``, then its own turns behind as many: ``conv_id``, ``pos`` from 1, ``digest``,
    ``n_chars`` and ``total``, the number of its turns. A row of position 0 stands for itself."""
    whole = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own"))
    whole = whole.select("conv_id", "own", family.alias("family"), shared.alias("h"))
    heads = turns.filter(F.col("i") <= most).join(whole.select(F.col("family").alias("conv_id")).distinct(), "conv_id", "left_semi")
    heads = heads.groupBy(F.col("conv_id").alias("family")).agg(F.array_sort(F.collect_list(F.struct("i", "digest", "n_chars"))).alias("head"))
    head = F.filter(F.coalesce("head", F.array().cast("array<struct<i:bigint,digest:binary,n_chars:bigint>>")), lambda t: t["i"] <= F.col("h"))
    whole = whole.join(heads, "family", "left").withColumn("head", head).withColumn("kept", F.size("head"))
    whole = whole.withColumn("total", F.col("kept") + F.greatest(F.col("own") - F.col("h"), F.lit(0)))
    whole = written(whole.select("conv_id", "h", "head", "kept", "total"), "conversations")
    none = F.struct(F.lit(0).cast("bigint").alias("i"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("bigint").alias("n_chars"))
    first = whole.select("conv_id", "total", F.explode(F.concat(F.array(none), "head")).alias("t"))
    first = first.select("conv_id", F.col("t.i").alias("pos"), "t.digest", "t.n_chars", "total")
    behind = turns.join(whole.select("conv_id", "h", "kept", "total"), "conv_id").filter("i > h")
    return first.unionByName(behind.select("conv_id", (F.col("kept") + F.col("i") - F.col("h")).alias("pos"), "digest", "n_chars", "total"))


def matrix_rows(turns: DataFrame, width: int) -> tuple[DataFrame, bool]:
    """Rows of at most ``width`` turns, with the digest of the turns before, and whether any
    conversation has several rows."""
    chunk = F.floor(F.greatest(F.col("pos") - 1, F.lit(0)) / width)
    long = F.col("total") > width
    mixed = F.md5(F.concat(F.hex("digest"), F.lit(":"), F.col("pos").cast("string")))
    lanes = [F.sum(F.when(long, F.conv(F.substring(mixed, 8 * k + 1, 8), 16, 10).cast("bigint"))) % LANE for k in range(LANES)]
    turn = F.when(F.col("pos") > 0, F.struct("pos", "digest", "n_chars"))
    rows = turns.groupBy("conv_id", chunk.alias("chunk")).agg(
        F.array_sort(F.collect_list(turn)).alias("t"), F.max("total").alias("total"), *[x.alias(f"lane{k}") for k, x in enumerate(lanes)]
    )
    rows = rows.select(
        "conv_id", "chunk", "total", F.col("t.digest").alias("digests"), F.col("t.n_chars").alias("chars"),
        (F.col("chunk") == F.floor(F.greatest(F.col("total") - 1, F.lit(0)) / width)).alias("last"), *[f"lane{k}" for k in range(LANES)],
    )
    rows = written(rows, "rows")
    kept = ["conv_id", "chunk", "prefix", "digests", "chars", "last"]
    several = not rows.filter(long).isEmpty()
    if not several:
        return rows.withColumn("prefix", F.lit("")).select(*kept), False
    before = order_groups(rows.filter(long).select("conv_id", "chunk", *[F.coalesce(f"lane{k}", F.lit(0).cast("bigint")).alias(f"lane{k}") for k in range(LANES)]), ["conv_id"], Order("chunk"))
    for k in range(LANES):
        before = before.running_sum(f"lane{k}", f"sum{k}")
    parts = [F.lpad(F.hex(F.pmod(F.col(f"sum{k}") - F.col(f"lane{k}"), F.lit(LANE))), 8, "0") for k in range(LANES)]
    prefix = F.when(F.col("chunk") > 0, F.concat(*parts)).otherwise("").alias("known")
    prefixes = before.result().select("conv_id", "chunk", prefix)
    return rows.join(prefixes, ["conv_id", "chunk"], "left").withColumn("prefix", F.coalesce("known", F.lit(""))).select(*kept), True


# ---- numpy: one shard


class Shard:
    """The rows of a shard in lexicographic order, and its nodes depth by depth."""

    def __init__(self, rows: pa.Table, width: int):
        self.width, size = width, rows.num_rows
        sizes = np.diff(lists(rows["digests"]).offsets.to_numpy())
        flat = lists(rows["digests"]).flatten()
        data = np.frombuffer(b"".join(flat.to_pylist()), "S16")
        codes = np.unique(data, return_inverse=True)[1]
        ids = np.full((size, width), -1, np.int64)
        chars = np.zeros((size, width + 1), np.int64)
        inside = np.arange(width) < sizes[:, None]
        ids[inside] = codes
        chars[:, 1:][inside] = lists(rows["chars"]).flatten().to_numpy()
        conv, chunk = rows["conv_id"].to_numpy(), rows["chunk"].to_numpy()
        prefix = np.unique(np.array(rows["prefix"].to_pylist(), str), return_inverse=True)[1]
        last = rows["last"].to_numpy(zero_copy_only=False)
        self.order = np.lexsort((conv, ~last, *ids.T[::-1], prefix, chunk))
        ids, self.chars, self.sizes = ids[self.order], chars[self.order], sizes[self.order]
        self.conv, self.chunk = conv[self.order], chunk[self.order]
        self.last = last[self.order]
        self.rows = rows.take(pa.array(self.order))
        changed = np.ones((size, width + 1), bool)
        changed[1:, 0] = (np.diff(self.chunk) != 0) | (np.diff(prefix[self.order]) != 0)
        changed[1:, 1:] = ids[1:] != ids[:-1]
        changed = np.logical_or.accumulate(changed, axis=1)
        self.starts = [np.flatnonzero(changed[:, d]) for d in range(width + 1)]
        self.node = [np.cumsum(changed[:, d]) - 1 for d in range(width + 1)]
        self.depths = range(int(self.sizes.max()) + 1)
        self.owner, self.n, self.ends = {}, {}, {}
        for d in self.depths:
            self.owner[d] = np.minimum.reduceat(self.conv, self.starts[d])
            self.n[d] = np.diff(np.append(self.starts[d], size))
            self.ends[d] = np.add.reduceat(((self.sizes == d) & self.last).astype(np.int64), self.starts[d])

    def is_node(self, row: int | np.ndarray, d: int):
        """Whether a row goes through a node of this depth; the top of a later row is none of its own."""
        return (self.sizes[row] >= d) & ((self.chunk[row] == 0) | (d > 0))

    def edges(self) -> dict[str, tuple[int, int]]:
        """By key, the depth and number of the nodes that may go on in another shard."""
        found = {}
        for row in (0, len(self.conv) - 1):
            one = self.rows.slice(row, 1).to_pylist()[0]
            digest = hashlib.md5(f"{one['chunk']} {one['prefix']} ".encode())
            for d in range(int(self.sizes[row]) + 1):
                if d:
                    digest.update(one["digests"][d - 1])
                if self.is_node(row, d):
                    found[f"{d} {digest.hexdigest()}"] = d, int(self.node[d][row])
        return found

    def correct(self, outer: pa.Table) -> None:
        """Takes the members and ends of nodes at the edges from all shards together."""
        edges = self.edges()
        for r in outer.to_pylist():
            d, node = edges[r["key"]]
            self.owner[d][node], self.n[d][node], self.ends[d][node] = r["conv_id"], r["n"], r["ends"]

    def owned(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By row and depth: whether the row owns the node, and the leaf and the tokens it brings."""
        own = np.zeros((len(self.conv), self.width + 2), bool)
        leaves, saved = (np.zeros((len(self.conv), self.width + 1), np.int64) for _ in range(2))
        for d in self.depths:
            node = self.node[d]
            own[:, d] = self.is_node(slice(None), d) & (self.owner[d][node] == self.conv)
            leaves[:, d] = own[:, d] & (self.n[d] == self.ends[d])[node]
            saved[:, d] = own[:, d] * (self.n[d][node] - 1) * self.chars[:, d]
        return own, leaves, saved


def lists(column: pa.ChunkedArray) -> pa.ListArray:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def edge_nodes(rows: pa.Table, width: int) -> pa.Table:
    shard = Shard(rows, width)
    found = [(key, int(shard.owner[d][k]), int(shard.n[d][k]), int(shard.ends[d][k])) for key, (d, k) in shard.edges().items()]
    number = rows["shard"][0].as_py()
    return pa.table({
        "shard": pa.array([number] * len(found), pa.int32()), "key": pa.array([f[0] for f in found], pa.string()),
        **{name: pa.array([f[k] for f in found], pa.int64()) for k, name in ((1, "conv_id"), (2, "n"), (3, "ends"))},
    })


def row_totals(rows: pa.Table, outer: pa.Table, width: int) -> pa.Table:
    """What rows of long conversations hand to the rows before and behind them."""
    if not rows.num_rows:
        return pa.table({n: pa.array([], t) for n, t in (("conv_id", pa.int64()), ("chunk", pa.int64()), ("leaves", pa.int64()), ("saved", pa.int64()), ("first_own", pa.bool_()), ("last_owner", pa.int64()))})
    shard = Shard(rows, width)
    shard.correct(outer)
    own, leaves, saved = shard.owned()
    owner = np.stack([shard.owner[d][shard.node[d]] for d in shard.depths], 1)
    long = (shard.chunk > 0) | ~shard.last
    last_owner = owner[np.arange(len(owner)), shard.sizes]
    return pa.table({
        "conv_id": pa.array(shard.conv[long]), "chunk": pa.array(shard.chunk[long]), "leaves": pa.array(leaves.sum(1)[long]),
        "saved": pa.array(saved.sum(1)[long]), "first_own": pa.array(own[long, 1]), "last_owner": pa.array(last_owner[long]),
    })


EMPTY_DIGEST = hashlib.sha256().hexdigest()


def shard_nodes(rows: pa.Table, outer: pa.Table, width: int) -> pa.Table:
    """The nodes of a shard; those at its edges with a key, their own sums and their ends."""
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "key", "ends", "first_end"]
    texts = {"ends_sha256", "key", "ends"}
    parts = {n: [] for n in names}
    if rows.num_rows:
        shard = Shard(rows, width)
        shard.correct(outer)
        carried = {n: shard.rows[n].to_numpy(zero_copy_only=False) for n in ("after_leaves", "after_saved", "next_own")}
        above = shard.rows["parent"].fill_null(0).to_numpy()
        own, leaves, saved = shard.owned()
        leaves = np.cumsum(leaves[:, ::-1], 1)[:, ::-1] + carried["after_leaves"][:, None]
        saved = np.cumsum(saved[:, ::-1], 1)[:, ::-1] + carried["after_saved"][:, None]
        own[:, width + 1] = carried["next_own"].astype(bool)
        keys = {place: key for key, place in shard.edges().items()}
        names_of = [str(c) for c in shard.conv.tolist()]
        for d in shard.depths:
            starts = shard.starts[d]
            real = np.flatnonzero(shard.is_node(starts, d))
            first = starts[real]
            children, below, kept = (np.add.reduceat(x[:, c].astype(np.int64), starts)[real] for x, c in ((own, d + 1), (leaves, d), (saved, d)))
            if d:
                parent = shard.owner[d - 1][shard.node[d - 1][first]]
                parent = pa.array(np.where((d == 1) & (shard.chunk[first] > 0), above[first], parent))
            else:
                parent = pa.nulls(len(real), pa.int64())
            # Ends are the first rows of a node, in order of conv_id.
            here = np.add.reduceat(((shard.sizes == d) & shard.last).astype(np.int64), starts)[real]
            joined = [",".join(names_of[a : a + n]) for a, n in zip(first.tolist(), here.tolist())]
            key = [keys.get((d, int(k))) for k in real]
            parts["conv_id"].append(pa.array(shard.owner[d][real]))
            parts["depth"].append(pa.array(shard.chunk[first] * width + d))
            parts["parent_conv_id"].append(parent)
            parts["n_convs"].append(pa.array(shard.n[d][real]))
            parts["n_children"].append(pa.array(children))
            parts["n_leaves"].append(pa.array(below))
            parts["saved_tokens"].append(pa.array(kept))
            parts["ends_sha256"].append(pa.array([None if k else hashlib.sha256(j.encode()).hexdigest() if j else EMPTY_DIGEST for j, k in zip(joined, key)], pa.string()))
            parts["key"].append(pa.array(key, pa.string()))
            parts["ends"].append(pa.array([j if k and j else None for j, k in zip(joined, key)], pa.string()))
            parts["first_end"].append(pa.array(shard.conv[first]))
    return pa.table({n: pa.chunked_array(parts[n], pa.string() if n in texts else pa.int64()) for n in names})


def digests_in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the pieces of every key, joined by commas; they come sorted by key and place."""
    key, digest = None, None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key], pa.string()), pa.array([digest.hexdigest()], pa.string())], names=["key", "sha"])

    for batch in batches:
        for k, piece in zip(batch.column("key").to_pylist(), batch.column("ends").to_pylist()):
            if k != key:
                if digest is not None:
                    yield done()
                key, digest = k, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(piece.encode())
    if digest is not None:
        yield done()


# ---- Spark: shards, edges and nodes


def prefix_trie(turns: DataFrame, width: int = WIDTH, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per node of the trie of all conversations, the root included.

    ``turns`` has ``conv_id``, ``pos`` from 1 without gaps, ``digest``, ``n_chars`` and ``total``;
    a row of position 0 for each conversation, which is how one without turns is known.
    """
    spark = turns.sparkSession
    rows, several = matrix_rows(turns, width)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = max(tasks, -(-rows.count() // shard_rows))
    ranged = rows.repartitionByRange(shards, "chunk", "prefix", "digests", F.desc("last"), "conv_id")
    stored = written(ranged.withColumn("shard", F.spark_partition_id()), "shards")

    edges = written(stored.groupBy("shard").applyInArrow(lambda t: edge_nodes(t, width), OUTER), "edges")
    whole = edges.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.sum("n").alias("n"), F.sum("ends").alias("ends"))
    outer = written(edges.select("shard", "key").join(whole, "key"), "outer")

    def meet(left: DataFrame, work, kinds: str) -> DataFrame:
        return left.groupBy("shard").cogroup(outer.groupBy("shard")).applyInArrow(lambda a, b: work(a, b, width), kinds)

    nothing = {"after_leaves": F.lit(0), "after_saved": F.lit(0), "next_own": F.lit(False), "parent": F.lit(None)}
    carried = {n: nothing[n].cast(kind) for n, kind in CARRY.items()}
    if several:
        totals = meet(stored, row_totals, "conv_id BIGINT, chunk BIGINT, leaves BIGINT, saved BIGINT, first_own BOOLEAN, last_owner BIGINT")
        totals = order_groups(written(totals, "totals"), ["conv_id"], Order("chunk", descending=True))
        totals = totals.running_sum("leaves", "leaves_on").running_sum("saved", "saved_on").previous("first_own", "next_own").following("last_owner", "parent")
        handed = totals.result().select(
            "conv_id", "chunk", (F.col("leaves_on") - F.col("leaves")).alias("_after_leaves"), (F.col("saved_on") - F.col("saved")).alias("_after_saved"),
            F.col("next_own").alias("_next_own"), F.col("parent").alias("_parent"),
        )
        stored = stored.join(handed, ["conv_id", "chunk"], "left")
        carried = {n: F.coalesce(f"_{n}", x) for n, x in carried.items()}
    parts = written(meet(stored.withColumns(carried), shard_nodes, PARTIAL), "nodes")

    at_edges = parts.filter("key IS NOT NULL")
    pieces = at_edges.filter("ends IS NOT NULL").select("key", "ends", "first_end")
    pieces = pieces.repartition("key").sortWithinPartitions("key", "first_end")
    digests = pieces.mapInArrow(digests_in_order, "key STRING, sha STRING")
    same, added = ("conv_id", "depth", "parent_conv_id", "n_convs"), ("n_children", "n_leaves", "saved_tokens")
    joined = at_edges.groupBy("key").agg(*[F.max(c).alias(c) for c in same], *[F.sum(c).alias(c) for c in added])
    joined = joined.join(digests, "key", "left").withColumn("ends_sha256", F.coalesce("sha", F.lit(EMPTY_DIGEST)))
    columns = [*same, *added, "ends_sha256"]
    return parts.filter("key IS NULL").select(*columns).unionByName(joined.select(*columns))


def conversation_trie(df: DataFrame, family: Column, shared: Column, most: int, width: int = WIDTH, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The trie of conversations that begin as their family does: the first ``shared`` turns of
    conversation ``family`` (both stated over conv_id; ``most`` bounds the former), then their own.

    Returns ``conv_id`` (the smallest member), ``depth``, ``parent_conv_id``, ``n_convs``,
    ``n_children``, ``n_leaves``, ``saved_tokens`` and ``ends_sha256`` of each node. Turns are
    ordered by turn, nulls first, equal ones by their digest; a null role or text is
    empty; repeated rows are turns of their own. Rows without a conv_id belong to no
    conversation. Other columns are not used. An empty table gives no rows.
    """
    turns = written(numbered_turns(df), "turns")
    return prefix_trie(rebuilt_turns(turns, family, shared, most), width, shard_rows)


OP12_SQL = """
WITH turns AS (
  SELECT conv_id, {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS t, turn FROM conversations WHERE conv_id IS NOT NULL),
lists AS (
  SELECT conv_id, list(t ORDER BY turn NULLS FIRST, md5(length(t.role) || ' ' || t.role || t.text)) AS l,
    list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(conv_id::VARCHAR) + 1),
      lambda k: ascii(substr(conv_id::VARCHAR, k, 1))::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)),
      lambda z, u: xor(z >> 1, 3988292384 * (z & 1)))) AS crc
  FROM turns GROUP BY conv_id),
rebuilt AS (
  SELECT c.conv_id, list_concat(coalesce(list_filter(b.l, lambda x, i: i <= xor(c.crc, 4294967295) % 6), []),
    list_filter(c.l, lambda x, i: i > xor(c.crc, 4294967295) % 6)) AS s
  FROM lists c LEFT JOIN lists b ON b.conv_id = c.conv_id - c.conv_id % 100),
members AS (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS d FROM rebuilt),
nodes AS (
  SELECT list_filter(s, lambda x, i: i <= d) AS p, d, min(conv_id) AS conv_id, count(*) AS n,
    coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE len(s) = d), '') AS ends,
    bool_and(len(s) = d) AS leaf
  FROM members GROUP BY ALL),
paths AS (
  SELECT list_filter(p, lambda x, i: i <= k) AS p, count(*) FILTER (WHERE k = d - 1) AS children,
    count(*) FILTER (WHERE leaf) AS leaves, sum(CASE WHEN d > 0 THEN (n - 1) * length(p[d].text) ELSE 0 END) AS saved
  FROM (SELECT *, unnest(range(0, d + 1)) AS k FROM nodes) GROUP BY ALL)
SELECT v.conv_id, CAST(v.d AS BIGINT) AS depth, u.conv_id AS parent_conv_id, v.n AS n_convs, children AS n_children,
  leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(v.ends) AS ends_sha256
FROM nodes v JOIN paths w ON w.p = v.p LEFT JOIN nodes u ON v.d > 0 AND u.d = v.d - 1 AND u.p = list_filter(v.p, lambda x, i: i < v.d)
"""


@query(OP12_SQL)
def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    shared = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6
    return conversation_trie(df, F.col("conv_id") - F.col("conv_id") % 100, shared, 5)
