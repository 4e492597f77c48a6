"""Exact Jaccard join of word n-gram sets, as components of linked documents.

Sets are kept in one global order, rare n-grams first. Two sets that overlap enough share one
of their first n-grams (their prefixes), so only those are indexed:

1. A set is known by a digest; equal sets are one from here on, however many copies there are.
2. Counting all n-grams finds the frequent ones, which go last in the order.
3. Prefixes are dealt out by n-gram. An n-gram that stands in one prefix only is dropped; those
   that the very same sets share are one group.
4. In each group a prefix tree holds the shared prefixes. Going down it, overlaps are counted
   once for all sets that agree so far, and subtrees are left out when the tokens left cannot
   reach the overlap needed. What passes is a candidate; candidates form clusters.
5. Each set goes to its cluster once, whole, and a tree of whole sets finds the true links.

Groups and clusters of any size are cut into chunks. Each chunk also gets the group's hub, its
least set. Sets that a chunk links with the hub, over any number of links, are done with each
other; the others are sent to every chunk of the group. So no pair of sets is left out unless
links connect it already, and no task gets a whole group.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowtide.llm.catalog import query, table
from rowtide.llm.components import components
from rowtide.llm.prefix_tree import build, overlapping
from rowtide.llm.shingles import TOKEN_BITS, set_key, shingle_sets
from rowtide.llm.words import free_name, slices, wider, with_columns, without
from rowtide.session import written

SLICE = 2_000_000  # characters that a task handles at once
LOW_BITS = 32


@dataclass(frozen=True)
class Join:
    """``percent``: least similarity; ``width``: words of an n-gram. The other settings change
    no result: ``chunk`` sets of a group go to one task; of the n-grams that ``frequent`` or
    more documents hold, at most ``kept`` (the most frequent) are put last in the order."""

    percent: int = 85
    width: int = 4
    chunk: int = 128
    frequent: int = 32
    kept: int = 1 << 19

    def prefix(self, size):
        """N-grams to index: without them, too few are left to be similar to any set."""
        return size - -(-self.percent * size // 100) + 1

    def need(self, a: int, b: int) -> int:
        return -(-self.percent * (a + b) // (100 + self.percent))

    def need_in_prefixes(self, a: int, b: int) -> int:
        """Overlap of prefixes without which the rest of neither set makes up for it."""
        return self.need(a, b) - max(a - self.prefix(a), b - self.prefix(b))

    def fits(self, a: int, b: int) -> bool:
        return self.percent * max(a, b) <= 100 * min(a, b)


def _bucket_bits(df: DataFrame) -> int:
    """Buckets for dealing out n-grams: some for each task, as many as tasks ask for."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return min(20, max(8, ceil(log2(4 * tasks))))


def set_keys(df: DataFrame, join: Join = Join(), text: str = "text", added: tuple = ("n_shingles", "set_key"), drop: bool = True) -> DataFrame:
    """Adds ``n_shingles`` and ``set_key``, equal for equal sets; the text is left out unless
    ``drop`` is false. ``added`` are the names of the columns."""
    base = without(df, list(added))
    left_out = (text,) if drop else ()

    def run(batches):
        for batch in (part for b in batches for part in slices(b, text, SLICE)):
            sets = shingle_sets(batch.column(text).to_pylist(), join.width)
            values = [pa.array([len(s) for s in sets], pa.int64()), pa.array([set_key(s) for s in sets], pa.binary())]
            yield with_columns(batch, list(added), values, left_out)

    return base.mapInArrow(run, wider(base, "{} BIGINT, {} BINARY".format(*added), left_out))


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[list]]]:
    """Rows of a sorted stream that agree in the columns named ``by_...``, as lists of columns."""
    key, held = None, None
    for batch in batches:
        names = batch.schema.names
        n_by = sum(n.startswith("by_") for n in names)
        columns = [c.to_pylist() for c in batch.columns]
        start = 0
        keys = list(zip(*columns[:n_by]))
        for i in range(1, len(keys) + 1):
            if i == len(keys) or keys[i] != keys[start]:
                if keys[start] != key:
                    if held is not None:
                        yield key, held
                    key, held = keys[start], [[] for _ in names[n_by:]]
                for to, values in zip(held, columns[n_by:]):
                    to.extend(values[start:i])
                start = i
    if held is not None:
        yield key, held


def _dealt(df: DataFrame, *by: str) -> DataFrame:
    """Rows with the same ``by`` columns in one task, next to each other."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = df.select(*[F.col(c).alias(f"by_{c}") for c in by], *[c for c in df.columns if c not in by])
    keys = [f"by_{c}" for c in by]
    return named.repartition(tasks, *keys).sortWithinPartitions(*keys)


def frequent_tokens(docs: DataFrame, join: Join, bits: int, text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Leading bits of the frequent n-grams, ascending, and their classes (log2 of the count).

    All n-grams of all documents are counted: per batch first, then per bucket of leading
    bits. At most ``join.kept`` of them leave the count; that bound is what makes them small
    enough for every task.
    """
    shift = np.uint64(TOKEN_BITS - bits - LOW_BITS)
    mask = np.uint64((1 << LOW_BITS) - 1)

    def counted(batches):
        for batch in (part for b in batches for part in slices(b, text, SLICE)):
            sets = shingle_sets(batch.column(text).to_pylist(), join.width)
            tokens, counts = np.unique(np.concatenate(sets) >> shift, return_counts=True) if sets else ([], [])
            rows = []
            for many in (False, True):
                chosen = (counts > 1) == many
                part, number = tokens[chosen], counts[chosen].astype("<u4")
                low = (part & mask).astype("<u4")
                edges = np.searchsorted(part >> np.uint64(LOW_BITS), np.arange((1 << bits) + 1, dtype=np.uint64))
                for b in np.flatnonzero(np.diff(edges)):
                    span = slice(edges[b], edges[b + 1])
                    rows.append((int(b), low[span].tobytes(), number[span].tobytes() if many else b""))
            for i in range(0, len(rows), 4096):
                columns = list(zip(*rows[i : i + 4096]))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.binary())], ["bucket", "tokens", "counts"])

    def summed(batches):
        for (bucket,), (tokens, counts) in _by_bucket(batches):
            ones = np.frombuffer(b"".join(t for t, c in zip(tokens, counts) if not c), "<u4")
            many = np.frombuffer(b"".join(t for t, c in zip(tokens, counts) if c), "<u4")
            weights = np.frombuffer(b"".join(counts), "<u4")
            found, at = np.unique(np.concatenate([ones, many]), return_inverse=True)
            total = np.bincount(at, np.concatenate([np.ones(len(ones)), weights]), len(found))
            often = total >= join.frequent
            lead = (np.int64(bucket) << LOW_BITS) | found[often].astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(lead), pa.array(np.log2(total[often]).astype(np.int32))], ["lead", "class"])

    counts = _dealt(docs.select(text).mapInArrow(counted, "bucket INT, tokens BINARY, counts BINARY"), "bucket")
    frequent = written(counts.mapInArrow(summed, "lead BIGINT, class INT"), "frequent")
    classes = sorted(((r["class"], r["count"]) for r in frequent.groupBy("class").count().collect()), reverse=True)
    least, total = 64, 0
    for number, count in classes:
        if total + count > join.kept:
            break
        least, total = number, total + count
    rows = frequent.filter(F.col("class") >= least).toArrow()
    lead, kind = rows.column("lead").to_numpy(), rows.column("class").to_numpy()
    order = np.argsort(lead)
    return lead[order].astype(np.uint64), kind[order].astype(np.uint64)


def _ordered(tokens: np.ndarray, frequent: tuple[np.ndarray, np.ndarray], shift: np.uint64) -> np.ndarray:
    """Tokens in the global order: their class of frequency in the bits above them."""
    lead, kind = frequent
    if len(lead):
        at = np.minimum(np.searchsorted(lead, tokens >> shift), len(lead) - 1)
        tokens = tokens | np.where(lead[at] == tokens >> shift, kind[at], np.uint64(0)) << np.uint64(TOKEN_BITS)
    return np.sort(tokens)


def shared_prefixes(docs: DataFrame, join: Join, bits: int, frequent, text: str = "text") -> DataFrame:
    """Rows (group, token, key, size): n-grams that stand in the prefixes of several sets.

    The group is a digest of the sets that hold the token in their prefixes.
    """
    shift = np.uint64(TOKEN_BITS - bits - LOW_BITS)
    at_bucket = np.uint64(TOKEN_BITS - bits)
    low = np.uint64((1 << TOKEN_BITS) - 1)
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def prefixes(batches):
        for batch in (part for b in batches for part in slices(b, text, SLICE)):
            unique = {set_key(s): s for s in shingle_sets(batch.column(text).to_pylist(), join.width) if len(s)}
            if not unique:
                continue
            heads = [_ordered(s, shared.value, shift)[: join.prefix(len(s))] for s in unique.values()]
            owner = np.repeat(np.arange(len(heads)), [len(h) for h in heads])
            tokens = np.concatenate(heads)
            keys = np.frombuffer(b"".join(unique), "V16")
            sizes = np.array([len(s) for s in unique.values()], "<u4")
            bucket = (tokens & low) >> at_bucket
            order = np.argsort(bucket, kind="stable")
            tokens, owner = tokens[order], owner[order]
            edges = np.searchsorted(bucket[order], np.arange((1 << bits) + 1, dtype=np.uint64))
            full = np.flatnonzero(np.diff(edges))
            for i in range(0, len(full), 4096):
                spans = [(int(b), slice(edges[b], edges[b + 1])) for b in full[i : i + 4096]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b for b, _ in spans], pa.int32())]
                    + [pa.array([values[span].tobytes() for _, span in spans], pa.binary()) for values in (tokens, keys[owner], sizes[owner])],
                    ["bucket", "tokens", "keys", "sizes"],
                )

    def several(batches):
        for _, (tokens, keys, sizes) in _by_bucket(batches):
            token = np.frombuffer(b"".join(tokens), "<u8")
            key = np.frombuffer(b"".join(keys), ">u8").reshape(-1, 2)
            size = np.frombuffer(b"".join(sizes), "<u4")
            order = np.lexsort((key[:, 1], key[:, 0], token))
            token, key, size = token[order], key[order], size[order]
            new = np.ones(len(token), bool)
            new[1:] = (token[1:] != token[:-1]) | (key[1:] != key[:-1]).any(axis=1)
            token, key, size = token[new], key[new], size[new]
            starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            counts = np.diff(np.append(starts, len(token)))
            columns: list[list] = [[], [], [], []]
            raw = np.ascontiguousarray(key).astype(">u8").tobytes()
            for a, n in zip(starts[counts > 1].tolist(), counts[counts > 1].tolist()):
                members = [raw[16 * i : 16 * i + 16] for i in range(a, a + n)]
                digest = set_key(np.frombuffer(b"".join(members), np.uint8))
                for to, values in zip(columns, ([digest] * n, [int(token[a])] * n, members, size[a : a + n].tolist())):
                    to.extend(values)
                if len(columns[0]) > 50_000:
                    yield _group_rows(columns)
                    columns = [[], [], [], []]
            if columns[0]:
                yield _group_rows(columns)

    dealt = _dealt(docs.select(text).mapInArrow(prefixes, "bucket INT, tokens BINARY, keys BINARY, sizes BINARY"), "bucket")
    return dealt.mapInArrow(several, "group BINARY, token BIGINT, key BINARY, size BIGINT")


def _group_rows(columns: list[list]) -> pa.RecordBatch:
    kinds = [pa.binary(), pa.int64(), pa.binary(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["group", "token", "key", "size"])


def _falling(packed: bytes) -> tuple[int, ...]:
    """Tokens as ascending numbers with the most frequent first, as trees share most that way."""
    values = np.frombuffer(packed, "<u8")
    return tuple((~values)[::-1].tolist())


class _Sets:
    """Numbers 0..n-1 for sets, and which of them links connect."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def unite(self, i: int, j: int) -> None:
        self.up[self.root(i)] = self.root(j)


def spanning_links(rows: DataFrame, join: Join, need: Callable[[int, int], int], label: str) -> DataFrame:
    """Links (a, b) that connect, in every group, all sets whose overlap is as needed.

    ``rows`` hold group, key, size and tokens (packed, ascending). They are read several times
    and should be written. Two rounds: chunks with the group's hub, then the sets that their
    chunk did not connect with the hub against all chunks.
    """
    large = rows.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("hub")).filter(F.col("n") > join.chunk)
    large = written(large.select("group", "hub", F.ceil(F.col("n") / join.chunk).cast("int").alias("chunks")), f"{label}-large")
    known = rows.join(large, "group", "left")
    home = F.pmod(F.xxhash64("key"), F.coalesce("chunks", F.lit(1))).cast("int")
    every = F.sequence(F.lit(0), F.coalesce("chunks", F.lit(1)) - 1)
    payload = ["group", "chunk", "key", "size", "tokens"]
    first = known.withColumn("chunk", F.explode(F.when(F.col("key") == F.col("hub"), every).otherwise(F.array(home))))
    first = first.select(*payload, F.coalesce(F.col("key") == F.col("hub"), F.lit(False)).alias("hub"), F.col("hub").isNotNull().alias("cut"))

    def within(batches):
        for (group, _), (keys, sizes, tokens, hubs, cut) in _by_bucket(batches):
            lists = [_falling(t) for t in tokens]
            sets = _Sets(len(keys))
            links = []
            tree = build(sorted((lists[i], sizes[i], i) for i in range(len(keys))))
            for i in range(len(keys)):
                for j in overlapping(tree, lists[i], sizes[i], need, join.fits, lambda j, i=i: j < i and sets.root(j) != sets.root(i)):
                    links.append((group, keys[i], keys[j]))
                    sets.unite(i, j)
            if cut[0]:
                hub = sets.root(hubs.index(True))
                links += [(group, k, None) for i, k in enumerate(keys) if sets.root(i) != hub]
            yield _link_rows(links)

    found = written(_dealt(first, "group", "chunk").mapInArrow(within, "group BINARY, a BINARY, b BINARY"), f"{label}-first")
    links = found.filter("b IS NOT NULL").select("a", "b")
    apart = found.filter("b IS NULL").select("group", F.col("a").alias("key"), F.lit(True).alias("apart"))
    # All rows of groups that were cut: those apart go to every chunk, the others stay at home.
    again = rows.join(large, "group").join(apart, ["group", "key"], "left")
    again = again.withColumn("home", home).withColumn("chunk", F.explode(F.when(F.col("apart"), every).otherwise(F.array("home"))))
    again = again.select(*payload, F.coalesce("apart", F.lit(False)).alias("probe"), (F.col("home") == F.col("chunk")).alias("here"))

    def across(batches):
        for (group, _), (keys, sizes, tokens, probe, here) in _by_bucket(batches):
            lists = [_falling(t) for t in tokens]
            sets = _Sets(len(keys) + 1)
            core = len(keys)
            for i in range(len(keys)):
                if not probe[i]:
                    sets.unite(i, core)
            links = []
            tree = build(sorted((lists[i], sizes[i], i) for i in range(len(keys)) if here[i]))
            for i in range(len(keys)):
                if probe[i]:
                    # Two probes meet where each of them is at home: once is enough.
                    for j in overlapping(tree, lists[i], sizes[i], need, join.fits, lambda j, i=i: (not probe[j] or keys[j] < keys[i]) and sets.root(j) != sets.root(i)):
                        links.append((group, keys[i], keys[j]))
                        sets.unite(i, j)
            yield _link_rows(links)

    second = _dealt(again, "group", "chunk").mapInArrow(across, "group BINARY, a BINARY, b BINARY").select("a", "b")
    return links.union(second)


def _link_rows(links: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*links)) if links else [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in columns], ["group", "a", "b"])


def whole_sets(docs: DataFrame, wanted: DataFrame, join: Join, bits: int, frequent) -> DataFrame:
    """Whole sets (group, key, size, tokens) of the documents that ``wanted`` (doc_id, key,
    group) names; their texts are the only ones that are joined."""
    shift = np.uint64(TOKEN_BITS - bits - LOW_BITS)
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches):
        for batch in (part for b in batches for part in slices(b, "text", SLICE)):
            rows = []
            sets = shingle_sets(batch.column("text").to_pylist(), join.width)
            for group, key, tokens in zip(batch.column("group").to_pylist(), batch.column("key").to_pylist(), sets):
                if set_key(tokens) == key:  # not so if a doc_id has several texts
                    rows.append((group, key, len(tokens), _ordered(tokens, shared.value, shift).tobytes()))
            columns = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.binary(), pa.binary(), pa.int64(), pa.binary()))], ["group", "key", "size", "tokens"])

    found = docs.join(wanted, "doc_id").select("text", "group", "key")
    return found.mapInArrow(run, "group BINARY, key BINARY, size BIGINT, tokens BINARY").dropDuplicates(["group", "key"])


def pack_tokens(tokens: list[int]) -> bytes:
    return struct.pack(f"<{len(tokens)}Q", *sorted(t & 0xFFFFFFFFFFFFFFFF for t in tokens))


def _labelled(docs: DataFrame, join: Join) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, n_shingles, set_key) of all documents; and of each set that a doc_id has,
    its key, its least doc_id and the root of its component."""
    bits = _bucket_bits(docs)
    named = docs.filter("doc_id IS NOT NULL")
    keyed = written(set_keys(docs, join), "set-keys")
    sets = keyed.filter("doc_id IS NOT NULL AND n_shingles > 0").groupBy(F.col("set_key").alias("key")).agg(F.min("doc_id").alias("doc_id"))
    frequent = frequent_tokens(named, join, bits)
    live = written(shared_prefixes(named, join, bits, frequent), "shared-prefixes")

    def packed(batches):
        for batch in batches:
            tokens = [pack_tokens(t) for t in batch.column("tokens").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("size"), pa.array(tokens, pa.binary())], ["key", "size", "tokens"])

    prefixes = live.groupBy("key").agg(F.first("size").alias("size"), F.collect_set("token").alias("tokens"))
    prefixes = prefixes.mapInArrow(packed, "key BINARY, size BIGINT, tokens BINARY")
    members = written(live.select("group", "key").distinct().join(prefixes, "key").select("group", "key", "size", "tokens"), "prefix-groups")
    clusters = written(components(spanning_links(members, join, join.need_in_prefixes, "candidates")), "clusters")
    wanted = clusters.join(sets, clusters["node"] == sets["key"]).select("doc_id", "key", F.col("root").alias("group"))
    vectors = written(whole_sets(named, wanted, join, bits, frequent), "whole-sets")
    linked = written(components(spanning_links(vectors, join, join.need, "links")), "linked")
    labels = sets.join(linked, sets["key"] == linked["node"], "left").select("key", "doc_id", F.coalesce("root", "key").alias("root"))
    return keyed, written(labels, "labels")


def jaccard_components(df: DataFrame, join: Join = Join()) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` for a table with ``doc_id`` and ``text``.

    Two documents link if their sets' Jaccard similarity is at least ``join.percent`` per cent,
    exactly. Documents without words link with nothing. Equal sets link; rows that repeat a
    doc_id are kept, and the component is the least doc_id that any of their sets reaches.
    Rows without a doc_id are compared with nothing and have no component. Other columns are
    not used; an empty table gives no rows.
    """
    keyed, labels = _labelled(df.select("doc_id", "text"), join)
    least = labels.groupBy("root").agg(F.min("doc_id").alias("component"))
    named_sets = labels.join(least, "root").select(F.col("key").alias("set_key"), "component")
    joined = keyed.join(named_sets, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"))


def _least_rows(df: DataFrame, *by: str) -> DataFrame:
    """Of rows that agree in ``by`` the least, by text and then the other columns; columns that
    have no order (maps) do not count. Partly done before the shuffle."""
    rest = ["text", *[c for c in df.columns if c not in (*by, "text")]]
    ordered = [c for c in rest if not any(t in df.schema[c].dataType.simpleString() for t in ("map<", "variant"))]
    least = F.min(F.struct(*rest)) if ordered == rest else F.min_by(F.struct(*rest), F.struct(*ordered))
    row = free_name(df, "row")
    return df.groupBy(*by).agg(least.alias(row)).select(*by, f"{row}.*").select(*df.columns)


def _one_of_each_named(df: DataFrame, join: Join) -> DataFrame:
    keyed, labels = _labelled(df.select("doc_id", "text"), join)
    chosen = labels.groupBy("root").agg(F.min(F.struct("doc_id", F.col("key").alias("set_key"))).alias("c")).select("c.*")
    chosen = written(chosen.union(keyed.filter("n_shingles = 0").select("doc_id", "set_key").distinct()), "chosen")
    several = keyed.groupBy("doc_id").agg(F.min("set_key").alias("a"), F.max("set_key").alias("b")).filter("a <> b")
    several = written(several.select("doc_id"), "several-sets")
    # A doc_id tells which set is meant, unless it has several: only the sets of those are made again.
    single = df.join(several, "doc_id", "left_anti").join(chosen.select("doc_id"), "doc_id", "left_semi")
    size, key = free_name(df, "n_shingles"), free_name(df, "set_key")
    again = set_keys(df.join(several, "doc_id", "left_semi"), join, added=(size, key), drop=False)
    again = again.join(chosen.withColumnRenamed("set_key", key), ["doc_id", key], "left_semi")
    return _least_rows(single, "doc_id").select(*df.columns).unionByName(_least_rows(again, "doc_id", key).select(*df.columns))


def one_of_each(df: DataFrame, join: Join = Join()) -> DataFrame:
    """The rows of ``df`` without near copies: of every component of sets one row.

    That is the row with the least doc_id, then the least set key, text and other columns; rows
    without a doc_id come behind those that have one. A doc_id with different texts may stay
    several times, once for each component that it is the least of. Of rows without words one
    stays for each doc_id, and all that have no doc_id.
    """
    unnamed = df.filter("doc_id IS NULL")
    if unnamed.isEmpty():
        return _one_of_each_named(df, join)
    size, key, kind = free_name(df, "n_shingles"), free_name(df, "set_key"), df.schema["doc_id"].dataType
    keyed = written(set_keys(unnamed, join, added=(size, key), drop=False), "unnamed")
    # Of equal sets without a doc_id one row goes on, and its set's key stands for the doc_id.
    sets = written(_least_rows(keyed.filter(F.col(size) > 0), key), "unnamed-sets")

    def known_by(missing: bool, id: F.Column, key: F.Column) -> F.Column:
        return F.struct(F.lit(missing).alias("missing"), id.cast(kind).alias("id"), key.cast("binary").alias("key"))

    named = df.filter("doc_id IS NOT NULL").withColumn("doc_id", known_by(False, F.col("doc_id"), F.lit(None)))
    others = sets.withColumn("doc_id", known_by(True, F.lit(None), F.col(key))).drop(size, key)
    kept = _one_of_each_named(named.unionByName(others.select(*df.columns)), join)
    wordless = keyed.filter(F.col(size) == 0).select(*df.columns)
    return kept.withColumn("doc_id", F.col("doc_id.id")).select(*df.columns).unionByName(wordless)


@query()
def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents", "doc_id", "text"))
