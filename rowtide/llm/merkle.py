"""Merkle fingerprints of texts: a root to test equality, branches to locate edits and moves.

A text is cut into paragraphs at line ends, and those at sentence and word ends into leaves. A
paragraph whose hash says so closes a section, so that an edit moves the limits of the sections
next to it only. A paragraph's hash is made of the hashes of its leaves, a section's of its
paragraphs' and the root of its sections'.

A fingerprint is ``root:section|section...``, a section ``hash=paragraph;paragraph...``, a paragraph
``hash~leaf,leaf...`` and a leaf its hash and, in hexadecimal, its number of code points. Hashes of
inner nodes are written with 64 bits and those of leaves with 32; the root has 256 and is made of
hashes of 128 bits and more, so equal roots mean equal texts.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections import deque
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rowtide.llm.catalog import query, table
from rowtide.llm.words import free_name, slices, wider, with_columns, without

# A leaf: up to a line's or a sentence's end, or else the first word's end from 24 characters on.
LEAF = re.compile(r"[^\n]{1,40}?[.!?](?:\n|(?=\s|$))|[^\n]{24}[^\s]{0,40}\s?|[^\n]+\n?|\n")
LEAF_DIGITS, NODE_DIGITS = 8, 16
# One paragraph in so many closes its section.
SECTION_PARAGRAPHS = 8
SLICE = 500_000  # characters that a task handles at once


def fingerprint(text: str) -> str:
    root = hashlib.sha256()
    sections, paragraphs, leaves = [], [], []
    section, paragraph = hashlib.blake2b(digest_size=16), hashlib.blake2b(digest_size=16)
    parts = LEAF.findall(text)
    for i, part in enumerate(parts, 1):
        digest = hashlib.blake2b(part.encode(), digest_size=16).digest()
        paragraph.update(digest)
        leaves.append(f"{digest.hex()[:LEAF_DIGITS]}{len(part):x}")
        if part[-1] != "\n" and i < len(parts):
            continue
        digest = paragraph.digest()
        section.update(digest)
        paragraphs.append(f"{digest.hex()[:NODE_DIGITS]}~{','.join(leaves)}")
        leaves, paragraph = [], hashlib.blake2b(digest_size=16)
        if digest[-1] % SECTION_PARAGRAPHS == 0 or i == len(parts):
            digest = section.digest()
            root.update(digest)
            sections.append(f"{digest.hex()[:NODE_DIGITS]}={';'.join(paragraphs)}")
            paragraphs, section = [], hashlib.blake2b(digest_size=16)
    return f"{root.hexdigest()}:{'|'.join(sections)}"


class Tree:
    """The nodes of a fingerprint, level by level: hashes, first code points and first children."""

    def __init__(self, print_: str):
        self.root, _, rest = print_.partition(":")
        self.hashes, self.first, self.starts = ([], [], []), ([], []), ([], [], [])
        at = 0
        for section in rest.split("|") if rest else ():
            self.first[0].append(len(self.hashes[1]))
            self.hashes[0].append(section[:NODE_DIGITS])
            self.starts[0].append(at)
            for paragraph in section[NODE_DIGITS + 1 :].split(";"):
                self.first[1].append(len(self.hashes[2]))
                self.hashes[1].append(paragraph[:NODE_DIGITS])
                self.starts[1].append(at)
                for leaf in paragraph[NODE_DIGITS + 1 :].split(","):
                    self.hashes[2].append(leaf)
                    self.starts[2].append(at)
                    at += int(leaf[LEAF_DIGITS:], 16)
        self.size = at
        for level in range(2):
            self.first[level].append(len(self.hashes[level + 1]))
        for starts in self.starts:
            starts.append(at)

    def children(self, level: int, nodes: list[int]) -> list[int]:
        first = self.first[level]
        return [c for n in nodes for c in range(first[n], first[n + 1])]


def matched(mine: Tree, theirs: Tree) -> list[tuple[int, int, int]]:
    """What two trees share, as (start in mine, start in theirs, length), by start in mine.

    Sections with equal hashes match whole, in order; below those that differ paragraphs do, and
    below those leaves. Nodes that repeat match as often as both trees have them.
    """
    found = []
    here, there = list(range(len(mine.hashes[0]))), list(range(len(theirs.hashes[0])))
    for level in range(3):
        places: dict[str, deque[int]] = {}
        for n in there:
            places.setdefault(theirs.hashes[level][n], deque()).append(n)
        left, taken = [], set()
        starts, others = mine.starts[level], theirs.starts[level]
        for n in here:
            spot = places.get(mine.hashes[level][n])
            if spot:
                m = spot.popleft()
                taken.add(m)
                found.append((starts[n], others[m], starts[n + 1] - starts[n]))
            else:
                left.append(n)
        if level < 2:
            here, there = mine.children(level, left), theirs.children(level, [m for m in there if m not in taken])
    return sorted(found)


def in_place(pairs: list[tuple[int, int, int]]) -> list[bool]:
    """Which matches keep the order of both texts: the chain of the most code points."""
    ends = [p[1] for p in pairs]
    if all(a < b for a, b in zip(ends, ends[1:])):
        return [True] * len(pairs)
    order = {e: i + 1 for i, e in enumerate(sorted(ends))}
    tree = [(0, -1)] * (len(pairs) + 1)  # the heaviest chain that ends at or before a place
    before, heaviest = [-1] * len(pairs), (0, -1)
    for i, (_, end, length) in enumerate(pairs):
        weight, at = (0, -1), order[end] - 1
        while at:
            weight = max(weight, tree[at])
            at &= at - 1
        before[i] = weight[1]
        own, at = (weight[0] + length, i), order[end]
        heaviest = max(heaviest, own)
        while at < len(tree):
            tree[at] = max(tree[at], own)
            at += at & -at
    kept, i = [False] * len(pairs), heaviest[1]
    while i >= 0:
        kept[i], i = True, before[i]
    return kept


def likeness(one: str, other: str) -> float:
    """Share of code points, of both texts together, that the trees have in common; what stands in
    another place of the order counts half. It is 1 if the roots are equal, and only then."""
    if one.partition(":")[0] == other.partition(":")[0]:
        return 1.0
    mine, theirs = Tree(one), Tree(other)
    total = mine.size + theirs.size
    pairs = matched(mine, theirs)
    common = sum(length if kept else length / 2 for (_, _, length), kept in zip(pairs, in_place(pairs)))
    # Trees that share all leaves in order and differ in their roots differ in paragraphs.
    return min(2 * common, total - 1) / total


def moves(one: str, other: str) -> list[tuple[int, int, int]]:
    """Code-point ranges (start, end) of the first text that the second one has in another place of
    the order, and where."""
    pairs = matched(Tree(one), Tree(other))
    return [(a, a + n, b) for (a, b, n), kept in zip(pairs, in_place(pairs)) if not kept]


def edits(one: str, other: str) -> list[tuple[int, int]]:
    """Code-point ranges of the first text that the second one lacks, or has in another place."""
    mine = Tree(one)
    pairs = matched(mine, Tree(other))
    found, at = [], 0
    for (a, _, n), kept in [*zip(pairs, in_place(pairs)), ((mine.size, 0, 0), True)]:
        if kept:
            if a > at:
                found.append((at, a))
            at = a + n
    return found


def merkle_fingerprints(df: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """Adds the fingerprint of each whole text. No shuffle; one row in, one row out.

    Null counts as empty; the empty text has a root and no sections. A column of the added
    name is replaced; equal texts, repeated rows among them, have equal fingerprints.
    """
    base = without(df, [name])

    def run(batches):
        for batch in (part for b in batches for part in slices(b, text, SLICE)):
            prints = [fingerprint(t or "") for t in batch.column(text).to_pylist()]
            yield with_columns(batch, [name], [pa.array(prints, pa.string())])

    return base.mapInArrow(run, wider(base, f"`{name}` STRING"))


def in_descending_runs(df: DataFrame, key: str, text: str) -> tuple[DataFrame, str, str]:
    """Rows sorted in runs of descending keys; each run ends with a copy of the next row.

    One shuffle of the texts. Runs are cut by key and, within a key, by a hash of the text, so
    that rows without a key or with a frequent one are spread too; equal texts of one key stay
    together. The row that opens a run is sent to the run before it as well, marked as a guest,
    and the very first row to the last run. Returns the rows and the names of the columns for the
    run and for guests.
    """
    spark = df.sparkSession
    run, guest, mark, hosts = (free_name(df, n) for n in ("run", "guest", "mark", "hosts"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    whole = F.col(key).cast("bigint")
    keyed = df.withColumn(mark, F.xxhash64(text))
    # Keys and hashes alone are sorted first, for the row that opens each run.
    light = keyed.select(whole.isNull().alias("missing"), F.coalesce(whole, F.lit(0).cast("bigint")).alias("key"), F.col(mark).alias("mark"))
    ranged = light.repartitionByRange(tasks, "missing", F.desc("key"), F.desc("mark")).withColumn("run", F.spark_partition_id())
    order = F.struct(F.col("missing"), -F.col("key").cast("decimal(20,0)"), -F.col("mark").cast("decimal(20,0)"))
    first = ranged.groupBy("run").agg(F.min_by(F.struct("missing", "key", "mark"), order).alias("first"))
    opens = sorted((r["first"]["missing"], -r["first"]["key"], -r["first"]["mark"]) for r in first.collect())  # one per run

    @F.pandas_udf("int")
    def run_of(missing: pd.Series, keys: pd.Series, marks: pd.Series) -> pd.Series:
        at = [bisect_right(opens, (m, -k, -h)) - 1 for m, k, h in zip(missing.tolist(), keys.tolist(), marks.tolist())]
        return pd.Series(at, dtype="int32")

    number = run_of(whole.isNull(), F.coalesce(whole, F.lit(0).cast("bigint")), F.col(mark))
    keyed = keyed.withColumn(run, number)
    shape = StructType.fromDDL(f"{run} INT, {hosts} INT, first STRUCT<key: BIGINT, mark: BIGINT>")
    rows = [(i, (i - 1) % len(opens), (None if m else -k, -h)) for i, (m, k, h) in enumerate(opens)]
    opening = F.col("o.first.key").eqNullSafe(F.col(f"d.{key}").cast("bigint")) & (F.col("o.first.mark") == F.col(f"d.{mark}"))
    own = F.struct(F.col(f"d.{run}").alias(run), F.lit(False).alias(guest))
    there = F.struct(F.col(f"o.{hosts}").alias(run), F.lit(True).alias(guest))
    joined = keyed.alias("d").join(F.broadcast(spark.createDataFrame(rows, shape)).alias("o"), F.col(f"d.{run}") == F.col(f"o.{run}"))
    sent = joined.select(*[F.col(f"d.`{c}`") for c in df.columns], F.col(f"d.{mark}"), F.explode(F.when(opening, F.array(own, there)).otherwise(F.array(own))).alias(hosts))
    sent = sent.select(*df.columns, mark, f"{hosts}.{run}", f"{hosts}.{guest}")
    ordered = sent.repartition(tasks, run).sortWithinPartitions(run, guest, F.desc_nulls_last(key), F.desc(mark))
    return ordered.drop(mark), run, guest


def edited(text: str, following: str) -> str:
    """The text, its last third replaced by as much of the next text as there is."""
    size = len(text) // 3
    return text[: len(text) - size] + following[:size]


def compare_with_next(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text, of its edited text and how alike they and the next one are.

    The next row is the one with the next lower key (rows that share a key are ordered by a
    hash of their texts, rows without a key come last); after the last row comes the first.
    Adds ``fingerprint``, ``edited``, ``edited_fingerprint``, ``near_edited`` and
    ``near_next`` in place of columns of those names. Null texts count as empty, repeated rows
    stay, one single row is its own next row, an empty table gives no rows.
    """
    names = ["fingerprint", "edited", "edited_fingerprint", "near_edited", "near_next"]
    base = without(df, names)
    ordered, run, guest = in_descending_runs(base, key, text)

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_print = None, ""
        for batch in (part for b in batches for part in slices(b, text, SLICE)):
            rows = batch if held is None else pa.concat_batches([held, batch])
            texts = [t or "" for t in rows.column(text).to_pylist()]
            runs, guests = rows.column(run).to_pylist(), rows.column(guest).to_pylist()
            out: list[tuple] = []
            kept = []
            mine = held_print if held is not None else fingerprint(texts[0])
            for i in range(len(texts) - 1):
                theirs = fingerprint(texts[i + 1])
                if not guests[i]:
                    new = edited(texts[i], texts[i + 1] if runs[i] == runs[i + 1] else "")
                    changed = fingerprint(new)
                    kept.append(i)
                    out.append((mine, new, changed, likeness(mine, changed), likeness(mine, theirs)))
                mine = theirs
            held, held_print = rows.slice(len(texts) - 1), mine
            if kept:
                columns = [pa.array(c, t) for c, t in zip(zip(*out), [pa.string()] * 3 + [pa.float64()] * 2)]
                yield with_columns(rows.take(pa.array(kept)), names, columns, (run, guest))

    schema = wider(base, "fingerprint STRING, edited STRING, edited_fingerprint STRING, near_edited DOUBLE, near_next DOUBLE")
    return ordered.mapInArrow(compared, schema)


@query()
def op8_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return compare_with_next(docs).select(
        "doc_id",
        F.length(F.coalesce("text", F.lit(""))).cast("bigint").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        "fingerprint", "edited_fingerprint", "near_edited", "near_next",
    )
