"""Best-fit packing of token sequences of any number into as few sequences as it can.

Documents are range-sorted by length, so that equal lengths form runs of positions, and gaps
of open sequences form runs of sequences. Packing goes in synchronous rounds: a length
that waits finds its successor gap (the smallest that holds it), the longest first; the
documents that ask for the same gap are ranked by position, as many win as it holds, the gaps
shrink and the losers ask for the next larger one. A round needs run lengths only, at most
``capacity`` of each kind whatever the number of documents, so rounds are computed on those
summaries. The placement of the documents themselves is a sweep over their sorted partitions:
each task looks up its positions among the runs' boundaries.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowtide.llm.catalog import query, table
from rowtide.llm.words import KEPT_WORDS, SLICE, Pieces, free_name, offsets, released, slices, wider, with_columns, without
from rowtide.session import written

CAPACITY = 4096
PARTITION_ROWS_BITS = 33  # of monotonically_increasing_id


# Words of these characters alone are parted here as the tokenizer parts them: printable ASCII and
# letters that one code point stands for, of which each has one lower-case letter.
PLAIN = re.compile(r"[!-~À-ÖØ-öø-įĲ-ſ]*\Z")
PART = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ſ]+|[0-9]|[^a-z0-9ß-öø-ſ]+")
CODED = 2_000  # parts that are coded as one text


class WordIds:
    """Ids of a tokenizer that lower-cases, parts words at white space, between letters, digits and
    other characters and at English endings, and codes each part by itself.

    Two memories: of words as they are written, and of their parts, which many words share
    (``Word``, ``word,`` and ``word.``). A word of unusual characters, or with what may be the name
    of a special token, is coded whole; a token belongs to the word that its characters are in.
    """

    def __init__(self, path: str, kept: int = KEPT_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole, self.parts_only = Tokenizer.from_file(path), Tokenizer.from_file(path)
        # Parts are normalised and parted already.
        self.parts_only.normalizer = None
        blank, to_bytes = pre_tokenizers.CharDelimiterSplit(" "), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.parts_only.pre_tokenizer = pre_tokenizers.Sequence([blank, to_bytes])
        self.words, self.parts = Pieces(self._words, kept), Pieces(self._parts, kept)

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each text, and all texts' ids end to end; null counts as empty."""
        lists = pa.compute.ascii_split_whitespace(texts.fill_null(""))
        coded = lists.flatten().dictionary_encode()
        index = coded.indices.to_numpy()
        at = self.words.places(coded.dictionary.to_pylist(), np.bincount(index, minlength=len(coded.dictionary)))
        counts, ids = self.words.lists(at[index])
        return np.diff(offsets(counts)[lists.offsets.to_numpy() - lists.offsets[0].as_py()]), ids

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        plain = np.fromiter((PLAIN.match(w) is not None and "<|" not in w for w in words), bool, len(words))
        parted = [PART.findall(w.lower()) if p else () for w, p in zip(words, plain.tolist())]
        sizes = np.fromiter(map(len, parted), np.int64, len(words))
        part_counts, part_ids = self.parts.lists(self.parts.places(list(chain.from_iterable(parted))))
        counts = np.diff(offsets(part_counts)[offsets(sizes)])
        if plain.all():
            return counts, part_ids
        other = [w for w, p in zip(words, plain.tolist()) if not p]
        coded = self.whole.encode(" ".join(other), add_special_tokens=False)
        starts = np.fromiter((a for a, _ in coded.offsets), np.int64, len(coded.ids))
        limits = np.cumsum(np.fromiter(map(len, other), np.int64, len(other)) + 1)
        counts[~plain] = np.bincount(np.searchsorted(limits, starts, "right"), minlength=len(other))
        ids = np.empty(int(counts.sum()), np.int64)
        of_plain = np.repeat(plain, counts)
        ids[of_plain], ids[~of_plain] = part_ids, coded.ids
        return counts, ids

    def _parts(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        counts, ids = [], []
        for start in range(0, len(parts), CODED):
            some = parts[start : start + CODED]
            coded = self.parts_only.encode(" ".join(some), add_special_tokens=False)
            counts.append(np.bincount(np.array(coded.word_ids, np.int64), minlength=len(some)))
            ids.append(np.array(coded.ids, np.int64))
        return np.concatenate(counts), np.concatenate(ids)


@cache
def word_ids(path: str, kept: int = KEPT_WORDS) -> WordIds:
    """One memory for all tasks of a worker."""
    return WordIds(path, kept)


def token_pieces(
    df: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, text: str = "text", kept: int = KEPT_WORDS, characters: int = SLICE
) -> DataFrame:
    """One row per piece of a text: ``piece``, ``start``, ``length`` and ``ids`` (binary,
    little-endian unsigned 32-bit), with the other columns repeated and the text left out.

    Ids of the whole text and an end id; only what is longer than ``capacity`` is cut, into
    full pieces and a last one. Null and empty texts give one piece that holds the end id. The
    tokenizer must drop white space and never join what it parts. Columns of the added names
    are replaced; repeated rows stay apart; an empty table gives no rows. ``kept`` words that a
    worker remembers and ``characters`` that it handles at once bound its memory and change no result.
    """
    base = without(df, ["piece", "start", "length", "ids"])

    def run(batches):
        memory = word_ids(tokenizer, kept)
        for batch in (part for b in released(batches) for part in slices(b, text, characters)):
            counts, ids = memory.of(batch.column(text))
            ids = np.insert(ids, np.cumsum(counts), end_id).astype("<u4")
            counts = counts + 1
            pieces = -(-counts // capacity)
            rows = np.repeat(np.arange(len(counts)), pieces)
            number = np.arange(len(rows)) - np.repeat(offsets(pieces)[:-1], pieces)
            starts = number * capacity
            lengths = np.minimum(counts[rows] - starts, capacity)
            begin = offsets(counts)[rows] + starts
            data = ids.tobytes()
            yield with_columns(
                batch.take(pa.array(rows)), ["piece", "start", "length", "ids"],
                [pa.array(number.astype(np.int32)), pa.array(starts), pa.array(lengths),
                 pa.array([data[4 * a : 4 * (a + n)] for a, n in zip(begin.tolist(), lengths.tolist())], pa.binary())],
                (text,),
            )

    return base.mapInArrow(run, wider(base, "piece INT, start BIGINT, length BIGINT, ids BINARY", (text,)))


def fill_rounds(counts: np.ndarray, capacity: int) -> list[tuple[int, int, int, int]]:
    """Runs (position, number of documents, first sequence, offset) that place all documents.

    ``counts[n]`` documents have length n; positions number them from the longest to the
    shortest. A round takes the longest documents left and their successor gap. By rank, each
    sequence of that gap gets as many of them as it holds, one behind the other; documents
    that are left go on to the next larger gap, and open new sequences if there is none.
    """
    runs: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by gap
    waiting = np.zeros(capacity + 1, bool)  # gaps that have runs
    opened = position = 0
    placed = []

    def shrink(gap: int, first: int, number: int) -> None:
        if gap:
            runs[gap].append((first, number))
            waiting[gap] = True

    for length in range(capacity, 0, -1):
        left = int(counts[length])
        while left:
            ahead = np.flatnonzero(waiting[length:])
            if len(ahead):
                gap = length + int(ahead[0])
                first, number = runs[gap].pop()
                waiting[gap] = bool(runs[gap])
            else:
                gap, first, number = capacity, opened, -(-left // (capacity // length))
                opened += number
            each = gap // length
            full = min(number, left // each)
            for k in range(each if full else 0):
                placed.append((position, full, first, capacity - gap + k * length))
                position += full
            left -= full * each
            shrink(gap - each * length, first, full) if full else None
            if full < number and left:
                last = min(left, each)
                for k in range(last):
                    placed.append((position, 1, first + full, capacity - gap + k * length))
                    position += 1
                left -= last
                shrink(gap - last * length, first + full, 1)
                full += 1
            if full < number:
                shrink(gap, first + full, number - full)
    return placed


def positions(df: DataFrame, order: list, label: str) -> tuple[DataFrame, str]:
    """The rows sorted over all partitions and written, with a gapless position from 0."""
    spot = free_name(df, "position")
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    ranged = df.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    stored = written(ranged.withColumn(spot, F.monotonically_increasing_id()), label)
    # One row per partition: what stands before it.
    part = F.shiftright(spot, PARTITION_ROWS_BITS)
    sizes = stored.groupBy(part.alias("p")).count().collect()
    before, total = {}, 0
    for row in sorted(sizes):
        before[row["p"]] = total
        total += row["count"]
    starts = F.create_map(*[F.lit(x) for pair in before.items() for x in pair]) if before else None
    within = F.col(spot).bitwiseAND((1 << PARTITION_ROWS_BITS) - 1)
    return (stored if starts is None else stored.withColumn(spot, F.element_at(starts, part) + within)), spot


def pack(df: DataFrame, length: str = "length", capacity: int = CAPACITY, tiebreak: tuple = ()) -> DataFrame:
    """Adds ``sequence_id`` and ``offset``: where each row goes, in sequences of ``capacity``.

    Sequences are filled from 0 without gaps. Equal lengths are ordered by ``tiebreak``, so
    that a length which very many rows share is spread over partitions. A row with a null
    length or one below 1 takes no place: its two columns are null. A length above the
    capacity is refused. Columns of the added names are replaced; repeated rows are placed
    apart; an empty table gives no rows.
    """
    spark = df.sparkSession
    base = without(df, ["sequence_id", "offset"])
    order = [F.desc_nulls_last(length), *tiebreak]
    stored, spot = positions(base, order, "packing")
    held = stored.filter(F.col(length) >= 1).groupBy(length).count().collect()
    if any(row[0] > capacity for row in held):
        raise ValueError(f"lengths must not exceed {capacity}")
    counts = np.zeros(capacity + 1, np.int64)
    for row in held:
        counts[row[0]] = row[1]
    runs = np.array(fill_rounds(counts, capacity), np.int64).reshape(-1, 4)
    shared = spark.sparkContext.broadcast(runs)

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, _, firsts, depths = shared.value.T
        total = int(counts.sum())
        for batch in batches:
            place = batch.column(spot).to_numpy(zero_copy_only=False)
            inside = place < total
            run = np.maximum(np.searchsorted(starts, place, "right") - 1, 0)
            if not len(starts):
                sequence = depth = np.zeros(len(place), np.int64)
            else:
                sequence, depth = firsts[run] + place - starts[run], depths[run]
            yield with_columns(batch, ["sequence_id", "offset"], [pa.array(sequence, mask=~inside), pa.array(depth, mask=~inside)], (spot,))

    return stored.select(*base.columns, spot).mapInArrow(sweep, wider(base, "sequence_id BIGINT, offset BIGINT"))


@query()
def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    pieces = token_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    # Written, as a range sort reads its input twice.
    pieces = written(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), "pieces")
    return pack(pieces, tiebreak=("doc_id", "piece", "ids_crc32"))
