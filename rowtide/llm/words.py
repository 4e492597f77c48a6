"""Arrow batches of texts, and results kept per distinct word while a worker lives.

Texts repeat words far more often than they bring new ones. A per-worker memory from word
to result, bounded in entries, leaves one look-up per word for most of a text.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

WORD = re.compile(r"[^\x20\x09-\x0D]+")
# Entries that one worker keeps; at about 200 bytes each.
KEPT_WORDS = 400_000
# Characters that a task handles at once.
SLICE = 4_000_000
# Both for stages of a chain: workers live on, and what one stage keeps stands beside the next one's.
CHAINED_WORDS, CHAINED_SLICE = 100_000, 1_000_000


class Numbered(dict):
    """Words and their numbers; a word that is looked up for the first time gets the next one."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


class Pieces:
    """A list of numbers for every word, all lists end to end in one array.

    ``make`` gets the words that are not known yet and returns how many numbers each of them
    has, and the numbers. Words are bytes, as blanks of ASCII are what bytes are split at. When
    more than ``kept`` words are known, those seen least often are forgotten.
    """

    def __init__(self, make: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], kept: int = KEPT_WORDS):
        self.make, self.kept = make, kept
        self._keep([], np.zeros(0, np.int64), np.zeros(0, np.int64))

    def _keep(self, words: list[bytes], counts: np.ndarray, flat: np.ndarray) -> None:
        self.index = Numbered(zip(words, range(len(words))))
        self.counts, self.flat, self.seen = counts, flat, np.zeros(len(words), np.int64)

    def _forget(self) -> None:
        least = 2
        while ((often := self.seen >= least).sum()) * 2 > self.kept:
            least *= 2
        chosen = self.flat[np.repeat(often, self.counts)]
        self._keep([w for w, keep in zip(self.index, often.tolist()) if keep], self.counts[often], chosen)

    def places(self, keys: list[str], times: np.ndarray | None = None) -> np.ndarray:
        """Where the lists of these keys are in ``counts``; each key may stand for ``times`` uses."""
        if len(self.index) > self.kept:
            self._forget()
        known = len(self.index)
        at = np.fromiter(map(self.index.__getitem__, keys), np.int64, len(keys))
        if len(self.index) > known:
            self._learn(*self.make(list(islice(self.index, known, None))))
        self.seen += np.bincount(at, times, len(self.seen)).astype(np.int64)
        return at

    def lists(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many numbers the lists at these places have, and the numbers end to end."""
        counts = self.counts[at]
        shift = np.cumsum(self.counts)[at] - np.cumsum(counts)
        return counts, self.flat[np.repeat(shift, counts) + np.arange(int(counts.sum()))]

    def _learn(self, counts: np.ndarray, flat: np.ndarray) -> None:
        self.counts, self.flat = np.concatenate([self.counts, counts]), np.concatenate([self.flat, flat])
        self.seen = np.concatenate([self.seen, np.zeros(len(counts), np.int64)])

    def numbers(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words and numbers per text, and all texts' numbers end to end."""
        if len(self.index) > self.kept:
            self._forget()
        known = len(self.index)
        words = [t.encode().split() for t in texts]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        at = np.fromiter(map(self.index.__getitem__, chain.from_iterable(words)), np.int64, int(sizes.sum()))
        if len(self.index) > known:
            new = [w.decode() for w in islice(self.index, known, None)]
            counts, flat = self.make(new)
            self.counts, self.flat = np.concatenate([self.counts, counts]), np.concatenate([self.flat, flat])
            self.seen = np.concatenate([self.seen, np.zeros(len(new), np.int64)])
        self.seen += np.bincount(at, minlength=len(self.seen))
        starts = np.cumsum(self.counts) - self.counts
        counts = self.counts[at]
        ends = np.cumsum(counts)
        flat = self.flat[np.repeat(starts[at] - ends + counts, counts) + np.arange(int(counts.sum()))]
        sums = np.concatenate([[0], ends])
        return sizes, np.diff(sums[offsets(sizes)]), flat


def offsets(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def slices(batch: pa.RecordBatch, column: str, characters: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about so many characters of text; one text is never cut."""
    lengths = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for row, n in enumerate(lengths):
        if held and held + n > characters:
            yield batch.slice(start, row - start)
            start, held = row, 0
        held += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)


def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; at their end Arrow's free memory goes back, as idle workers would hold it."""
    yield from batches
    pa.default_memory_pool().release_unused()


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    """The texts of a batch; null counts as empty."""
    return [t or "" for t in batch.column(column).to_pylist()]


def with_columns(batch: pa.RecordBatch, names: list[str], arrays: list[pa.Array], drop: tuple = ()) -> pa.RecordBatch:
    kept = [n for n in batch.schema.names if n not in drop]
    return pa.RecordBatch.from_arrays([batch.column(n) for n in kept] + arrays, names=kept + names)


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that the table does not have, for columns that are dropped again."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def without(df: DataFrame, added: list[str]) -> DataFrame:
    """The table without columns of the names that an operator adds: its own take their place."""
    return df.drop(*[c for c in df.columns if c.lower() in {a.lower() for a in added}])


def hex_digest(column) -> F.Column:
    return F.sha2(column.cast("binary"), 256)


def wider(df: DataFrame, ddl: str, drop: tuple = ()) -> StructType:
    """The schema of a table with columns added at its end."""
    return StructType([f for f in df.schema.fields if f.name not in drop] + StructType.fromDDL(ddl).fields)
