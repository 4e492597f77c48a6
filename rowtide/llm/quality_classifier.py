"""Document quality from subword embeddings that are learned with the classifier.

A document is a bag of hashed features: its words, pairs of neighbouring words and the
character n-grams of its words. Each feature's vector is learned; a document's vector is
their mean and a softmax over two classes scores it. Training is stochastic gradient descent
in numpy on a bounded sample of labelled documents. Vectors and output weights together give
each feature one number, the difference of the two class scores, so scoring a document is a
mean of numbers: a word's sum is found once per worker, and the model that tasks get has a
fixed size.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowtide.llm.catalog import query, table
from rowtide.llm.words import CHAINED_SLICE, CHAINED_WORDS, WORD, released, slices, texts_of, wider, with_columns, without


@dataclass(frozen=True)
class Settings:
    """Bounds of the sample and size of the model.

    Of the labelled documents, those with the lowest hash of text and id are learned from: at
    most ``documents``, each of at most ``characters``; longer ones are scored all the same.
    """

    documents: int = 2000
    characters: int = 20_000
    buckets: int = 1 << 18
    width: int = 16
    shortest: int = 2
    longest: int = 4
    epochs: int = 5
    rate: float = 0.5
    seed: int = 7


LEARNED = 20_000  # words whose features are found at once
NEIGHBOURS_ALIKE = 1  # bucket for a word that repeats the one before it
MIX = np.uint64(0x9E3779B97F4A7C15)


def _buckets(hashes: np.ndarray, kind: int, settings: Settings) -> np.ndarray:
    mixed = (hashes ^ np.uint64(kind)) * MIX
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return 2 + ((mixed >> np.uint64(33)) % np.uint64(settings.buckets - 2)).astype(np.int64)


def word_features(words: list[str], settings: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all words' features, the word that each one is of, and a hash per word.

    A word's features are the word itself, its n-grams with its ends marked, and its shape.
    """
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    codes = np.frombuffer("".join([f"<{w}>" for w in words]).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    starts = np.cumsum(sizes) - sizes
    of = np.repeat(np.arange(len(words)), sizes)
    powers = np.cumprod(np.full(int(sizes.max()), MIX))
    hashes = np.add.reduceat(codes * powers[np.arange(len(codes)) - starts[of]], starts)
    shapes = np.fromiter((2 if w.isupper() and len(w) > 1 else w.isalpha() for w in words), np.uint64, len(words))
    buckets = [_buckets(hashes, 1, settings), _buckets(shapes, 2, settings)]
    owners = [np.arange(len(words))] * 2
    for n in range(settings.shortest, settings.longest + 1):
        whole = np.flatnonzero(of[: len(of) - n + 1] == of[n - 1 :])
        gram = sum(codes[whole + k] * powers_of(n)[k] for k in range(n))
        buckets.append(_buckets(gram, n + 8, settings))
        owners.append(of[whole])
    return np.concatenate(buckets), np.concatenate(owners), hashes


@cache
def powers_of(n: int) -> np.ndarray:
    return np.cumprod(np.full(n, MIX ^ np.uint64(0x5BD1E995)))


def pair_buckets(hashes: np.ndarray, settings: Settings) -> np.ndarray:
    """Buckets of neighbouring words, from the hashes of a document's words."""
    if len(hashes) < 2:
        return np.zeros(0, np.int64)
    left, right = hashes[:-1], hashes[1:]
    found = _buckets(left * MIX + right, 3, settings)
    found[left == right] = NEIGHBOURS_ALIKE
    return found


class Features:
    """Feature sums of words, kept per worker; ``values`` holds one number per bucket."""

    def __init__(self, values: np.ndarray, settings: Settings, kept: int = CHAINED_WORDS):
        self.values, self.settings, self.kept = values.astype(np.float64), settings, kept
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.sums, self.counts, self.hashes = np.zeros(0), np.zeros(0), np.zeros(0, np.uint64)

    def learn(self, new: list[str]) -> None:
        self.index.update(zip(new, range(len(self.index), len(self.index) + len(new))))
        buckets, owners, hashes = word_features(new, self.settings)
        self.sums = np.concatenate([self.sums, np.bincount(owners, self.values[buckets], len(new))])
        self.counts = np.concatenate([self.counts, np.bincount(owners, minlength=len(new))])
        self.hashes = np.concatenate([self.hashes, hashes])

    def score(self, texts: list[str]) -> np.ndarray:
        if len(self.index) > self.kept:
            self.clear()
        words = [WORD.findall(t) for t in texts]
        if new := [w for w in dict.fromkeys(chain.from_iterable(words)) if w not in self.index]:
            for i in range(0, len(new), LEARNED):
                self.learn(new[i : i + LEARNED])
        at = np.fromiter(map(self.index.__getitem__, chain.from_iterable(words)), np.int64, sum(map(len, words)))
        sizes = np.array([len(w) for w in words], np.int64)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        sums, counts = (np.concatenate([[0.0], np.cumsum(k[at])]) for k in (self.sums, self.counts))
        total, number = sums[ends] - sums[starts], counts[ends] - counts[starts]
        # Pair i joins words i and i + 1 of all documents; those across documents are left out.
        pairs = np.concatenate([[0.0], np.cumsum(self.values[pair_buckets(self.hashes[at], self.settings)])])
        last = len(pairs) - 1
        total += np.where(sizes > 1, pairs[np.clip(ends - 1, 0, last)] - pairs[np.clip(starts, 0, last)], 0)
        return total / np.maximum(number + np.maximum(sizes - 1, 0), 1)


def bag(text: str, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a document and their shares."""
    buckets, _, hashes = word_features(WORD.findall(text), settings)
    found, counts = np.unique(np.concatenate([buckets, pair_buckets(hashes, settings)]), return_counts=True)
    return found, counts / max(counts.sum(), 1)


def train(texts: list[str], labels: list[int], settings: Settings) -> tuple[np.ndarray, float]:
    """One number per bucket and a bias: the log odds of label 1 are their mean and the bias."""
    random = np.random.default_rng(settings.seed)
    vectors = random.uniform(-1, 1, (settings.buckets, settings.width)) / settings.width
    output, bias = np.zeros((settings.width, 2)), np.zeros(2)
    bags = [bag(t, settings) for t in texts]
    steps, step = settings.epochs * len(bags), 0
    for _ in range(settings.epochs):
        for i in random.permutation(len(bags)):
            found, shares = bags[i]
            rate = settings.rate * (1 - step / steps)
            step += 1
            mean = shares @ vectors[found]
            logits = mean @ output + bias
            odds = np.exp(logits - logits.max())
            error = odds / odds.sum()
            error[labels[i]] -= 1
            back = output @ error
            output -= rate * np.outer(mean, error)
            bias -= rate * 0.1 * error
            # A mean over many features moves each of them little: scale the step to the bag.
            vectors[found] -= rate * np.outer(np.sqrt(shares), back)
    return (vectors @ (output[:, 1] - output[:, 0])).astype(np.float32), float(bias[1] - bias[0])


def learn(labelled: DataFrame, settings: Settings, text: str = "text", label: str = "label") -> tuple[np.ndarray, float]:
    """Fits the model on the bounded sample. Rows without text or label teach nothing.

    With no usable row, or one class only, the model is the share of label 1 for every text.
    """
    usable = labelled.filter(F.col(text).isNotNull() & F.col(label).isin(0, 1) & (F.length(text) <= settings.characters))
    sample = usable.select(text, label).orderBy(F.xxhash64(text, label), text, label).limit(settings.documents)
    rows = [(r[0], int(r[1])) for r in sample.collect()]
    ones = sum(y for _, y in rows)
    if not rows or ones in (0, len(rows)):
        share = (ones + 1) / (len(rows) + 2)
        return np.zeros(settings.buckets, np.float32), float(np.log(share / (1 - share)))
    return train([t for t, _ in rows], [y for _, y in rows], settings)


def quality_scores(df: DataFrame, model: tuple[np.ndarray, float], settings: Settings, text: str = "text", name: str = "score") -> DataFrame:
    """Adds the probability of label 1, from the whole text alone. No shuffle.

    Null, empty and blank texts have no features and get what the bias says. A column of the
    added name is replaced; equal texts score alike; an empty table gives no rows.
    """
    base = without(df, [name])
    values, bias = model
    held = df.sparkSession.sparkContext.broadcast((values, settings))

    def run(batches):
        features = Features(*held.value)
        for batch in (part for b in released(batches) for part in slices(b, text, CHAINED_SLICE)):
            odds = features.score(texts_of(batch, text)) + bias
            yield with_columns(batch, [name], [pa.array(1 / (1 + np.exp(-np.clip(odds, -50, 50))))])

    return base.mapInArrow(run, wider(base, f"`{name}` DOUBLE"))


def held_out(doc_id: str = "doc_id", folds: int = 5) -> F.Column:
    """Rows that are never learned from: the checksum of the id as text falls into fold 0."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == 0


def quality_training_rows(docs: DataFrame, labels: DataFrame, settings: Settings) -> DataFrame:
    """Texts and quality labels of documents that may be learned from.

    A document that is labelled more than once counts with its lowest label. The ids with the
    lowest hashes are chosen among the labels alone, four for each document that is learned
    from, as some may lack a text; so few ids go to every task, and no text is shuffled.
    """
    learned = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out())
    known = learned.groupBy("doc_id").agg(F.min("quality").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(4 * settings.documents)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "label")


def document_scores(docs: DataFrame, taught: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``docs`` with ``score``, learned from labelled documents of ``taught`` not held out."""
    model = learn(quality_training_rows(taught, labels, settings), settings)
    return quality_scores(docs, model, settings)


@query()
def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    labels = table(spark, sf_dir, "labels", "doc_id", "quality")
    scored = document_scores(docs, docs, labels)
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
