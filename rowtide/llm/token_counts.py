"""Greedy word-piece lengths of texts, counted in time linear in the text.

The vocabulary is a trie whose nodes have failure links. A node's link says where matching
goes on when no child fits, and how many tokens have then been popped; both are computed
once. A word is read once, character by character, adding up popped counts: no piece is
built and no character is read twice, whatever the longest piece.
"""

from __future__ import annotations

from collections import deque
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowtide.llm.catalog import query, table
from rowtide.llm.words import Pieces, slices, texts_of, wider, with_columns, without

DEAD = -1


class Automaton:
    """Longest-match counts for words: ``first`` pieces start a word, ``later`` ones go on."""

    def __init__(self, first: set[str], later: set[str]):
        # Node 0 starts a word, node 1 stands behind a token.
        self.edges: list[dict[str, int]] = [{}, {}]
        token = [False, False]
        for root, pieces in ((0, first), (1, later)):
            for piece in pieces:
                node = root
                for c in piece:
                    if c not in self.edges[node]:
                        self.edges[node][c] = len(self.edges)
                        self.edges.append({})
                        token.append(False)
                    node = self.edges[node][c]
                token[node] = True
        self.link = [DEAD] * len(token)
        self.popped = [0] * len(token)
        queue = deque((0, 1))
        while queue:
            parent = queue.popleft()
            for c, node in self.edges[parent].items():
                if token[node]:
                    self.link[node], self.popped[node] = 1, 1
                else:
                    at, count = self.link[parent], self.popped[parent]
                    while at != DEAD and c not in self.edges[at]:
                        count += self.popped[at]
                        at = self.link[at]
                    if at != DEAD:
                        self.link[node], self.popped[node] = self.edges[at][c], count
                queue.append(node)

    def count(self, word: str) -> int:
        """Tokens of a word; a word that no pieces make up is one unknown token."""
        edges, link, popped = self.edges, self.link, self.popped
        node = count = 0
        for c in word:
            while c not in edges[node]:
                count += popped[node]
                node = link[node]
                if node == DEAD:
                    return 1
            node = edges[node][c]
        while node != 1:
            count += popped[node]
            node = link[node]
            if node == DEAD:
                return 1
        return count


def space_marked_vocabulary(path: str, space: str = "▁") -> tuple[set[str], set[str]]:
    """Pieces of a SentencePiece model: with the space mark they start a word, else go on."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    pieces = {model.id_to_piece(i) for i in ids}
    first = {p[len(space) :] for p in pieces if p.startswith(space) and not p[len(space) :].startswith(space)} - {""}
    return first, {p for p in pieces if not p.startswith(space)}


@cache
def counter(path: str) -> tuple[Automaton, Pieces]:
    automaton = Automaton(*space_marked_vocabulary(path))
    return automaton, Pieces(lambda words: (np.ones(len(words), np.int64), np.array([automaton.count(w) for w in words], np.int64)))


def token_counts(df: DataFrame, model: str, text: str = "text") -> DataFrame:
    """Adds ``n_words`` and ``n_tokens`` (bigint): greedy word-piece length of whole texts.

    One row in, one row out, no shuffle. Null, empty and blank texts count 0 words and 0
    tokens; columns of the added names are replaced; repeated rows stay; an empty table
    gives no rows.
    """
    base = without(df, ["n_words", "n_tokens"])

    def run(batches):
        _, memory = counter(model)
        for batch in (part for b in batches for part in slices(b, text)):
            # One number per word: its tokens.
            sizes, _, counts = memory.numbers(texts_of(batch, text))
            sums = np.concatenate([[0], np.cumsum(counts)])
            ends = np.cumsum(sizes)
            yield with_columns(batch, ["n_words", "n_tokens"], [pa.array(sizes), pa.array(sums[ends] - sums[ends - sizes])])

    return base.mapInArrow(run, wider(base, "n_words BIGINT, n_tokens BIGINT"))


@query()
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")
    counted = token_counts(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return counted.select("doc_id", "lang", "source", F.length(F.coalesce("text", F.lit(""))).cast("bigint").alias("n_chars"), "n_words", "n_tokens")
