"""SentencePiece encoding that keeps, for every piece, the bytes of the text it stands for.

A text is normalised first: at each position the longest prefix that the model's compiled
character map knows is replaced, and every normalised byte records the original byte it came
from. The library finds the pieces of the normalised text; a piece from normalised byte ``a``
to ``b`` then covers the original bytes from ``source[a]`` to ``source[b]``. That the pieces
cover the whole normalised text is checked for every text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowtide.llm.catalog import query, table
from rowtide.llm.words import offsets, slices, texts_of, wider, with_columns, without

SPACE = "▁"


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        length = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield key >> 3, data[at : at + length]
        at += length


class CharacterMap:
    """The compiled map of a model: a double-array trie of byte strings to replacements."""

    def __init__(self, compiled: bytes):
        self.units, self.replacements = np.zeros(0, np.uint32), b""
        if compiled:
            size = int.from_bytes(compiled[:4], "little")
            self.units = np.frombuffer(compiled[4 : 4 + size], "<u4")
            self.replacements = compiled[4 + size :]
        self.list = self.units.tolist()

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest known prefix at a position."""
        units, found = self.list, None
        if not units:
            return None

        def child_base(unit: int) -> int:
            return (unit >> 10) << ((unit & 512) >> 6)

        node = child_base(units[0])
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(units) or units[node] & 0x800000FF != data[i]:
                break
            unit = units[node]
            node ^= child_base(unit)
            if unit >> 8 & 1:
                start = units[node] & 0x7FFFFFFF
                found = (i + 1 - at, self.replacements[start : self.replacements.index(b"\0", start)])
        return found


class Normalizer:
    """Normalised text of a model, and the original byte that each normalised byte is from."""

    def __init__(self, spec: bytes):
        values = dict(_fields(spec))
        self.map = CharacterMap(values.get(2, b""))
        self.dummy_prefix = bool(values.get(3, 1))
        self.remove_extra = bool(values.get(4, 1))
        self.escape = bool(values.get(5, 1))
        self.space = (SPACE if self.escape else " ").encode()
        self.plain = not self.map.list and not self.remove_extra and self.escape

    def __call__(self, text: str) -> tuple[str, np.ndarray]:
        data = text.encode()
        return self._plain(text, data) if self.plain else self._mapped(data)

    def _plain(self, text: str, data: bytes) -> tuple[str, np.ndarray]:
        """No map and no spaces to remove: only spaces change, all at once."""
        if not data:
            return "", np.zeros(1, np.int64)
        widths = np.where(np.frombuffer(data, np.uint8) == 32, 3, 1)
        lead = 3 if self.dummy_prefix else 0
        source = np.concatenate([np.zeros(lead, np.int64), np.repeat(np.arange(len(data)), widths), [len(data)]])
        return (SPACE if lead else "") + text.replace(" ", SPACE), source

    def _mapped(self, data: bytes) -> tuple[str, np.ndarray]:
        parts, at = [], 0
        while at < len(data):
            if found := self.map.longest(data, at):
                length, new = found
            else:
                first = data[at]
                length = 1 if first < 128 else 2 if first < 224 else 3 if first < 240 else 4
                new = data[at : at + length]
            parts.append((at, new))
            at += length
        if self.remove_extra:
            while parts and parts[0][1] in (b" ", b""):
                parts.pop(0)
        out, source = bytearray(), []

        def put(value: bytes, origin: int) -> None:
            out.extend(value)
            source.extend([origin] * len(value))

        if parts and self.dummy_prefix:
            put(self.space, parts[0][0])
        spaced = self.remove_extra
        for origin, new in parts:
            while spaced and new.startswith(b" "):
                new = new[1:]
            if not new:
                continue
            for byte in new:
                put(self.space if byte == 32 else bytes([byte]), origin)
            spaced = self.remove_extra and new.endswith(b" ")
        end = len(data)
        if self.remove_extra:
            while out.endswith(self.space):
                end = source[-len(self.space)]
                del out[-len(self.space) :], source[-len(self.space) :]
        return out.decode(), np.array([*source, end], np.int64)


class Encoder:
    """Pieces of a SentencePiece model on normalised text, projected to the original bytes."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = model = sentencepiece.SentencePieceProcessor(model_file=path)
        message = dict(_fields(model.serialized_model_proto()))
        self.normalizer = Normalizer(message.get(3, b""))
        pieces = range(model.get_piece_size())
        self.widths = np.array([1 if model.is_byte(i) else len(model.id_to_piece(i).encode()) for i in pieces])
        self.byte_fallback = any(model.is_byte(i) for i in pieces)
        self.end = model.eos_id()

    def _widths(self, texts: list[str], ids: np.ndarray) -> np.ndarray:
        """Length of every piece in normalised bytes; unknown characters have no fixed one."""
        if self.byte_fallback:
            return self.widths[ids]
        surfaces = self.library.encode(texts, out_type=str, num_threads=1)
        return np.fromiter((len(p.encode()) for text in surfaces for p in text), np.int64, len(ids))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Counts per text; ids, first and last original byte of every piece, end to end.

        Of a character that is coded byte by byte, each piece covers its own byte.
        """
        coded = self.library.encode(texts, num_threads=1)
        counts = np.fromiter(map(len, coded), np.int64, len(coded))
        ids = np.fromiter(chain.from_iterable(coded), np.int64, int(counts.sum()))
        sources = [self.normalizer(t)[1] for t in texts]
        sizes = np.array([len(s) for s in sources], np.int64)
        widths = self._widths(texts, ids)
        ends = np.cumsum(widths)
        done = np.concatenate([[0], ends])[offsets(counts)]
        if (np.diff(done) != sizes - 1).any():
            raise ValueError("pieces do not cover the normalised text")
        move = np.repeat(offsets(sizes)[:-1] - done[:-1], counts)
        source = np.concatenate(sources) if sources else np.zeros(0, np.int64)
        return counts, ids, source[ends - widths + move], source[ends + move]


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def sentencepiece_encode(df: DataFrame, model: str, text: str = "text", end_id: bool = True, decode: bool = False) -> DataFrame:
    """Adds ``ids``, ``starts`` and ``ends`` (original byte spans), all ``array<int>``.

    With ``end_id`` the model's end id closes the ids; it covers no bytes. With ``decode``
    the library's own decoding of the ids is added as ``decoded``. One row in, one row out,
    no shuffle; texts are never cut. Null and empty texts have no pieces; a column that has
    one of the added names is replaced; repeated rows stay; an empty table gives no rows.
    """
    base = without(df, ["ids", "starts", "ends", "decoded"])
    names = ["ids", "starts", "ends"] + ["decoded"] * decode

    def run(batches):
        tool = encoder(model)
        for batch in chain.from_iterable(slices(b, text) for b in batches):
            texts = texts_of(batch, text)
            counts, ids, starts, ends = tool.encode(texts)
            if end_id:
                at = np.cumsum(counts)
                sizes = np.array([len(t.encode()) for t in texts], np.int64)
                ids, starts, ends = (np.insert(ids, at, tool.end), np.insert(starts, at, sizes), np.insert(ends, at, sizes))
                counts = counts + 1
            limits = pa.array(offsets(counts).astype(np.int32))
            lists = [pa.ListArray.from_arrays(limits, pa.array(x.astype(np.int32))) for x in (ids, starts, ends)]
            if decode:
                flat, cuts = ids.tolist(), offsets(counts).tolist()
                lists.append(pa.array([tool.library.decode(flat[a:b]) for a, b in zip(cuts, cuts[1:])], pa.string()))
            yield with_columns(batch, names, lists)

    kinds = ["STRING" if n == "decoded" else "ARRAY<INT>" for n in names]
    return base.mapInArrow(run, wider(base, ", ".join(map(" ".join, zip(names, kinds)))))


@query()
def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    coded = sentencepiece_encode(docs, public_tokenizers.path("piece_bpe_32k.model"), decode=True)
    return coded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        F.xxhash64("starts", "ends").alias("spans_xxhash64"),
    )
