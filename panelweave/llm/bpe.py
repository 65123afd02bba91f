"""Byte-level BPE encoding and decoding as a tree reduction over halves."""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Pieces up to so many bytes are merged directly; longer ones are halved. Parts up to so many bytes are remembered.
LEAF_BYTES, PART_BYTES = 4, 10
#: Pieces in each of the two generations that a Python worker remembers, and their greatest length in characters; parts
#: and pairs it remembers.
CACHE_PIECES, CACHE_CHARS, CACHE_PARTS = 250_000, 48, 50_000
#: Rows of an output batch hold about so many ids at most.
BATCH_IDS = 1_000_000


class TreeBPE:
    """Encoder over a rank table ``bytes -> id`` in which every single byte has a rank.

    ``encode`` is a monoid: the ids of a whole follow from the ids of its halves. ``join`` re-encodes a window around
    the seam, and doubles the window until it agrees with the ids outside. Agreement is proven by pairs: ids are the
    BPE encoding of their bytes exactly when each two neighbours are the encoding of their own two byte strings, so a
    window is final once the pairs at its two outer edges stand. Ids outside the window already stood.
    """

    def __init__(self, ranks: dict[bytes, int], leaf_bytes: int = LEAF_BYTES):
        self.ranks, self.leaf = ranks, max(2, leaf_bytes)
        self.table = {i: b for b, i in ranks.items()}
        self._pairs: dict[tuple[int, int], list[int]] = {}
        self._parts: dict[bytes, list[int]] = {}

    def merge(self, data: bytes) -> list[int]:
        """Merge the adjacent parts of least rank, leftmost first, until none is in the table."""
        ranks = self.ranks
        if data in ranks:
            return [ranks[data]]
        if len(data) > 64:
            return self._merge_long(data)
        never, look = 1 << 60, ranks.get
        cuts = list(range(len(data) + 1))
        near = [look(data[i : i + 2], never) for i in range(len(data) - 1)]
        while near and (least := min(near)) != never:
            i = near.index(least)
            del cuts[i + 1], near[i]
            if i:
                near[i - 1] = look(data[cuts[i - 1] : cuts[i + 1]], never)
            if i < len(near):
                near[i] = look(data[cuts[i] : cuts[i + 2]], never)
        return [ranks[data[a:b]] for a, b in zip(cuts, cuts[1:], strict=False)]

    def _merge_long(self, data: bytes) -> list[int]:
        """The same with a heap over a linked list, for windows that grow long."""
        ranks, n = self.ranks, len(data)
        end, prev, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, stop = heappop(heap)
            if not alive[i] or (j := end[i]) >= n or not alive[j] or end[j] != stop:
                continue
            alive[j], end[i] = False, stop
            if stop < n:
                prev[stop] = i
                if (r := ranks.get(data[i : end[stop]])) is not None:
                    heappush(heap, (r, i, end[stop]))
            if (p := prev[i]) >= 0 and (r := ranks.get(data[p:stop])) is not None:
                heappush(heap, (r, p, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i : end[i]]])
            i = end[i]
        return out

    def pair(self, a: int, b: int) -> list[int]:
        """The encoding of the joint bytes of two ids, remembered up to a bound."""
        if (known := self._pairs.get((a, b))) is None:
            known = self.merge(self.table[a] + self.table[b])
            if len(self._pairs) < CACHE_PARTS:
                self._pairs[a, b] = known
        return known

    def stands(self, a: int, b: int) -> bool:
        """Whether two neighbouring ids are the encoding of their joint bytes."""
        return self.pair(a, b) == [a, b]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        if not left or not right:
            return left + right
        i = j = 1
        window = self.pair(left[-1], right[0])
        while True:
            fits_left = i == len(left) or self.stands(left[-i - 1], window[0])
            fits_right = j == len(right) or self.stands(window[-1], right[j])
            if fits_left and fits_right:
                return left[: len(left) - i] + window + right[j:]
            i, j = (i if fits_left else min(2 * i, len(left))), (j if fits_right else min(2 * j, len(right)))
            window = self.merge(b"".join(map(self.table.__getitem__, left[len(left) - i :] + right[:j])))

    def encode(self, data: bytes) -> list[int]:
        """Ids of one pre-split piece."""
        if len(data) <= PART_BYTES and (known := self._parts.get(data)) is not None:
            return known
        if len(data) <= self.leaf:
            ids = self.merge(data) if data else []
        else:
            half = len(data) // 2
            ids = self.join(self.encode(data[:half]), self.encode(data[half:]))
        if len(data) <= PART_BYTES and len(self._parts) < CACHE_PARTS:
            self._parts[data] = ids
        return ids

    def decode(self, ids: list[int]) -> bytes:
        """Bytes of ids: leaves of 4,096 ids, concatenated up the tree."""
        if len(ids) <= 4096:
            return b"".join(map(self.table.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


class _Pieces(dict):
    """Ids of pieces, in two generations: a full one becomes the older, so what is in use stays and memory is bounded."""

    def __init__(self, bpe: TreeBPE):
        super().__init__()
        self.bpe, self.older = bpe, {}

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if (ids := self.older.get(piece)) is None:
            ids = tuple(self.bpe.encode(piece.encode()))
        if len(piece) <= CACHE_CHARS:
            if len(self) >= CACHE_PIECES:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids


#: What a Python worker learned in earlier tasks of the same job, by the job's tag: one entry.
_LEARNED: dict[str, _Pieces] = {}


def _pieces(tag: str, ranks) -> _Pieces:
    if tag not in _LEARNED:
        _LEARNED.clear()
        _LEARNED[tag] = _Pieces(TreeBPE(ranks.value))
    return _LEARNED[tag]


def read_ranks(rank_file: str) -> dict[bytes, int]:
    """A rank file: base64 of the bytes, a space and the rank on each line."""
    with open(rank_file, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, map(bytes.strip, lines)))}


def encode(docs: DataFrame, rank_file: str, pattern: str, text_col: str = "text", ids_col: str = "token_ids", bytes_col: str | None = None) -> DataFrame:
    """``docs`` with ``ids_col`` array<int>: each match of ``pattern`` encoded by itself, no special tokens.

    Null and empty texts give an empty array. Every other column, row and repetition is kept as it is; an input column
    of the output's name is replaced. Rows stay in their partitions. The rank table, of bounded size, is broadcast.
    With ``bytes_col``, the ids are decoded again in the same pass, into a binary column of that name.
    """
    docs = docs.drop(ids_col, *([bytes_col] if bytes_col else []))
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(rank_file))
    at = docs.columns.index(text_col)
    added = [T.StructField(ids_col, T.ArrayType(T.IntegerType(), False))] + ([T.StructField(bytes_col, T.BinaryType())] if bytes_col else [])
    schema = T.StructType([*docs.schema.fields, *added])
    texts_as_string = docs.withColumn(text_col, F.col(text_col).cast("string"))
    tag = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        pieces = _pieces(tag, ranks)
        bpe, split, look = pieces.bpe, regex.compile(pattern).findall, pieces.__getitem__

        def out(batch, begin, flat, back):
            rows = batch.slice(begin, len(flat))
            ids = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, flat)]), pa.int32()), pa.array(np.concatenate(flat), pa.int32()))
            decoded = [pa.array(back, pa.binary())] if bytes_col else []
            return pa.RecordBatch.from_arrays([*rows.columns, ids, *decoded], names=schema.names)

        for batch in batches:
            flat, back, begin, held = [], [], 0, 0
            for k, text in enumerate(batch.column(at)):
                ids = list(chain.from_iterable(map(look, split(text.as_py() or ""))))
                flat.append(np.array(ids, np.int32))
                if bytes_col:
                    back.append(bpe.decode(ids))
                held += len(ids)
                if held >= BATCH_IDS:
                    yield out(batch, begin, flat, back)
                    flat, back, begin, held = [], [], k + 1, 0
            if flat:
                yield out(batch, begin, flat, back)

    return texts_as_string.mapInArrow(run, schema)


def decode(tokens: DataFrame, rank_file: str, ids_col: str = "token_ids", bytes_col: str = "decoded") -> DataFrame:
    """``tokens`` with ``bytes_col`` binary: the bytes of ``ids_col``. A null array gives empty bytes; an input column of
    the output's name is replaced; an unknown id raises KeyError."""
    tokens = tokens.drop(bytes_col)
    ranks = tokens.sparkSession.sparkContext.broadcast(read_ranks(rank_file))
    at = tokens.columns.index(ids_col)
    schema = T.StructType([*tokens.schema.fields, T.StructField(bytes_col, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = TreeBPE(ranks.value)
        for batch in batches:
            for begin in range(0, batch.num_rows, 1000):
                rows = batch.slice(begin, 1000)
                back = pa.array([bpe.decode(x.values.to_pylist() if x.is_valid else []) for x in rows.column(at)], pa.binary())
                yield pa.RecordBatch.from_arrays([*rows.columns, back], names=[*rows.schema.names, bytes_col])

    return tokens.mapInArrow(run, schema)


def digests(tokens: DataFrame, id_col: str = "doc_id", ids_col: str = "token_ids", bytes_col: str = "decoded") -> DataFrame:
    """Per row: the id, the number of ids, and SHA-256 of the ids in decimal joined by spaces and of the decoded bytes."""
    return tokens.select(
        id_col,
        F.size(ids_col).cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col(ids_col).cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(bytes_col, 256).alias("decoded_sha256"),
    )


def encode_and_decode(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The digests of a round trip of every document."""
    return digests(encode(docs.select(id_col, text_col), rank_file, pattern, text_col, bytes_col="decoded"), id_col)
