"""Alignment of two tokenizers: byte spans of their tokens, groups between shared ends, and links of overlapping tokens."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Callable, Iterator
from itertools import chain
from operator import attrgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelweave.functions.lineage import materialize

#: Characters of the texts that are aligned together, about, of the words of a line, and lines that are encoded at once;
#: one text, or one word, may be longer.
CHUNK_CHARS, LINE_CHARS, LINES = 4 << 20, 4000, 64
#: A single space between visible characters.
VISIBLE = "[!-~\u00c0-\u024f]"
CUT, EDGES = re.compile(f"(?<={VISIBLE}) (?={VISIBLE})"), frozenset(c for c in map(chr, range(0x250)) if re.match(VISIBLE, c))
ID_AND_END = attrgetter("id", "end")
COUNTS = ("n_a", "n_b", "n_groups", "n_links")
#: Bits of a pair's number that hold the second tokenizer's id.
ID_BITS = 32


def byte_of_symbol() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: visible Latin-1 is itself, the rest follow from U+0100."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}


def refine(begin: np.ndarray, end: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Byte ends of tokens from the byte spans of the characters they touch and their numbers of decoded bytes.

    A token whose span is as long as its bytes ends where its span ends: a coarse cut. A token that holds a part of a
    character, as bytes of it do, spans more or less than its bytes; it ends as many bytes behind the last coarse cut as
    have been decoded since. Tokens follow each other without gaps from byte 0.
    """
    total = np.cumsum(sizes)
    coarse = (end - begin == sizes) & (end == total)
    last = np.maximum.accumulate(np.where(coarse, np.arange(len(sizes)), -1))
    behind = total - np.where(last >= 0, total[last], 0)
    return np.where(last >= 0, end[last], 0) + behind


class Aligner:
    """Both encoders, and the bytes of every id."""

    def __init__(self, a_json: str, b_model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        import sentencepiece
        import tokenizers
        from sentencepiece import sentencepiece_model_pb2

        self.a = tokenizers.Tokenizer.from_str(a_json)
        self.a.encode_special_tokens = True
        self.a.post_processor = tokenizers.processors.ByteLevel(trim_offsets=False)
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        symbols, vocabulary = byte_of_symbol(), self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(map(symbols.__getitem__, token)) if all(c in symbols for c in token) else token.encode()
        pieces = [self.b.IdToPiece(i) for i in range(self.b.GetPieceSize())]
        self.b_bytes = [bytes([int(p[3:-1], 16)]) if self.b.IsByte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_sizes, self.b_sizes = (np.array([*map(len, t)], np.int64) for t in (self.a_bytes, self.b_bytes))
        self.a_names, self.b_names = (self._names(len(t), marks) for t, marks in ((self.a_bytes, b",;\n"), (self.b_bytes, b",|")))
        rules = sentencepiece_model_pb2.ModelProto.FromString(b_model)
        plain = rules.normalizer_spec.name == "identity" and rules.normalizer_spec.add_dummy_prefix and not rules.normalizer_spec.remove_extra_whitespaces
        own = self.a.normalizer is None and type(self.a.pre_tokenizer) is tokenizers.pre_tokenizers.ByteLevel
        self.cuts = bool(plain and own and not any("▁" in p.lstrip("▁") for p in pieces))

    @staticmethod
    def _names(size: int, marks: bytes) -> np.ndarray:
        """Decimal ids behind each of the marks."""
        return np.array([[b"%c%d" % (m, i) for i in range(size)] for m in marks])

    def words(self, text: str) -> list[str]:
        """Parts w of a text such that space+text is space+w of all of them, and that both tokenizers encode by themselves.

        A cut is a single space between two visible characters: A's pattern begins a token there and has none across; B
        has no piece with a space behind another character. Where a tokenizer's rules do not promise that, there is no cut.
        """
        return CUT.split(text) if self.cuts else [text]

    def _lines(self, words: list[str]) -> list[list[int]]:
        """Words that are encoded together, a space between them: cuts hold there, too, if both ends of a word are visible."""
        lines, held, line = [], 0, []
        for k, w in enumerate(words):
            if not (self.cuts and w and w[0] in EDGES and w[-1] in EDGES):
                lines.append([k])
                continue
            line.append(k)
            held += len(w)
            if held >= LINE_CHARS:
                lines.append(line)
                held, line = 0, []
        return lines + ([line] if line else [])

    def encode(self, words: list[str], lines: list[list[int]]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(words, ids_a, ends_a, ids_b, ends_b) of lines whose bytes both tokenizers keep; ends in bytes of the line.

        A line that does not keep its bytes is tried again word by word; a word that does not is left out.
        """
        texts = [" ".join([words[k] for k in line]) for line in lines]
        spaced = [" " + t for t in texts]
        again = []
        for line, text, data, e, proto in zip(lines, texts, map(str.encode, spaced), self.a.encode_batch(spaced, add_special_tokens=False), self.b.encode(texts, num_threads=1, return_type="proto"), strict=True):
            rows_b = np.fromiter(chain.from_iterable(map(ID_AND_END, proto.pieces)), np.int64).reshape(-1, 2)  # a piece is wrapped anew each time it is read
            ids_a, ids_b = e.ids, rows_b[:, 0].tolist()
            if b"".join(map(self.a_bytes.__getitem__, ids_a)) != data or b"".join(map(self.b_bytes.__getitem__, ids_b)) != data:
                again += [[k] for k in line] if len(line) > 1 else []
                continue
            spans_a = np.fromiter(chain.from_iterable(e.offsets), np.int64, 2 * len(ids_a)).reshape(-1, 2)
            if len(data) > len(text) + 1:  # characters of several bytes
                points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
                width = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
                spans_a = np.concatenate([[0], np.cumsum([1, *width])])[spans_a]
            ends_b = np.concatenate([[0], rows_b[:, 1] + 1])  # behind the space that the tokenizer adds; spans are in bytes
            ids_a, ids_b = np.array(ids_a, np.int64), rows_b[:, 0]
            yield line, ids_a, refine(spans_a[:, 0], spans_a[:, 1], self.a_sizes[ids_a]), ids_b, refine(ends_b[:-1], ends_b[1:], self.b_sizes[ids_b])
        if again:
            yield from self.encode(words, again)

    def align(self, texts: list[str]) -> dict[str, list]:
        """Counts, groups and links of texts; links as places in the list of distinct pairs of all of them. A word that returns is encoded once."""
        cut = [self.words(t) if t else [] for t in texts]
        words = [*dict.fromkeys(chain.from_iterable(cut))]
        known = dict(zip(words, range(len(words)), strict=True))
        per_text = np.fromiter(map(len, cut), np.int64, len(cut))
        word = np.fromiter(map(known.__getitem__, chain.from_iterable(cut)), np.int64, per_text.sum())
        lines = self._lines(words)
        found = [x for k in range(0, len(lines), LINES) for x in self.encode(words, lines[k : k + LINES])]
        # one byte axis for all words that are kept, one behind the other
        order = [k for line, *_ in found for k in line]
        rank = np.full(len(words), -1)
        rank[order] = np.arange(len(order))
        stops = np.cumsum(np.fromiter((len(words[k].encode()) + 1 for k in order), np.int64, len(order)))
        bases = np.cumsum([0, *[x[2][-1] for x in found]])
        none = np.zeros(0, np.int64)
        ids_a, ends_a, ids_b, ends_b = (np.concatenate([none, *[x[c] + (bases[k] if c in (2, 4) else 0) for k, x in enumerate(found)]]) for c in range(1, 5))
        # between two cuts lie exactly one token of each side, and two tokens that overlap have exactly one such stretch
        every = np.sort(np.concatenate([ends_a, ends_b]), kind="stable")
        twice = np.append(every[1:] == every[:-1], False)[: len(every)]
        cuts, shared = every[~twice], every[twice]
        pairs, place = np.unique(ids_a[np.searchsorted(ends_a, cuts)] << ID_BITS | ids_b[np.searchsorted(ends_b, cuts)], return_inverse=True)
        until_a, until_b, until_cut, until_shared = (np.concatenate([[0], np.searchsorted(x, stops, "right")]) for x in (ends_a, ends_b, cuts, shared))
        fragments = self._groups(ids_a, np.searchsorted(shared, ends_a), ids_b, np.searchsorted(shared, ends_b), len(shared), until_a[:-1])
        text_of, word = np.repeat(np.arange(len(texts)), per_text), rank[word]
        broken = np.zeros(len(texts), bool)
        broken[text_of[word < 0]] = True
        text_of, word = text_of[~broken[text_of]], word[~broken[text_of]]
        rows: dict[str, list] = {}
        for name, until in zip(COUNTS, (until_a, until_b, until_shared, until_cut), strict=True):
            rows[name] = np.bincount(text_of, np.diff(until)[word], len(texts)).astype(np.int64)
        links = np.diff(until_cut)[word]
        at = np.repeat(until_cut[word] - np.cumsum(links) + links, links) + np.arange(links.sum())
        base = max(1, len(pairs))
        keys, times = np.unique(np.repeat(text_of, links) * base + place[at], return_counts=True)
        per = np.searchsorted(keys, np.arange(len(texts) + 1) * base)
        rows["places"], rows["times"] = ([x[u:v] for u, v in zip(per, per[1:], strict=False)] for x in ((keys % base).astype(np.int32), times.astype(np.int32)))
        limits, in_order = np.searchsorted(text_of, np.arange(len(texts) + 1)).tolist(), word.tolist()
        rows["groups"] = ["".join([fragments[k] for k in in_order[u:v]])[1:] for u, v in zip(limits, limits[1:], strict=False)]
        return rows | {"pairs": pairs, "totals": np.bincount(place[at], minlength=len(pairs))}

    def _groups(self, ids_a: np.ndarray, group_a: np.ndarray, ids_b: np.ndarray, group_b: np.ndarray, groups: int, leading: np.ndarray) -> list[str]:
        """For each word, its groups in order, A's ids before B's, with a semicolon before each; ``leading``: the words' first tokens of A."""
        first_a, first_b = np.searchsorted(group_a, np.arange(groups + 1)), np.searchsorted(group_b, np.arange(groups + 1))
        names = np.empty(len(ids_a) + len(ids_b), np.promote_types(self.a_names.dtype, self.b_names.dtype))
        mark_a, mark_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
        mark_a[first_a[:-1]] = mark_b[first_b[:-1]] = 1
        mark_a[leading] = 2
        names[np.arange(len(ids_a)) + first_b[group_a]] = self.a_names[mark_a, ids_a]
        names[np.arange(len(ids_b)) + first_a[group_b + 1]] = self.b_names[mark_b, ids_b]
        return [";" + f for f in names.tobytes().translate(None, b"\0").decode().split("\n")[1:]]


#: The aligner of the job that a Python worker served last.
_LOADED: dict[str, Aligner] = {}


def _aligner(tag: str, a_json, b_model) -> Aligner:
    if tag not in _LOADED:
        _LOADED.clear()
        _LOADED[tag] = Aligner(a_json.value, b_model.value)
    return _LOADED[tag]


def _read(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def linked_chunks(docs: DataFrame, a_file: str, b_file: str, id_col: str, text_col: str) -> DataFrame:
    """A row for each text (id, counts, groups, and its distinct links as places and times) and one for each chunk (its distinct pairs and their totals).

    A chunk is some texts of one task, of ``CHUNK_CHARS`` or a single longer text. Rows of texts have null ``pairs``.
    """
    context = docs.sparkSession.sparkContext
    a_json, b_model, tag = context.broadcast(_read(a_file).decode()), context.broadcast(_read(b_file)), uuid.uuid4().hex
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kinds = {"chunk": pa.string(), **dict.fromkeys(COUNTS, pa.int64()), "groups": pa.string(), "places": pa.list_(pa.int32()), "times": pa.list_(pa.int32()), "pairs": pa.list_(pa.int64()), "totals": pa.list_(pa.int64())}
    spark_kinds = {"chunk": "string", **dict.fromkeys(COUNTS, "bigint"), "groups": "string", "places": "array<int>", "times": "array<int>", "pairs": "array<bigint>", "totals": "array<bigint>"}
    schema = T.StructType([texts.schema["id"], *[T.StructField(n, T.DataType.fromDDL(k)) for n, k in spark_kinds.items()]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, number, task = _aligner(tag, a_json, b_model), 0, TaskContext.get().partitionId()

        def chunk(ids: list[pa.Scalar], part: list[str]) -> pa.RecordBatch:
            rows = both.align(part)
            name, n = f"{task}-{number}", len(part)
            own = {"chunk": [name] * (n + 1)} | {c: [*rows[c].tolist(), None] for c in COUNTS} | {c: [*rows[c], None] for c in ("groups", "places", "times")}
            own |= {c: [None] * n + [rows[c]] for c in ("pairs", "totals")}
            kind = ids[0].type
            return pa.RecordBatch.from_arrays([pa.array([*(i.as_py() for i in ids), None], kind), *(pa.array(own[c], kinds[c]) for c in kinds)], names=["id", *kinds])

        ids, part, held = [], [], 0
        for batch in batches:
            for i, text in zip(batch.column(0), batch.column(1), strict=True):
                ids.append(i)
                part.append(text.as_py())
                held += len(part[-1])
                if held >= CHUNK_CHARS:
                    yield chunk(ids, part)
                    ids, part, held, number = [], [], 0, number + 1
        if ids:
            yield chunk(ids, part)

    return texts.mapInArrow(run, schema)


def align(
    docs: DataFrame, a_file: str, b_file: str, id_col: str = "doc_id", text_col: str = "text", groups_as: Callable[[Column], Column] = lambda groups: groups
) -> DataFrame:
    """(id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) for each row of ``docs``.

    A, a byte-level tokenizer (JSON), encodes space+text, and B, a piece model that adds the space itself, the text; strings
    of special tokens are ordinary text. ``groups`` is the ids between the byte offsets where tokens of both end, as
    ``a1,a2|b1;a3|b2,b3``; ``groups_as`` may change it, to a digest for instance, before it is stored. A link is a pair of tokens
    whose bytes overlap, ``count_sum`` the sum over links of how many links of the whole table have the same two ids,
    ``n_best`` the number of links whose two ids are linked as often as any with that id of B.

    Null and empty texts, and texts of which either tokenizer does not keep the bytes, have zeros and an empty string.
    Rows that repeat an id are rows of their own. Other columns are not read. A very long text is a chunk of its own.

    Pairs are counted within chunks first, and counts travel back to chunks: a shuffled row is a pair of a chunk, so
    the most frequent pair has no more rows than there are chunks.
    """
    found = materialize(linked_chunks(docs, a_file, b_file, id_col, text_col).withColumn("groups", groups_as(F.col("groups"))), "alignment")
    listed = found.where("pairs IS NOT NULL").select("chunk", F.posexplode(F.arrays_zip("pairs", "totals")).alias("place", "x"))
    listed = listed.select("chunk", "place", F.col("x.pairs").alias("pair"), F.col("x.totals").alias("n"))
    counts = materialize(listed.groupBy("pair").agg(F.sum("n").alias("count")).withColumn("b", F.col("pair").bitwiseAND(2**ID_BITS - 1)), "pair-counts")
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    told = counts.join(F.broadcast(most), "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))  # a row for each id of B
    back = listed.join(told, "pair").select(F.col("chunk").alias("of_chunk"), "place", "count", "best")
    texts = found.where("pairs IS NULL").select("chunk", "id", *COUNTS, "groups", "places", "times")
    added = [T.StructField(n, T.LongType()) for n in ("n_best", "count_sum")]
    schema = T.StructType([texts.schema["id"], *[texts.schema[c] for c in COUNTS], *added, texts.schema["groups"]])

    def run(rows: pa.Table, pairs: pa.Table) -> pa.Table:
        """The counts of a chunk's pairs by place, then sums of them over each text's links."""
        place = pairs.column("place").to_numpy()
        count, best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        count[place], best[place] = pairs.column("count").to_numpy(), pairs.column("best").to_numpy(zero_copy_only=False)
        sums = np.zeros((2, rows.num_rows), np.int64)
        for k, (places, times) in enumerate(zip(rows.column("places"), rows.column("times"), strict=True)):
            at, n = places.values.to_numpy(), times.values.to_numpy()
            sums[:, k] = (best[at] * n).sum(), (count[at] * n).sum()
        out = rows.select(["id", *COUNTS]).append_column("n_best", pa.array(sums[0])).append_column("count_sum", pa.array(sums[1]))
        return out.append_column("groups", rows.column("groups"))

    return texts.groupBy("chunk").cogroup(back.groupBy("of_chunk")).applyInArrow(run, schema).withColumnRenamed("id", id_col)
