"""Removal of repeated substrings through a sparse suffix array, sorted deep-shallow."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelweave.functions.lineage import materialize

#: Bytes of a repeated string, and of the seed at a sampled suffix: every string holds at least one sampled seed.
LENGTH, SEED = 100, 32
#: Depth of the shallow sort behind the seed; contexts of one seed up to which one task sorts them.
SHALLOW, LARGE_GROUP = 16, 20_000
#: A seed of more than one in so many contexts is frequent: there are fewer than this.
HOT = 10_000
#: Bytes hashed at once, and the longest stretch of a document that is sampled at once.
CHUNK, SEGMENT = 1 << 18, 1 << 22
_NULL_ID = (1 << 63) - 1
_ROWS = 20_000


def _mixed(seed: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_BYTES, _ODD = _mixed(1, 256), _mixed(2, 64) | np.uint64(1)


def _doubled(h: np.ndarray, width: int, level: int) -> np.ndarray:
    """Hashes of strings twice as long, from the hashes of all strings of ``width`` bytes."""
    v = h[:-width] * _ODD[2 * level]
    v += h[width:]
    v ^= v >> np.uint64(29)
    v *= _ODD[2 * level + 1]
    v ^= v >> np.uint64(32)
    return v


def sample(data: np.ndarray, ends: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Sampled suffixes of texts that lie end to end in ``data``: text numbers, seed and context hashes, first and last window, anchor.

    A window is a string of ``length`` bytes within a text; its anchor is where the least hashed seed in it starts, the
    leftmost of equals. So equal windows have equal anchors, wherever they are. Each row is one anchor with the run of
    windows that it serves; its context is what those windows cover.
    """
    none = tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.uint64, np.int64, np.int64, np.int64))
    width = length - SEED + 1
    starts = np.concatenate([[0], ends[:-1]])
    if len(data) < max(length, 2 * SEED):
        return none
    h = _BYTES[data]
    for level in range(SEED.bit_length() - 1):
        h = _doubled(h, 1 << level, level)
    twice = _doubled(h, SEED, 10)
    packed = (h & ~np.uint64((1 << 24) - 1)) | np.arange(len(h), dtype=np.uint64)
    blocks = -(-len(packed) // width)
    padded = np.full(blocks * width, ~np.uint64(0))
    padded[: len(packed)] = packed
    table = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(table, axis=1).ravel()
    n = len(data) - length + 1
    anchor = (np.minimum(ahead[:n], behind[width - 1 : width - 1 + n]) & np.uint64((1 << 24) - 1)).astype(np.int64)
    owner = np.repeat(np.arange(len(ends)), ends - starts)[:n]
    inside = np.arange(n) + length <= ends[owner]
    at = np.flatnonzero(inside)
    if not len(at):
        return none
    a, o = anchor[at], owner[at]
    new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (o[1:] != o[:-1]) | (at[1:] != at[:-1] + 1)]))
    first, last = at[new], at[np.append(new[1:], len(at)) - 1]
    a, o = a[new], o[new]
    size, half = last + length - first, 2 * SEED
    context = twice[first]
    for more in (twice[first + (size - half) // 2], twice[first + size - half], (size << 8 | (a - first)).astype(np.uint64)):
        context = (context ^ (context >> np.uint64(31))) * _ODD[40] + more * _ODD[41]
    return o, h[a], context, first - starts[o], last - starts[o], a - starts[o]


def _pack(first: np.ndarray, last: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    return first << 14 | (anchor - first) << 7 | (last - first)


def _unpack(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    first = at >> 14
    return first, first + (at & 127), first + (at >> 7 & 127)


def _anchors(docs: DataFrame, segment: int) -> DataFrame:
    """(seed, context, id, sub, at, again): sampled suffixes; ``again`` tells of an earlier equal context in the same batch."""

    def of_batch(ids: np.ndarray, subs: np.ndarray, texts: list[str | None]) -> Iterator[tuple[np.ndarray, ...]]:
        held, rows, begins, size = [], [], [], 0

        def flush() -> tuple[np.ndarray, ...]:
            data = np.frombuffer(b"".join(held), np.uint8)
            o, seed, context, first, last, anchor = sample(data, np.cumsum([len(x) for x in held]))
            row, begin = np.array(rows, np.int64)[o], np.array(begins, np.int64)[o]
            return seed, context, ids[row], subs[row], _pack(first + begin, last + begin, anchor + begin)

        for k, text in enumerate(texts):
            raw = (text or "").encode()
            for begin in range(0, max(1, len(raw) - LENGTH + 1), segment):
                part = raw[begin : begin + segment + LENGTH - 1]
                if len(part) < LENGTH:
                    continue
                held.append(part)
                rows.append(k)
                begins.append(begin)
                size += len(part)
                if size >= CHUNK:
                    yield flush()
                    held, rows, begins, size = [], [], [], 0
        if held:
            yield flush()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(of_batch(batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_pylist()))
            if not found:
                continue
            seed, context, ids, subs, at = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((at, subs, ids, context, seed))
            seed, context, ids, subs, at = (x[order] for x in (seed, context, ids, subs, at))
            again = np.concatenate([[False], (seed[1:] == seed[:-1]) & (context[1:] == context[:-1])])
            spread = np.where(again, ids.view(np.uint64) * _ODD[50], seed)  # these only pass through
            for k in range(0, len(at), _ROWS):
                part = slice(k, k + _ROWS)
                columns = [spread[part].view(np.int64), context[part].view(np.int64), ids[part], subs[part], at[part], again[part]]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["seed", "context", "id", "sub", "at", "again"])

    return docs.mapInArrow(run, "seed long, context long, id long, sub long, at long, again boolean")


def _shared(anchors: DataFrame) -> DataFrame:
    """(seed, id, sub, at, again) of what is not unique: later equal contexts, and the first ones of seeds with two contexts or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_seed = last_context = None
        waiting: tuple | None = None  # the only context so far of the last seed
        names = ["seed", "id", "sub", "at", "again"]
        for batch in batches:
            seed, context, ids, subs, at = (batch.column(i).to_numpy() for i in range(5))
            passed = batch.column(5).to_numpy(zero_copy_only=False)
            if passed.any():
                yield pa.RecordBatch.from_arrays([pa.array(x[passed]) for x in (seed, ids, subs, at, passed)], names=names)
                seed, context, ids, subs, at = (x[~passed] for x in (seed, context, ids, subs, at))
            if not len(seed):
                continue
            new_seed = np.concatenate([[last_seed is None or seed[0] != last_seed], seed[1:] != seed[:-1]])
            new_context = new_seed | np.concatenate([[context[0] != last_context], context[1:] != context[:-1]])
            second = new_context & ~new_seed
            group = np.cumsum(new_seed)
            many = np.zeros(group[-1] + 1, bool)
            many[group[second]] = True
            if waiting is not None:
                if second[group == 0].any():
                    yield pa.RecordBatch.from_arrays([pa.array([x]) for x in waiting], schema=pa.schema([("seed", pa.int64()), ("id", pa.int64()), ("sub", pa.int64()), ("at", pa.int64()), ("again", pa.bool_())]))
                    waiting = None
                elif group[-1] > 0:
                    waiting = None
            elif group[0] == 0:
                many[0] = True  # the last seed had its second context before
            wanted = ~new_context | (new_context & many[group])
            again = ~new_context
            last_seed, last_context = seed[-1], context[-1]
            start = int(np.flatnonzero(group == group[-1])[0])
            if new_seed[start] and not many[group[-1]]:
                waiting = (int(seed[start]), int(ids[start]), int(subs[start]), int(at[start]), False)
            if wanted.any():
                yield pa.RecordBatch.from_arrays([pa.array(x[wanted]) for x in (seed, ids, subs, at, again)], names=names)

    parts = int(anchors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    together = anchors.repartition(parts, "seed").sortWithinPartitions("seed", "context", "id", "sub", "at")
    return together.mapInArrow(run, "seed long, id long, sub long, at long, again boolean")


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return n - ((int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")).bit_length() + 7) // 8


class BlindTrie:
    """Orders strings that agree for long: inner nodes hold only a depth and the next bytes; one comparison with a leaf settles a place."""

    def __init__(self):
        self.root: int | list | None = None
        self.strings: list[bytes] = []
        self.same: list[list[int]] = []

    def insert(self, s: bytes, tag: int) -> None:
        node = self.root
        if node is None:
            self.root = self._leaf(s, tag)
            return
        while not isinstance(node, int):
            node = node[1].get(s[node[0]] if node[0] < len(s) else -1) or node[2]
            node = node - 1 if isinstance(node, int) else node
        found = self.strings[node]
        depth = _common(s, found)
        if depth == len(s) == len(found):
            self.same[node].append(tag)
            return
        parent, edge, node = None, 0, self.root
        while not isinstance(node, int) and node[0] < depth:
            parent, edge = node, s[node[0]]
            node = node[1][edge]
            node = node - 1 if isinstance(node, int) else node
        own = s[depth] if depth < len(s) else -1
        new = self._leaf(s, tag) + 1  # leaves hang as numbers from 1
        if not isinstance(node, int) and node[0] == depth:
            node[1][own] = new
            return
        held = node + 1 if isinstance(node, int) else node
        other = found[depth] if depth < len(found) else -1
        inner = [depth, {own: new, other: held}, held]
        if parent is None:
            self.root = inner
        else:
            if parent[2] is parent[1][edge]:
                parent[2] = inner
            parent[1][edge] = inner

    def _leaf(self, s: bytes, tag: int) -> int:
        self.strings.append(s)
        self.same.append([tag])
        return len(self.strings) - 1

    def ordered(self) -> tuple[list[int], list[int]]:
        """Tags in order of their strings, and what each string has in common with the one before."""
        tags: list[int] = []
        common: list[int] = []
        stack = [(self.root if not isinstance(self.root, int) else self.root + 1, 0)]
        while stack:
            node, depth = stack.pop()
            if isinstance(node, int):
                same = self.same[node - 1]
                tags += same
                common += [depth] + [len(self.strings[node - 1])] * (len(same) - 1)
                continue
            below = sorted(node[1])
            for k in range(len(below) - 1, -1, -1):
                stack.append((node[1][below[k]], node[0] if k else depth))
        return tags, common


def _multikey(strings: list[bytes], members: list[int]) -> tuple[list[int], list[int]]:
    """Members in order of their strings, and what each has in common with the one before, -1 for the first.

    Ternary partition by the byte at a depth, as quicksort does by the whole key. Parts that still agree at ``SHALLOW`` bytes
    go through a blind trie.
    """
    order: list[int] = []
    common: list[int] = []
    stack = [(members, 0, -1, False)]  # members, bytes they agree in, common with the one before, all equal
    while stack:
        part, depth, before, equal = stack.pop()
        if len(part) == 1 or equal:
            order += part
            common += [before] + [depth] * (len(part) - 1)
            continue
        if depth == SHALLOW:
            trie = BlindTrie()
            for k in part:
                trie.insert(strings[k], k)
            tags, shared = trie.ordered()
            order += tags
            common += [before, *shared[1:]]
            continue
        heads = [strings[k][depth] if depth < len(strings[k]) else -1 for k in part]
        pivot = sorted((heads[0], heads[len(heads) // 2], heads[-1]))[1]
        same = [k for k, h in zip(part, heads, strict=True) if h == pivot]
        if len(same) == len(part):
            if pivot >= 0:  # on to where they part
                first = strings[part[0]]
                depth = min(SHALLOW, *(_common(first, strings[k]) for k in part[1:]))
            stack.append((part, depth, before, pivot < 0))
            continue
        less, more = [k for k, h in zip(part, heads, strict=True) if h < pivot], [k for k, h in zip(part, heads, strict=True) if h > pivot]
        if more:
            stack.append((more, depth, depth, False))
        stack.append((same, depth + (pivot >= 0), depth if less else before, pivot < 0))
        if less:
            stack.append((less, depth, before, False))
    return order, common


def deep_shallow(group: np.ndarray, strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings by group and bytes, and the common length with the one before (-1 where a group begins).

    The strings of a group stand together. Multikey quicksort goes to ``SHALLOW`` bytes; what still agrees there goes through
    blind tries.
    """
    edges = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]])).tolist() if len(group) else []
    order: list[int] = []
    common: list[int] = []
    for a, z in zip(edges, edges[1:], strict=False):
        one, shared = _multikey(strings, list(range(a, z)))
        order += one
        common += shared
    return np.array(order, np.int64), np.array(common, np.int64)


def repeated_windows(group: np.ndarray, left: list[bytes], right: list[bytes], first: np.ndarray, last: np.ndarray, anchor: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Mask by row and by distance of a window's start from the anchor: windows that an earlier row of the group has, too.

    Rows of a group must be in order of document and place. ``left`` is what precedes the anchor, backwards; ``right``
    is what follows the seed. Two rows share the window that starts ``o`` before the anchor if they agree over ``o`` bytes
    to the left and over the rest of ``length`` to the right: classes of either side are cut from the sorted order.
    """
    m, width = len(group), length - SEED + 1
    sides = []
    for strings in (left, right):
        order, common = deep_shallow(group, strings)
        sides.append((order, common))
    out = np.zeros((m, width), bool)
    for o in range(width):
        valid = np.flatnonzero((anchor - o >= first) & (anchor - o <= last))
        if len(valid) < 2:
            continue
        key = np.zeros(m, np.int64)
        for (order, common), least in zip(sides, (o, length - SEED - o), strict=True):
            number = np.empty(m, np.int64)
            number[order] = np.cumsum(common < least)
            key = key * (m + 1) + number
        _, earliest = np.unique(key[valid], return_index=True)
        later = np.ones(len(valid), bool)
        later[earliest] = False
        out[valid[later], o] = True
    return out


def _spans(mask: np.ndarray, anchor: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, begin and end of the bytes that the windows in a mask cover, a run of neighbouring windows at a time."""
    edge = np.diff(np.pad(mask, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, low = np.nonzero(edge == 1)
    high = np.nonzero(edge == -1)[1] - 1
    return row, anchor[row] - high, anchor[row] - low + length


def _contexts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(seed, id, sub, at, large, left, right): the bytes around the wanted anchors, read from their documents."""
    by_doc = wanted.groupBy("id", "sub").agg(F.collect_list(F.struct("seed", "at", "large")).alias("wanted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["seed", "id", "sub", "at", "large", "left", "right"]
        for batch in batches:
            seeds, ids, subs, ats, large, left, right = [], [], [], [], [], [], []

            def out():
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.binary())
                return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip((seeds, ids, subs, ats, large, left, right), kinds, strict=True)], names=names)

            for i, s, text, asked in zip(*[batch.column(k) for k in range(4)], strict=True):
                raw, asked = (text.as_py() or "").encode(), asked.values
                seed, at, big = (asked.field(k).to_numpy(zero_copy_only=False) for k in range(3))
                for q, p, b, f, z, a in zip(seed.tolist(), at.tolist(), big.tolist(), *[x.tolist() for x in _unpack(at)], strict=True):
                    seeds.append(q)
                    ats.append(p)
                    large.append(b)
                    left.append(raw[f:a][::-1])
                    right.append(raw[a + SEED : z + LENGTH])
                ids += [i.as_py()] * len(at)
                subs += [s.as_py()] * len(at)
                if len(seeds) >= _ROWS:
                    yield out()
                    seeds, ids, subs, ats, large, left, right = [], [], [], [], [], [], []
            if seeds:
                yield out()

    joined = docs.join(by_doc, ["id", "sub"]).select("id", "sub", "text", "wanted")
    return joined.mapInArrow(run, "seed long, id long, sub long, at long, large boolean, left binary, right binary")


def _sorted_groups(contexts: DataFrame) -> DataFrame:
    """(id, sub, begin, end): repeated bytes, found by sorting the contexts of each seed, many seeds at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def work(last: bool) -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            seed = table.column("seed").to_numpy()
            cut = len(seed) if last else int(np.flatnonzero(np.concatenate([[True], seed[1:] != seed[:-1]]))[-1])
            held[:] = table.slice(cut).to_batches() if cut < len(seed) else []
            done = table.slice(0, cut)
            first, end, anchor = _unpack(done.column("at").to_numpy())
            mask = repeated_windows(seed[:cut], done.column("left").to_pylist(), done.column("right").to_pylist(), first, end, anchor)
            row, begin, stop = _spans(mask, anchor, LENGTH)
            columns = [done.column("id").to_numpy()[row], done.column("sub").to_numpy()[row], begin, stop]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["id", "sub", "begin", "end"])

        for batch in batches:
            held.append(batch)
            if sum(x.num_rows for x in held) >= 2 * LARGE_GROUP:
                yield work(False)
        if held:
            yield work(True)

    parts = int(contexts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    together = contexts.repartition(parts, "seed").sortWithinPartitions("seed", "id", "sub", "at")
    return together.select("seed", "id", "sub", "at", "left", "right").mapInArrow(run, "id long, sub long, begin long, end long")


def _large_groups(contexts: DataFrame) -> DataFrame:
    """The same for seeds with very many contexts: their windows are grouped by 128-bit hashes, pre-aggregated before the shuffle.

    The first of each class stays; every other window of these contexts is repeated.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for batch in batches:
            ids, subs, at = (batch.column(i).to_numpy() for i in range(3))
            first, last, anchor = _unpack(at)
            for k in range(batch.num_rows):
                left, right = batch.column(3)[k].as_py()[::-1], batch.column(4)[k].as_py()
                whole = left + batch.column(5)[k].as_py().to_bytes(8, "little", signed=True) + right  # the seed by its hash
                size = LENGTH - SEED + 8
                n = int(last[k] - first[k]) + 1
                both = np.frombuffer(b"".join(xxh3_128_digest(whole[j : j + size] + bytes([anchor[k] - first[k] - j])) for j in range(n)), "<i8").reshape(-1, 2)
                columns = [both[:, 0].copy(), both[:, 1].copy(), np.repeat(ids[k], n), np.repeat(subs[k], n), first[k] + np.arange(n)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["high", "low", "id", "sub", "p"])

    windows = contexts.select("id", "sub", "at", "left", "right", "seed").mapInArrow(run, "high long, low long, id long, sub long, p long")
    kept = windows.groupBy("high", "low").agg(F.min(F.struct("id", "sub", "p")).alias("k")).select("k.*").withColumn("keep", F.lit(True))
    first, last = F.shiftright("at", 14), F.shiftright("at", 14) + F.col("at").bitwiseAND(127)
    every = contexts.select("id", "sub", F.explode(F.sequence(first, last)).alias("p"))
    return every.join(kept, ["id", "sub", "p"], "left_anti").select("id", "sub", F.col("p").alias("begin"), (F.col("p") + LENGTH).alias("end"))


def _identified(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """All rows as (id, sub, text), and one for each (id, sub): rows that repeat an id are told apart by ``sub``, the begin of
    their texts' digests, and share it if those are equal."""
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID)).alias("id"), F.col(text_col).cast("string").alias("text"))
    if rows.groupBy("id").count().where("count > 1").limit(1).count():
        digest = F.conv(F.substring(F.sha2(F.coalesce("text", F.lit("")), 256), 1, 15), 16, 10).cast("long")  # its first 60 bits, in order
        told = rows.select("id", digest.alias("sub"), "text")
        return told, told.dropDuplicates(["id", "sub"])
    plain = rows.select("id", F.lit(0).cast("long").alias("sub"), "text")
    return plain, plain


def _by_size(several: DataFrame, large_group: int) -> DataFrame:
    """``several`` with ``large``: whether a seed has more contexts than one task sorts."""
    sizes = materialize(several.groupBy("seed").agg(F.count("*").alias("n")).where(F.col("n") > large_group), "large-seeds")
    if sizes.isEmpty():
        return several.withColumn("large", F.lit(False))
    hot = F.broadcast(sizes.where(F.col("n") * HOT > several.count()).select("seed"))  # under HOT rows
    rest = several.join(hot, "seed", "left_anti").join(sizes.select("seed", F.lit(True).alias("large")), "seed", "left")
    every = several.join(hot, "seed").withColumn("large", F.lit(True)).unionByName(rest)
    return every.withColumn("large", F.coalesce("large", F.lit(False)))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", large_group: int = LARGE_GROUP, segment: int = SEGMENT) -> DataFrame:
    """``(id_col, n_bytes, n_removed, n_spans, spans, kept)`` for each row of ``docs``.

    A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier: in a document of smaller id, or
    earlier in the same one; overlaps count, and strings are judged on the input. Texts are taken as UTF-8, null as
    empty, and matches never cross documents. ``spans`` are the maximal removed runs (begin, end), ``kept`` the
    remaining bytes. A null id counts as the largest. Rows that repeat an id are documents in the order of the first 60
    bits of their texts' digests; those with equal texts, too, get equal results. Other columns are not read.

    Suffixes are sampled at anchors that depend on nothing but the windows around them. Those whose seed and context are
    unique end there. Of equal contexts the first stays; seeds with several contexts are sorted deep-shallow.
    """
    kind = docs.schema[id_col].dataType
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    plain, unique = _identified(docs, id_col, text_col)
    shared = materialize(_shared(_anchors(unique, segment)), "shared-anchors")
    several = shared.where("NOT again")
    wanted = _by_size(several, large_group).select("seed", "id", "sub", "at", "large")
    contexts = materialize(_contexts(unique.repartition(parts, "id", "sub"), wanted), "contexts")
    whole = shared.where("again").select("id", "sub", F.shiftright("at", 14).alias("begin"), (F.shiftright("at", 14) + F.col("at").bitwiseAND(127) + LENGTH).alias("end"))
    found = _sorted_groups(contexts.where("NOT large")).unionByName(_large_groups(contexts.where("large"))).unionByName(whole)
    spans = found.groupBy("id", "sub").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))
    schema = T.StructType.fromDDL("id long, n_bytes long, n_removed long, n_spans long, spans array<struct<begin:long,end:long>>, kept binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 4 + [pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])), pa.binary()]
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                rows = []
                for i, text, spans in zip(*[batch.slice(k, 1000).column(c) for c in range(3)], strict=True):
                    raw = (text.as_py() or "").encode()
                    runs: list[list[int]] = []
                    if spans.is_valid:
                        begin, end = (spans.values.field(c).to_numpy() for c in range(2))
                        for b, e in sorted(set(zip(begin.tolist(), end.tolist(), strict=True))):
                            if runs and b <= runs[-1][1]:
                                runs[-1][1] = max(runs[-1][1], e)
                            else:
                                runs.append([b, e])
                    edges = [0, *[x for r in runs for x in r], len(raw)]
                    kept = b"".join(raw[edges[j] : edges[j + 1]] for j in range(0, len(edges), 2))
                    rows.append((i.as_py(), len(raw), len(raw) - len(kept), len(runs), [{"begin": b, "end": e} for b, e in runs], kept))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=schema.names)

    out = plain.repartition(parts, "id", "sub").join(spans, ["id", "sub"], "left").select("id", "text", "spans").mapInArrow(run, schema)
    return out.select(F.when(F.col("id") != _NULL_ID, F.col("id")).cast(kind).alias(id_col), "n_bytes", "n_removed", "n_spans", "spans", "kept")


#: The same by every string of ``LENGTH`` bytes, without sampling or sorting of suffixes.
ORACLE_SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER (ORDER BY doc_id NULLS LAST, sha256(coalesce(text, ''))) AS r, doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
windows AS (SELECT r, p, array_slice(b, p, p + {LENGTH - 1}) AS s FROM (SELECT r, b, unnest(range(1, n - {LENGTH - 2})) AS p FROM d)),
later AS MATERIALIZED (SELECT r, p FROM windows QUALIFY row_number() OVER (PARTITION BY s ORDER BY r, p) > 1),
breaks AS (SELECT r, p, coalesce(p > lag(p) OVER (PARTITION BY r ORDER BY p) + {LENGTH}, true)::INT AS new FROM later),
numbered AS (SELECT r, p, sum(new) OVER (PARTITION BY r ORDER BY p) AS k FROM breaks),
spans AS MATERIALIZED (SELECT r, min(p) AS begin, max(p) + {LENGTH} AS stop FROM numbered GROUP BY r, k),
pieces AS (SELECT r, coalesce(lag(stop) OVER (PARTITION BY r ORDER BY begin), 1) AS x, begin - 1 AS y FROM spans
    UNION ALL SELECT d.r, coalesce(max(stop), 1), any_value(n) FROM d LEFT JOIN spans ON d.r = spans.r GROUP BY d.r),
kept AS (SELECT r, sha256(unhex(string_agg(hex(array_slice(b, x, y)), '' ORDER BY x))) AS kept_sha256 FROM pieces JOIN d USING (r) WHERE x <= y GROUP BY r),
removed AS (SELECT r, sum(stop - begin) AS n_removed, count(*) AS n_spans FROM spans GROUP BY r)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans, coalesce(kept_sha256, sha256('')) AS kept_sha256
FROM d LEFT JOIN kept USING (r) LEFT JOIN removed USING (r)"""
