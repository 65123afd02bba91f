"""SimHash fingerprints and their near-duplicate classes by Gray-ordered hierarchical indexes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.functions.graph import connected_components
from panelweave.functions.lineage import materialize

HASH_SEED = 42
#: Fingerprints in a leaf of the index, and children of an upper node.
LEAF, FAN = 32, 8
#: Comparisons made at once, fingerprints worked on at once, and those of one pattern from which its root is split further.
PAIRS, ROWS, SPLIT = 1 << 19, 100_000, 50_000
#: A fingerprint, or a pattern, of more than one in so many rows is treated apart: there are fewer than this.
HOT = 10_000
#: The 64 bits in four blocks of 16, and each block's remaining 48 bits in four parts of 12.
BLOCKS = [range(16 * b, 16 * b + 16) for b in range(4)]
_NULL_ID = (1 << 63) - 1


def root_masks() -> list[int]:
    """Bit masks such that any two fingerprints that differ in three bits or fewer agree under at least one.

    Three differences leave one of four blocks untouched, and one of the four parts of what is beside that block.
    """
    masks = []
    for block in BLOCKS:
        rest = [i for i in range(64) if i not in block]
        masks += [sum(1 << i for i in [*block, *rest[12 * k : 12 * k + 12]]) for k in range(4)]
    return masks


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """``(id_col, fp long)``: SimHash over the XXH64 of word shingles, repeats included, A-Z lower-cased.

    With fewer words than a shingle takes, the whole sequence is the only shingle; null, empty and wordless texts get
    zero. One row for each row of ``docs``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        space = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")

        def one(text: str | None) -> int:
            found = [w for w in text.encode().lower().translate(space).split(b" ") if w] if text else []
            if not found:
                return 0
            joined, n = b" ".join(found), len(found)
            if n <= words:
                return xxh64_intdigest(joined, HASH_SEED)
            ends = np.cumsum(np.fromiter(map(len, found), np.int64, n) + 1) - 1
            starts = np.concatenate([[0], ends[:-1] + 1])
            spans = zip(starts[: n - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)
            hashes = np.fromiter((xxh64_intdigest(joined[a:b], HASH_SEED) for a, b in spans), np.uint64, n - words + 1)
            ones = np.zeros(64, np.int64)
            for k in range(0, len(hashes), 1 << 16):
                part = hashes[k : k + (1 << 16)]
                ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            return int((np.uint64(1) << np.flatnonzero(2 * ones > len(hashes)).astype(np.uint64)).sum(dtype=np.uint64))

        for batch in batches:
            fps = np.array([one(x.as_py()) for x in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, fp long").withColumnRenamed("id", id_col)


def _product(a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of members of the ranges that start at ``a`` and ``b``, a range pair at a time."""
    sizes = n_a * n_b
    of = np.repeat(np.arange(len(a)), sizes)
    k = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return a[of] + k // n_b[of], b[of] + k % n_b[of]


def _blocks(costs: np.ndarray) -> list[slice]:
    """Stretches of neighbouring items, of a cost of about ``PAIRS`` each."""
    edges = np.flatnonzero(np.diff(np.cumsum(costs) // PAIRS)) + 1
    return [slice(a, b) for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(costs)], strict=True) if b > a]


class GrayIndex:
    """Hierarchies over runs of fingerprints in Gray order: a node holds the bits that all below it share, as mask and pattern.

    ``run`` numbers the run of each fingerprint. Nodes do not cross runs. A run of one leaf is its own top, and a pair of
    nodes falls away, with all below it, once the bits that both share differ in more than ``most``.
    """

    def __init__(self, fps: np.ndarray, run: np.ndarray):
        self.fps = fps
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []  # mask, pattern, first child, children
        mask, pattern, width = np.full(len(fps), ~np.uint64(0)), fps, LEAF
        while True:
            new = np.concatenate([[True], run[1:] != run[:-1]])
            place = np.arange(len(run)) - np.flatnonzero(new)[np.cumsum(new) - 1]
            starts = np.flatnonzero(place % width == 0)
            ones, zeros = np.bitwise_and.reduceat(pattern & mask, starts), np.bitwise_and.reduceat(~pattern & mask, starts)
            self.levels.append((ones | zeros, ones, starts, np.diff(np.append(starts, len(run)))))
            mask, pattern, run, width = ones | zeros, ones, run[starts], FAN
            if len(run) < 2 or (run[1:] != run[:-1]).all():
                return

    def leaf_pairs(self, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of leaves that may hold fingerprints at ``most`` bits or fewer, many at once."""
        top = len(self.levels) - 1
        every = np.arange(len(self.levels[top][0]))
        stack = [(top, every, every)]
        while stack:
            level, a, b = stack.pop()
            mask, pattern, child, n = self.levels[level]
            near = np.bitwise_count((pattern[a] ^ pattern[b]) & mask[a] & mask[b]) <= most
            a, b = a[near], b[near]
            if not level:
                yield a, b
                continue
            for part in _blocks(n[a] * n[b]):
                x, y = _product(child[a[part]], n[a[part]], child[b[part]], n[b[part]])
                stack.append((level - 1, x[x <= y], y[x <= y]))

    def links(self, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Edges of a spanning forest of the links within ``most`` bits: fewer than the fingerprints."""
        fps, (_, _, first, size) = self.fps, self.levels[0]
        label, ends = np.arange(len(fps)), [np.zeros((0, 2), np.int64)]

        def compare(a: np.ndarray, b: np.ndarray) -> None:
            nonlocal label
            x, y = _product(first[a], size[a], first[b], size[b])
            near = (x < y) & (np.bitwise_count(fps[x] ^ fps[y]) <= most)
            x, y = x[near], y[near]
            while len(x := x[open_ := label[x] != label[y]]):
                y = y[open_]
                high, low = np.maximum(label[x], label[y]), np.minimum(label[x], label[y])
                root, at = np.unique(high, return_index=True)  # each tree hangs on one smaller tree: no cycle
                ends.append(np.stack([x[at], y[at]], axis=1))
                above = np.arange(len(fps))
                above[root] = low[at]
                while (above != above[above]).any():
                    above = above[above]
                label = above[label]

        several = np.flatnonzero(size > 1)
        for part in _blocks(size[several] ** 2):
            compare(several[part], several[part])
        for a, b in self.leaf_pairs(most):
            a, b = a[a != b], b[a != b]
            for part in _blocks(size[a] * size[b]):
                least, greatest = np.minimum.reduceat(label, first), np.maximum.reduceat(label, first)
                x, y = a[part], b[part]
                apart = ~((least[x] == greatest[x]) & (least[y] == greatest[y]) & (least[x] == least[y]))  # not within one tree
                compare(x[apart], y[apart])
        pairs = np.concatenate(ends)
        return fps[pairs[:, 0]], fps[pairs[:, 1]]


def _gray_rank(fp: Column) -> Column:
    """The place of a fingerprint in the Gray sequence: each bit is the parity of those from it upwards."""
    for s in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, s))
    return fp


def _bits(masks: list[int]) -> list[int]:
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _split_masks() -> list[list[int]]:
    """For each root, four parts of the 36 bits beside its mask: three differences leave one of them untouched."""
    out = []
    for mask in root_masks():
        rest = [i for i in range(64) if not mask >> i & 1]
        out.append(_bits([mask | sum(1 << i for i in rest[9 * k : 9 * k + 9]) for k in range(4)]))
    return out


def fingerprint_links(fps: DataFrame, most: int = 3, split: int = SPLIT) -> DataFrame:
    """``(a, b)``: links between distinct fingerprints ``fp`` that connect all within ``most`` (0 to 3) differing bits.

    The upper nodes of the hierarchy are bit masks: each fingerprint goes to 16 roots, one for each mask of
    :func:`root_masks`, and under a root to the node of its masked pattern. A pattern of more than ``split`` fingerprints, and
    of more than one in ``HOT``, is factored once more by four longer masks. Below, nodes are factored from the Gray
    order within a task. All together cover every link; what comes back connects the same classes and is at most a
    spanning forest for each node, so that dense groups do not turn into all their pairs.
    """
    if not 0 <= most <= 3:
        raise ValueError("the masks hold for 0 to 3 differing bits")
    under = [F.struct(F.lit(i).alias("root"), F.col("fp").bitwiseAND(F.lit(m)).alias("pattern")) for i, m in enumerate(_bits(root_masks()))]
    rows = fps.select("fp", F.explode(F.array(*under)).alias("r")).select("fp", "r.root", "r.pattern")
    n = fps.count()
    crowded = rows.groupBy("root", "pattern").count().where((F.col("count") > split) & (F.col("count") * HOT > n)).select("root", "pattern")
    crowded = F.broadcast(materialize(crowded, "crowded-patterns"))  # under 16 HOT rows
    longer = F.element_at(F.array(*[F.array(*map(F.lit, four)) for four in _split_masks()]), F.col("root") + 1)
    deeper = rows.join(crowded, ["root", "pattern"]).select("fp", "root", F.posexplode(longer).alias("k", "mask"))
    deeper = deeper.select("fp", (16 + 4 * F.col("root") + F.col("k")).alias("root"), F.col("fp").bitwiseAND(F.col("mask")).alias("pattern"))
    nodes = rows.join(crowded, ["root", "pattern"], "left_anti").select("fp", "root", "pattern").unionByName(deeper)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        enough = ROWS

        def flush(last: bool):
            nonlocal enough
            root, pattern, fp = (np.concatenate(x) for x in zip(*held, strict=True))
            edge = np.concatenate([[True], (root[1:] != root[:-1]) | (pattern[1:] != pattern[:-1])])
            cut = len(fp) if last else int(np.flatnonzero(edge)[-1])
            held[:] = [(root[cut:], pattern[cut:], fp[cut:])]
            enough = max(ROWS, 2 * (len(fp) - cut))  # a run that goes on is looked at again when it has doubled
            run_of = np.cumsum(edge)[:cut]
            more = np.bincount(run_of)[run_of] > 1 if cut else np.zeros(0, bool)  # alone there is nothing to link
            a, b = GrayIndex(fp[:cut][more], run_of[more]).links(most) if more.any() else (fp[:0], fp[:0])
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            held.append((batch.column(1).to_numpy(), batch.column(2).to_numpy(), batch.column(0).to_numpy().view(np.uint64)))
            if sum(len(x[2]) for x in held) >= enough:
                yield flush(False)
        if held:
            yield flush(True)

    parts = fps.sparkSession.conf.get("spark.sql.shuffle.partitions")
    ranked = nodes.withColumn("gray", _gray_rank(F.col("fp")))
    together = ranked.repartition(int(parts), "root", "pattern").sortWithinPartitions("root", "pattern", "gray")
    return together.select("fp", "root", "pattern").mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, most: int = 3) -> DataFrame:
    """``(id_col, fingerprint, component_id)`` for each row of ``docs``.

    Two documents are linked when their fingerprints differ in ``most`` bits or fewer; ``component_id`` is the smallest
    id reachable over links. Copies share a fingerprint and are linked through it once, not pair by pair. A null id
    counts as the largest and comes back as null if nothing smaller is linked; rows with one id are each returned.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    prints = materialize(
        fingerprints(docs, id_col, text_col, words).select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID)).alias("id"), "fp"), "fingerprints"
    )
    nodes = materialize(prints.groupBy("fp").agg(F.min("id").alias("first"), F.count("*").alias("n")), "distinct-fingerprints")
    joined = connected_components(fingerprint_links(nodes.select("fp"), most), "a", "b")
    least = joined.join(nodes, F.col("node") == F.col("fp")).groupBy("component").agg(F.min("first").alias("least"))
    moved = joined.join(least, "component").select(F.col("node").alias("fp"), "least")
    homes = materialize(nodes.join(moved, "fp", "left").select("fp", F.coalesce("least", "first").alias("home"), "n"), "homes")

    # documents of a frequent fingerprint do not travel: such fingerprints are fewer than HOT, the others' groups are small
    hot = F.broadcast(homes.where(F.col("n") * HOT > prints.count()).select("fp", "home"))
    rest = prints.join(hot, "fp", "left_anti").join(homes.select("fp", "home"), "fp")
    placed = prints.join(hot, "fp").select("id", "fp", "home").unionByName(rest.select("id", "fp", "home"))

    def back(c: str):
        return F.when(F.col(c) != _NULL_ID, F.col(c)).cast(kind)

    return placed.select(back("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), back("home").alias("component_id"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, most: int = 3) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its class; columns as given."""
    classes = near_duplicates(docs, id_col, text_col, words, most)
    firsts = classes.where(F.col("component_id").eqNullSafe(F.col(id_col))).select(F.col(id_col).alias("_first")).distinct()
    return docs.join(firsts, docs[id_col].eqNullSafe(firsts["_first"]), "left_semi")
