"""Event synchronization between pairs of nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.config import MIN_EVENTS

#: Events of one time bucket that a block of nodes holds, about, and nodes of a block of the list of all pairs.
BLOCK_EVENTS, BLOCK_NODES = 2000, 2000


def valid_counts(onsets: DataFrame, by: tuple[str, ...] = (), least: int = MIN_EVENTS) -> DataFrame:
    """(by, node_id, n) of nodes with at least ``least`` events."""
    return onsets.groupBy(*by, "node_id").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def _block(node: str, blocks: int, most: int) -> Column:
    """Number of the block of a node: ranges of node numbers, so that i < j never lies in a later block than j."""
    return F.least(F.lit(blocks - 1), F.floor(F.col(node) * F.lit(blocks) / F.lit(most + 1))).cast("int")


def _dealt(left: DataFrame, right: DataFrame, blocks: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with the numbers (_p, _q) of the pairs of blocks p <= q that they take part in: ``left`` as i, ``right`` as j."""
    a, b = left.withColumn("_p", _block("i", blocks, most)), right.withColumn("_q", _block("j", blocks, most))
    return a.withColumn("_q", F.explode(F.sequence(F.col("_p"), F.lit(blocks - 1)))), b.withColumn("_p", F.explode(F.sequence(F.lit(0), F.col("_q"))))


def node_pairs(counts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, i, j, ni, nj) for i < j: the table of results itself is this large."""
    size = counts.groupBy(*by).agg(F.count("*").alias("n"), F.max("node_id").alias("top")).agg(F.max("n").alias("n"), F.max("top").alias("top")).first()
    a, b = counts.select(*by, F.col("node_id").alias("i"), F.col("n").alias("ni")), counts.select(*by, F.col("node_id").alias("j"), F.col("n").alias("nj"))
    a, b = _dealt(a, b, max(1, -(-(size.n or 0) // BLOCK_NODES)), size.top or 0)
    return a.join(b, [*by, "_p", "_q"]).where("i < j").select(*by, "i", "j", "ni", "nj")


def near_pairs(left: DataFrame, right: DataFrame, keys: tuple[str, ...], width: Column) -> DataFrame:
    """Rows of ``left`` (keys, ta, ...) and ``right`` (keys, tb, ...) with |ta - tb| < width, as an equi-join over time buckets.

    Buckets are ``width`` wide, so what is nearer is in the same or a neighbouring bucket; ``left`` goes to three.
    """
    a = left.withColumn("_b", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda k: F.floor(F.col("ta") / width) + k)))
    b = right.withColumn("_b", F.floor(F.col("tb") / width))
    return a.join(b, [*keys, "_b"]).where(F.abs(F.col("ta") - F.col("tb")) < width).drop("_b")


def doubled_counts(onsets: DataFrame, tau: int | Column, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, [tau], i, j, jj_j2i, jj_i2j) for pairs i < j of valid nodes with any synchronization; twice the counts, as whole numbers.

    Over events but the first of each node: equal days count a half both ways, and an event within less than ``tau``
    days after one of the other node counts one for the direction from that other. ``tau`` is a number of days, or an
    expression over columns of ``by`` that gives an array of them; then events are joined once, within the largest, the pairs'
    lags are counted by the least tau that they are within, and each tau's counts are sums of those up to it.
    """
    single = isinstance(tau, int)
    taus = F.array(F.lit(tau)) if single else F.array_sort(tau.cast("array<int>"))
    valid = valid_counts(onsets, by).select(*by, "node_id")
    later = onsets.where("seq >= 2").join(valid, [*by, "node_id"], "left_semi")
    later = later.select(*by, "node_id", "start_t", taus.alias("_taus"))
    width = F.array_max("_taus")
    held = later.groupBy(*by, F.floor(F.col("start_t") / width).alias("_b")).agg(F.count("*").alias("n"), F.max("node_id").alias("top"))
    size = held.agg(F.max("n").alias("n"), F.max("top").alias("top")).first()  # of the fullest time bucket
    a, b = later.withColumnsRenamed({"node_id": "i", "start_t": "ta"}), later.drop("_taus").withColumnsRenamed({"node_id": "j", "start_t": "tb"})
    a, b = _dealt(a, b.withColumn("_width", F.array_max(taus)), max(1, -(-(size.n or 0) // BLOCK_EVENTS)), size.top or 0)
    near = near_pairs(a.withColumn("_width", width), b, (*by, "_p", "_q", "_width"), F.col("_width")).where("i < j")
    d = F.col("ta") - F.col("tb")
    ahead, behind = F.sum(F.when(d == 0, 1).when(d > 0, 2).otherwise(0)), F.sum(F.when(d == 0, 1).when(d < 0, 2).otherwise(0))
    if single:
        return near.groupBy(*by, "i", "j").agg(ahead.alias("jj_j2i"), behind.alias("jj_i2j"))
    place = F.size(F.filter("_taus", lambda t: t <= F.abs(d)))  # of the least tau that the lag is within
    bins = near.groupBy(*by, "i", "j", "_taus", place.alias("_bin")).agg(ahead.alias("ahead"), behind.alias("behind"))
    found = bins.groupBy(*by, "i", "j", "_taus").agg(F.collect_list(F.struct("_bin", "ahead", "behind")).alias("_bins"))
    each = found.select(*by, "i", "j", "_bins", F.posexplode("_taus").alias("_k", "tau"))
    upto = lambda side: F.aggregate("_bins", F.lit(0).cast("long"), lambda s, x: s + F.when(x["_bin"] <= F.col("_k"), x[side]).otherwise(0))
    read = each.select(*by, "tau", "i", "j", upto("ahead").alias("jj_j2i"), upto("behind").alias("jj_i2j"))
    return read.where("jj_j2i > 0 OR jj_i2j > 0")


def _halved(c: str) -> Column:
    return (F.coalesce(F.col(c), F.lit(0)) / 2).alias(c[1:])


def met_pairs(onsets: DataFrame, tau: int | Column, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, [tau], i, j, ni, nj, j_j2i, j_i2j) of the pairs of valid nodes with any synchronization: all that can be significant.

    ``tau`` as in :func:`doubled_counts`.
    """
    counts = valid_counts(onsets, by)
    found = doubled_counts(onsets, tau, by)
    own = [*by] if isinstance(tau, int) else [*by, "tau"]
    found = found.join(counts.withColumnsRenamed({"node_id": "i", "n": "ni"}), [*by, "i"]).join(counts.withColumnsRenamed({"node_id": "j", "n": "nj"}), [*by, "j"])
    return found.select(*own, "i", "j", "ni", "nj", _halved("jj_j2i"), _halved("jj_i2j"))


def sync_pairs(onsets: DataFrame, tau: int, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, i, j, ni, nj, j_j2i, j_i2j) for every pair of valid nodes, zeros included."""
    found = doubled_counts(onsets, tau, by)
    pairs = node_pairs(valid_counts(onsets, by), by)
    return pairs.join(found, [*by, "i", "j"], "left").select(*by, "i", "j", "ni", "nj", _halved("jj_j2i"), _halved("jj_i2j"))


def strength(pairs: DataFrame) -> DataFrame:
    """``pairs`` with strength Q and asymmetry q: sum and difference of the counts over the root of the product of event numbers."""
    root = F.sqrt(F.col("ni").cast("double") * F.col("nj"))
    return pairs.withColumn("q_strength", (F.col("j_j2i") + F.col("j_i2j")) / root).withColumn("q_asym", (F.col("j_j2i") - F.col("j_i2j")) / root)
