"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.functions.lineage import materialize

#: Up to so many sources, and numbers of 8 bytes in their tables, these are broadcast; beyond, joined over salted keys.
BROADCAST_SOURCES, BROADCAST_NUMBERS, SALTS = 10_000, 2_000_000, 64
#: Copies of a row that one task makes in a row.
COPY_BLOCK = 1024
#: Names of the columns that replication adds.
ADDED = ["rate", "n_copies", "copy_no", "shuffle_key"]


def _bits(hex_digits: int, *parts: Column) -> Column:
    """The first digits of an MD5 over the parts, as a long."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, hex_digits), 16, 10).cast("long")


def _cdfs(rates: DataFrame) -> DataFrame:
    """``(source, rate, _least, _cdf)``: P(X <= k) of a Poisson variable for k = _least, _least + 1, ...

    What lies below and beyond is under the resolution of a double. Terms come from running sums of logarithms over a
    row for each k, so the work for a source grows with the root of its rate.
    """
    rate, k = F.col("rate"), F.col("_k")
    reach = 12 * F.sqrt(rate) + 30
    ks = F.when(rate > 0, F.sequence(F.greatest(F.lit(0).cast("long"), F.floor(rate - reach)), F.ceil(rate + reach))).otherwise(F.array(F.lit(0).cast("long")))
    by_k = Window.partitionBy("source").orderBy("_k")
    rows = rates.withColumn("_k", F.explode(ks)).withColumn("_least", F.min("_k").over(Window.partitionBy("source")))
    ratios = rows.withColumn("_log", F.sum(F.when(k > F.col("_least"), F.log(rate / k)).otherwise(0.0)).over(by_k))
    whole = Window.partitionBy("source")
    mass = ratios.withColumn("_p", F.exp(F.col("_log") - F.max("_log").over(whole))).withColumn("_sum", F.sum("_p").over(by_k))
    held = mass.groupBy("source", "rate", "_least").agg(F.array_sort(F.collect_list("_sum")).alias("_sums"))
    return held.select("source", "rate", "_least", F.transform("_sums", lambda x: x / F.array_max("_sums")).alias("_cdf"))


def source_rates(docs: DataFrame, weights: DataFrame | None = None, target_rows: int | None = None, source_col: str = "source") -> DataFrame:
    """``(source, n_rows, rate)``: mean copies of a row of each source so that sources meet their weights.

    ``weights`` has (source, weight >= 0), null or absent for a source meaning zero; without it all sources weigh the
    same. ``target_rows`` is the expected total, by default the rows there are. A null source is a source of its own.
    """
    counts = docs.groupBy(F.col(source_col).alias("source")).agg(F.count("*").alias("n_rows"))
    if weights is None:
        weighed = counts.withColumn("weight", F.lit(1.0))
    else:
        given = weights.groupBy(F.col("source").alias("_source")).agg(F.sum(F.col("weight").cast("double")).alias("weight"))
        weighed = counts.join(given, F.col("source").eqNullSafe(F.col("_source")), "left").select("source", "n_rows", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    weighed = materialize(weighed, "sources")
    sums = weighed.agg(F.sum("weight").alias("w"), F.sum("n_rows").alias("n")).first()
    total = float(target_rows if target_rows is not None else sums.n or 0)
    return weighed.select("source", "n_rows", (F.col("weight") * total / (F.lit(float(sums.w or 1.0)) * F.col("n_rows"))).alias("rate"))


def replicate(
    docs: DataFrame, weights: DataFrame | None = None, target_rows: int | None = None, seed: int = 0, id_col: str = "doc_id", source_col: str = "source"
) -> DataFrame:
    """Rows of ``docs`` repeated a Poisson number of times, in a global random order, with the columns ``ADDED``.

    The number of copies of a row inverts the Poisson distribution of its source's rate at a uniform number hashed from
    ``seed`` and the id: the same in every run, and monotone in the rate. Rows with zero copies go. ``copy_no`` counts
    from 1. Rows that repeat an id, null included, get the same number of copies each. Input columns named as an added
    one are replaced. The order is by ``shuffle_key``, hashed from seed, id and copy: rows are dealt to partitions by
    it and sorted within.
    """
    plain = docs.drop(*ADDED)
    rates = materialize(_cdfs(source_rates(docs, weights, target_rows, source_col).select("source", "rate")).withColumnRenamed("source", "_source"), "rates")
    own = [f"c{k}" for k in range(len(plain.columns))]  # by place, so that names cannot clash
    rows = plain.toDF(*own)
    an_id, source = (F.col(own[plain.columns.index(c)]) for c in (id_col, source_col))
    same = source.eqNullSafe(F.col("_source"))
    tables = rates.agg(F.count("*").alias("n"), F.sum(F.size("_cdf")).alias("numbers"), F.max(F.col("_least") + F.size("_cdf")).alias("most")).first()
    if tables.n <= BROADCAST_SOURCES and (tables.numbers or 0) <= BROADCAST_NUMBERS:
        rated = rows.join(F.broadcast(rates), same)
    else:
        salted = rates.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
        rated = rows.join(salted, same & (F.pmod(F.xxhash64(an_id), F.lit(SALTS)).cast("int") == F.col("_salt"))).drop("_salt")
    uniform = _bits(13, F.lit(seed), an_id) / F.lit(float(1 << 52))
    drawn = rated.withColumn("_u", uniform).withColumn("n_copies", F.col("_least") + F.size(F.filter("_cdf", lambda c: c <= F.col("_u"))))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    many = drawn.where("n_copies > 0").select(*own, "rate", "n_copies")
    first = F.lit(1).cast("long")
    if (tables.most or 0) > COPY_BLOCK:  # so many copies are dealt to tasks by blocks before they are made
        blocks = many.withColumn("_block", F.explode(F.sequence(first * 0, F.expr(f"(n_copies - 1) div {COPY_BLOCK}"))))
        many = blocks.repartition(parts, an_id, "_block")
        first = F.col("_block") * COPY_BLOCK + 1
        last = F.least(F.col("n_copies"), first + (COPY_BLOCK - 1))
    else:
        last = F.col("n_copies")
    copies = many.select(*own, "rate", "n_copies", F.explode(F.sequence(first, last)).alias("copy_no"))
    keyed = copies.withColumn("shuffle_key", _bits(15, F.lit(seed), an_id, F.col("copy_no")))
    return keyed.repartition(parts, "shuffle_key").sortWithinPartitions("shuffle_key").toDF(*plain.columns, *ADDED)


ORACLE_SQL = """
WITH s AS (SELECT source, count(*) AS n FROM documents GROUP BY 1),
r AS (SELECT source, (SELECT sum(n) FROM s)::DOUBLE / ((SELECT count(*) FROM s)::DOUBLE * n) AS rate FROM s),
m AS (SELECT source, rate, k, exp(k * ln(rate) - rate - lgamma(k + 1)) AS p FROM r, (SELECT unnest(range(0, (SELECT ceil(max(rate) + 12 * sqrt(max(rate)) + 30)::BIGINT + 1 FROM r))) AS k) WHERE k <= ceil(rate + 12 * sqrt(rate) + 30)),
c AS (SELECT source, rate, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS cdf FROM m),
u AS (SELECT doc_id, source, ('0x' || substr(md5('0:' || doc_id), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM documents),
n AS (SELECT u.doc_id, u.source, c.rate, count(*) FILTER (c.cdf <= u.u) AS n_copies FROM u JOIN c ON u.source IS NOT DISTINCT FROM c.source GROUP BY ALL)
SELECT doc_id, source, round(rate, 9) AS rate, n_copies, copy_no, ('0x' || substr(md5('0:' || doc_id || ':' || copy_no), 1, 15))::BIGINT AS shuffle_key
FROM (SELECT *, unnest(range(1, n_copies + 1)) AS copy_no FROM n WHERE n_copies > 0)
"""
