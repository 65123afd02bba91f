"""Quality rules: robust multivariate outliers among text statistics, by minimum covariance determinant."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.functions.expr import let
from panelweave.functions.lineage import materialize

BLANKS = "[\\x20\\x09-\\x0D]"
SYMBOLS = "[#*$%&|<>]"
WINDOW = 5
#: The transformed statistics, and the standard deviation that is added to each so that a constant one has a tolerance.
VECTOR = {"v_length": 0.02, "v_symbols": 0.25, "v_marks": 0.25, "v_distinct": 0.02, "v_lines": 0.5}
#: Share of a group's rows that the subset holds, concentration steps at most, and the chi-square probability kept.
SUBSET, MAX_STEPS, KEPT_PROBABILITY = 0.75, 12, 0.99999
#: The added variance of a group of n rows is 1 + PRIOR_ROWS / n times that of ``VECTOR``: wide while little is known.
PRIOR_ROWS = 60
#: Bins of the logarithm of squared distances, a unit; groups up to which their estimates are broadcast, else salted.
BINS, BROADCAST_GROUPS, SALTS = 64, 10_000, 64


def word_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *keep: str) -> DataFrame:
    """``(id, kept columns, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_distinct, n_marks, n_lines)``.

    Words are runs without blanks; null texts have none. ``n_repeat_words`` counts words inside five-word windows that
    occur twice or more in the text, by 64-bit hashes of the windows.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    split = docs.select(
        F.col(id_col).alias("id"),
        *[F.col(c) for c in keep],
        F.array_remove(F.split(text, f"{BLANKS}+"), "").alias("_words"),
        F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\x0c\r"))) > 0).alias("_lines"),
        (F.length(text) - F.length(F.regexp_replace(text, f"{SYMBOLS}+", ""))).cast("long").alias("n_symbols"),
        (F.length(text) - F.length(F.regexp_replace(text, "[!?]+", ""))).cast("long").alias("n_marks"),
    )
    words = F.col("_words")
    starts = F.when(F.size(words) >= WINDOW, F.sequence(F.lit(0), F.size(words) - WINDOW)).otherwise(F.array().cast("array<int>"))
    windows = F.transform(starts, lambda i: F.xxhash64(*[F.get("_words", i + k) for k in range(WINDOW)]))
    counted = split.select(
        "id",
        *keep,
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        let(windows, _covered).alias("n_repeat_words"),
        F.size(F.array_distinct("_words")).cast("long").alias("n_distinct"),
        "n_marks",
        F.size("_lines").cast("long").alias("n_lines"),
    )
    return counted


def _covered(windows: Column) -> Column:
    """Words inside windows whose hash occurs twice or more: sort hashes with positions, keep those with an equal neighbour."""

    def of_sorted(pairs: Column) -> Column:
        def twice(x: Column, i: Column) -> Column:
            return (F.get(pairs, i - 1)["h"] == x["h"]) | (F.get(pairs, i + 1)["h"] == x["h"])

        at = F.array_sort(F.transform(F.filter(pairs, lambda x, i: F.coalesce(twice(x, i), F.lit(False))), lambda x: x["i"]))
        zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last"))
        return F.aggregate(at, zero, lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"])

    # a missing neighbour compares as null, and null OR true is true
    pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), let(pairs, of_sorted)).otherwise(F.lit(0).cast("long"))


def _transformed(stats: DataFrame) -> DataFrame:
    """The vector, in thousandths as whole numbers, so that sums over it do not depend on their order."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    share = {
        "v_length": F.log((F.col("word_chars") + 100) / (n + 20)),  # as if with 20 more words of 5 characters
        "v_symbols": F.log1p(20 * F.col("n_symbols") / n),
        "v_marks": F.log1p(20 * F.col("n_marks") / n),
        "v_distinct": F.log(F.greatest(F.col("n_distinct"), F.lit(1)).cast("double")) / F.log(n + 1),
        "v_lines": F.log1p(20 * (F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)) + F.col("n_repeat_words") / n)),
    }
    return stats.withColumns({k: F.round(1000 * v).cast("long") for k, v in share.items()})


def _chi_square(x: float, k: int) -> float:
    """Distribution function by the series of the regularised incomplete gamma function."""
    a, half = k / 2, x / 2
    term = total = 1 / a
    for n in range(1, 500):
        term *= half / (a + n)
        total += term
    return total * math.exp(-half + a * math.log(half) - math.lgamma(a))


def chi_square_quantile(p: float, k: int) -> float:
    lo, hi = 1e-9, 300.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _chi_square(mid, k) < p else (lo, mid)
    return (lo + hi) / 2


def _with_estimates(rows: DataFrame, estimates: DataFrame, few: bool, how: str = "inner") -> DataFrame:
    """Each row beside the estimates of its group: broadcast where the groups are few, else over salted keys."""
    if few:
        return rows.join(F.broadcast(estimates), "g", how)
    salted = estimates.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(salted, ["g", "_salt"], how).drop("_salt")


def _with_distance(rows: DataFrame, names: list[str]) -> DataFrame:
    """``rows`` with ``distance``, squared Mahalanobis, by forward substitution through the Cholesky factor in l_i_j."""
    for i, name in enumerate(names):
        rest = F.col(name) - F.col(f"m_{i}")
        for j in range(i):
            rest = rest - F.col(f"l_{i}_{j}") * F.col(f"y_{j}")
        rows = rows.withColumn(f"y_{i}", rest / F.col(f"l_{i}_{i}"))
    return rows.withColumn("distance", sum((F.col(f"y_{i}") * F.col(f"y_{i}") for i in range(len(names))), F.lit(0.0)))


def _bin(distance: Column) -> Column:
    return F.floor(F.log(distance + 1e-6) * BINS).cast("long")


def _sums(rows: DataFrame, names: list[str], *keys: str) -> DataFrame:
    """(keys, n, s_i, p_i_j): count, sums and sums of products as exact whole numbers."""
    wide = lambda c: F.sum(c.cast("decimal(38,0)"))
    sums = {f"s_{i}": wide(F.col(a)) for i, a in enumerate(names)}
    sums |= {f"p_{i}_{j}": wide(F.col(a) * F.col(names[j])) for i, a in enumerate(names) for j in range(i + 1)}
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), *[v.alias(k) for k, v in sums.items()])


def _factored(sums: DataFrame, names: list[str]) -> DataFrame:
    """(g, start, n, m_i, l_i_j): mean and Cholesky factor of the ridged covariance of each group and start, from their sums."""
    out = sums.withColumns({f"m_{i}": F.col(f"s_{i}").cast("double") / F.col("n") for i in range(len(names))})
    ridge = [(1000 * x) ** 2 * (1 + PRIOR_ROWS / F.col("n")) for x in VECTOR.values()]
    for i in range(len(names)):
        for j in range(i + 1):
            c = (F.col(f"p_{i}_{j}").cast("double") - F.col(f"s_{i}").cast("double") * F.col(f"m_{j}")) / F.col("n")
            for k in range(j):
                c = c - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
            if i == j:
                c = F.sqrt(F.greatest(c + ridge[i], ridge[i] / 2))
            else:
                c = c / F.col(f"l_{j}_{j}")
            out = out.withColumn(f"l_{i}_{j}", c)
    factor = [f"l_{i}_{j}" for i in range(len(names)) for j in range(i + 1)]
    return out.select("g", "start", "n", *[f"m_{i}" for i in range(len(names))], *factor)


def _nearest(binned: DataFrame, share: float) -> DataFrame:
    """The sums over the bins of distance within which the given share of a group's rows lies."""
    by_group = Window.partitionBy("g", "start")
    below, every = F.sum("n").over(by_group.orderBy("bin")), F.sum("n").over(by_group)
    near = binned.withColumn("_below", below - F.col("n")).withColumn("_all", every).where(F.col("_below") < F.ceil(F.col("_all") * share))
    return near.groupBy("g", "start").agg(*[F.sum(c).alias(c) for c in binned.columns if c not in ("g", "start", "bin")])


def _concentrated(rows: DataFrame, now: DataFrame, names: list[str], few: bool, steps: int) -> DataFrame:
    """Estimates after concentration steps, until none of them moves or ``steps`` are made.

    A step reads the rows once: sums by group, start and bin of distance give both the limit of the subset and its moments.
    """
    whole = F.xxhash64(*now.columns).cast("decimal(20,0)")
    before = None
    for _ in range(steps):
        near = _with_distance(_with_estimates(rows, now.drop("n"), few), names).withColumn("bin", _bin(F.col("distance")))
        now = materialize(_factored(_nearest(_sums(near, names, "g", "start", "bin"), SUBSET), names), "estimates")
        if (state := now.agg(F.sum(whole)).first()[0]) == before:
            break
        before = state
    return now


def judge(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", probability: float = KEPT_PROBABILITY
) -> DataFrame:
    """Statistics and a verdict for each row of ``docs``.

    Columns: ``id_col``, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, distance, kept.
    ``base_failed``: fewer than 10 words, or more than a fifth of the words inside repeated five-word windows.
    The others are judged within their language and source (null is a value of its own): the estimate starts from
    mean and covariance of all rows and from those of the rows within a band around the mean of each statistic, takes
    concentration steps onto the ``SUBSET`` of rows nearest to it (a bin of distances is taken whole) until they move
    nothing, and keeps the start of smaller determinant. Rows whose ``distance``, squared Mahalanobis, passes the chi-square
    quantile of ``probability`` are not kept. Every group has its own estimate; the fewer rows it has, the wider the
    variance added to it, so that a group of one keeps its row. Only aggregates of groups and of bins of distances are
    shuffled after the first stage. Repeated rows are judged each.
    """
    kind = docs.schema[id_col].dataType
    lang, source = F.col(lang_col).cast("string"), F.col(source_col).cast("string")
    named = docs.withColumn("_group", F.to_json(F.struct(lang, source)))
    stats = word_statistics(named, id_col, text_col, "_group").withColumnRenamed("_group", "g")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    stats = materialize(_transformed(stats.withColumn("base_failed", failed)), "text-statistics")
    names = list(VECTOR)

    rows = stats.where("NOT base_failed").select("g", "id", *names)
    everyone = materialize(_factored(_sums(rows.withColumn("start", F.lit("all")), names, "g", "start"), names), "estimates")
    few = everyone.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    inner = _with_estimates(rows, everyone.drop("n", "start"), few)
    band = [F.abs(F.col(a) - F.col(f"m_{i}")) <= F.sqrt(sum((F.col(f"l_{i}_{j}") ** 2 for j in range(i + 1)), F.lit(0.0))) for i, a in enumerate(names)]
    inside = inner.where(sum((b.cast("int") for b in band), F.lit(0)) == len(names)).select("g", *names, F.lit("band").alias("start"))
    starts = materialize(everyone.unionByName(_factored(_sums(inside, names, "g", "start"), names)), "estimates")
    now = _concentrated(rows, starts, names, few, MAX_STEPS)

    k = len(names)
    spread = SUBSET / _chi_square(chi_square_quantile(SUBSET, k), k + 2)  # consistency of the subset's covariance for normal rows
    cut = chi_square_quantile(probability, k) * spread
    log_det = sum((F.log(f"l_{i}_{i}") for i in range(k)), F.lit(0.0))
    best = now.withColumn("det", log_det).withColumn("_r", F.row_number().over(Window.partitionBy("g").orderBy("det", "start"))).where("_r = 1").drop("_r", "start", "n")
    judged = _with_estimates(stats, materialize(best, "best-estimates"), few, "left")
    distance = F.when(~F.col("base_failed"), F.col("distance"))
    return _with_distance(judged, names).withColumn("distance", distance).select(
        F.col("id").cast(kind).alias(id_col),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "distance",
        (~F.col("base_failed") & F.coalesce(F.col("distance") <= cut, F.lit(True))).alias("kept"),
    )

