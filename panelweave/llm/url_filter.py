"""URL filter: rules first, then logistic regression on hashed character n-grams of host and path."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelweave.functions.expr import let
from panelweave.functions.lineage import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, path): a rule fits its host and all subdomains if the url's path starts with its own; longest wins.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: Sizes of the n-grams and of the hashed feature space; labelled URLs at most; steps, step size and ridge of the fit.
NGRAMS, DIMS, MAX_LABELLED = (3, 4), 4096, 500
STEPS, RATE, RIDGE = 300, 6.0, 0.001
#: The labelled table used by default: names of hosts by what they offer, in ordinary words, with ordinary ends and paths.
BLOCKED = (
    "casinoroyale luckycasino casino777 goldcasino slotmachines jackpotslots pokerstack roulette-live blackjack21 betting-odds sportsbetting bet365x betonline "
    "spinandwin winbig-prizes lottery-winner freespins freecash freegiftcards freeiphone hotadults adultvideo xxxtube sexcams nudepics escortgirls camgirls "
    "pillstore dietpills buypills onlinepharma cheapmeds viagra-shop discountdrugs cheapwatches replica-bags cheap-loans paydayloans quickcredit "
    "spammail spamlist bulkmailer linkfarm clickfarm adserver adsnetwork popunder-ads adclicks banner-ads trackpixel clicktracker usertracking "
    "cracked-software keygens warezdown torrentz hackedgames getrichquick miracle-cure weightloss-now"
).split()
ALLOWED = (
    "cityhospital statelibrary nationalmuseum dailynews morningpost eveningherald weatherreport openuniversity graduateschool primaryschool "
    "gardening-tips homecooking recipebook bakersguild railwaytimes bustimetable airport-info marineresearch astronomy physicsforum chemistrynotes "
    "mathworld historyarchive genealogy folkmusic jazzclub symphony theatreguild filmreview bookclub poetryjournal linguistics dictionary "
    "encyclopedia opensource pythondocs developernotes linuxwiki databaseblog hiking-trails mountaineering birdwatching cyclingclub footballclub "
    "chessfederation gymnastics parliament cityhall taxoffice postoffice consumeradvice lawreview farmersunion woodworking photography travelguide"
).split()
PREFIXES, ENDS = ["", "www.", "blog.", "m."], ["com", "net", "org", "info"]
PATHS = ["", "/", "/index.html", "/about?ref=mail", "/2021/05/story", "/item/4711#top"]


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The default table (url, blocked 0 or 1): each name twice, so that ends and paths say nothing. Inline, without a Python worker."""
    rows = []
    for blocked, names in ((1, BLOCKED), (0, ALLOWED)):
        for k, name in enumerate(names):
            for j in range(2):
                rows.append(f"('https://{PREFIXES[(k + j) % 4]}{name}.{ENDS[(k + j) % 4]}{PATHS[(k + 2 * j) % 6]}', {blocked})")
    return spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS t(url, blocked)")


def with_parts(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """``pages`` with ``host`` (A-Z lower-cased) and ``path``; both empty for a null url and one without ``://``."""
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    part = lambda n: F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", n)
    return pages.withColumn("host", F.translate(part(1), UPPER, LOWER)).withColumn("path", part(2))


def _buckets(dims: int) -> Column:
    """array<int>: hashed n-grams of host and path, repeats included."""

    def grams(tag: str, chars: Column, n: int) -> Column:
        def bucket(i: Column) -> Column:
            return F.pmod(F.xxhash64(F.lit(tag), F.concat(*[F.get(chars, i + k) for k in range(n)])), F.lit(dims)).cast("int")

        starts = F.when(F.size(chars) >= n, F.sequence(F.lit(0), F.size(chars) - n)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, bucket)

    def part(tag: str) -> Column:
        chars = F.split(F.concat(F.lit("^"), F.col(tag), F.lit("$")), "")
        return let(chars, lambda c: F.concat(*[grams(tag, c, n) for n in NGRAMS]))

    return F.concat(part("host"), part("path"))


def fit(labelled: DataFrame, dims: int = DIMS, max_labelled: int = MAX_LABELLED) -> tuple[list[float], float]:
    """Weights of the buckets and the intercept, fitted on about ``max_labelled`` rows of (url, blocked) at most.

    Of a larger table a sample is taken by a hash of the url. The fit runs in the dual: the weights are a combination of
    the labelled URLs' feature vectors, whose coefficients take gradient steps over their table of inner products. Rows
    without a label are left out. An empty table gives weights and intercept zero.
    """
    usable = labelled.select("url", F.col("blocked").cast("double").alias("y")).where("y IS NOT NULL")
    if (n := usable.count()) > max_labelled:
        usable = usable.where(F.pmod(F.xxhash64("url", "y"), F.lit(1 << 30)) < int(max_labelled / n * (1 << 30)))
    rows = with_parts(usable)
    one = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("url", "y"))
    rows = materialize(rows.select((one - 1).alias("k"), "y", _buckets(dims).alias("buckets")), "labelled-urls")
    if not (n := rows.count()):
        return [0.0] * dims, 0.0
    values = rows.select("k", F.size("buckets").alias("n"), F.explode("buckets").alias("bucket")).groupBy("k", "bucket").agg((F.count("*") / F.sqrt(F.max("n"))).alias("x"))
    values = materialize(values, "url-features")
    every = values.unionByName(rows.select("k", F.lit(-1).alias("bucket"), F.lit(0.0).alias("x")))  # pairs without a common n-gram have product zero
    other = every.select(F.col("k").alias("j"), "bucket", F.col("x").alias("z"))
    inner = every.join(other, "bucket").groupBy("k", "j").agg(F.sum(F.col("x") * F.col("z")).alias("v"))
    kernel = inner.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("j", "v"))).alias("r")).select("k", F.col("r.v").alias("r"))
    packed = kernel.join(rows.select("k", "y"), "k").agg(F.array_sort(F.collect_list(F.struct("k", "r", "y"))).alias("a"))
    packed = packed.select(F.col("a.r").alias("rows"), F.col("a.y").alias("y"))

    def step(state: Column, _: Column) -> Column:
        def error(row: Column, i: Column) -> Column:
            margin = F.aggregate(F.zip_with(row, state["c"], lambda a, b: a * b), state["b"], lambda a, v: a + v)
            return F.get("y", i) - 1.0 / (1.0 + F.exp(-margin))

        errors = F.transform("rows", error)
        moved = F.zip_with(state["c"], errors, lambda c, e: c * (1 - RATE * RIDGE) + RATE * e / n)
        bias = F.aggregate(errors, F.lit(0.0), lambda a, e: a + e) / n
        return F.struct(moved.alias("c"), (state["b"] + RATE * bias).alias("b")).cast("struct<c:array<double>,b:double>")

    start = F.struct(F.transform("y", lambda v: v * 0.0).alias("c"), F.lit(0.0).alias("b")).cast("struct<c:array<double>,b:double>")
    fitted = materialize(packed.select(F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step).alias("s")), "url-model")
    parts = fitted.select(F.posexplode("s.c").alias("k", "c"))
    weights = values.join(parts, "k").groupBy("bucket").agg(F.sum(F.col("c") * F.col("x")).alias("w"))
    dense = [0.0] * dims
    for r in weights.collect():  # at most ``dims`` rows
        dense[r.bucket] = r.w
    return dense, fitted.first().s.b


def judge(pages: DataFrame, labelled: DataFrame | None = None, url_col: str = "url", rules: list[tuple[str, str, str]] = RULES, dims: int = DIMS) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` (or null), ``score`` (probability to be unwanted) and ``verdict``.

    The verdict is the longest fitting rule's, else block from a score of one half up. Null, empty and odd urls have
    empty parts and are scored as such; repeated rows are judged each. Input columns of these names are replaced. Rows
    stay in their partitions: the model is an array of ``dims`` numbers in the plan.
    """
    dense, bias = fit(labelled if labelled is not None else labelled_urls(pages.sparkSession), dims)
    weights = F.from_json(F.lit(json.dumps(dense)), "array<double>")
    added = ["host", "path", "rule", "score", "verdict"]
    plain = with_parts(pages.drop(*[c for c in added if c != url_col]), url_col)
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    margin = let(_buckets(dims), lambda b: F.aggregate(b, F.lit(0.0), lambda a, i: a + F.get(weights, i)) / F.sqrt(F.greatest(F.size(b), F.lit(1))))
    score = 1.0 / (1.0 + F.exp(-(margin + F.lit(bias))))
    scored = plain.withColumn("rule", rule).withColumn("score", score)
    return scored.withColumn("verdict", F.coalesce(verdict, F.when(F.col("score") >= 0.5, "block").otherwise("allow")))

