import math
import random

import pytest
from pyspark.sql import functions as F

from panelweave.functions.quantiles import exact_quantiles

SHARES = [0.013, 0.5, 1.0]


def plain(values, share):
    x = sorted(v for v in values if v is not None and not math.isnan(v))
    place = share * (len(x) - 1)
    low = math.floor(place)
    high = min(low + 1, len(x) - 1)
    return x[low] if place == low or x[low] == x[high] else x[low] * (1 - place + low) + x[high] * (place - low)


def test_quantiles_equal_sorting(spark):
    rng = random.Random(7)
    columns = {
        "orders": [math.exp(rng.uniform(-600, 600)) for _ in range(2000)],
        "gaps": [rng.choice([None, math.nan, float(k)]) for k in range(2000)],
        "huge": [rng.choice([-1.7e308, 1.7e308, 5e-324, 0.0, 1.0]) for _ in range(2000)],
        "ends": [rng.choice([-math.inf, math.inf, float(k)]) for k in range(2000)],
        "none": [None] * 2000,
    }
    table = spark.createDataFrame(list(zip(*columns.values(), strict=True)), ", ".join(f"{c} double" for c in columns))
    for few in (7, 50_000):  # down to single values, and ranked at once
        got = exact_quantiles(table, ["orders", "gaps", "none"], [0.5], few) | exact_quantiles(table, ["huge", "ends"], [0.5], few)
        assert got.pop("none") == [None] and got == {c: [plain(columns[c], 0.5)] for c in got}
    assert exact_quantiles(table.limit(0), ["gaps"], [0.5]) == {"gaps": [None]}


def test_quantiles_of_a_million_rows_equal_percentile(spark):
    table = spark.range(1_000_000).select((F.pmod(F.xxhash64("id"), F.lit(10**9)) / 1e6 - 300).alias("x"))
    want = table.agg(F.percentile("x", F.lit(0.9))).first()[0]
    assert exact_quantiles(table, ["x"], [0.9], 1000)["x"] == pytest.approx([want], rel=1e-12)
