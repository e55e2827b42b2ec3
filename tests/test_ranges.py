"""The range-cut paths give what the plain windows give, at any skew."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowsieve.operators.quantiles import Bracket, exact_quantiles, order_statistics
from flowsieve.operators.ranges import cut_points, neighbour_windows, running_totals


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(3)
    rows = [("hot" if i % 3 else f"g{i % 7}", float(rng.choice([1.0, 1.0, rng.random() * 50])), i, rng.randint(0, 9)) for i in range(3000)]
    return spark.createDataFrame(rows, "g string, v double, id bigint, n bigint").cache()


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals_in_ranges_equal_the_plain_window(skewed, descending):
    direction = F.desc if descending else F.asc
    order = [direction("v"), direction("id")]
    df = skewed.withColumn("f", F.when(F.col("g") == "hot", 0).otherwise(1))
    axis = F.col("f") + F.col("v") / 51
    cuts = cut_points(df, axis, 100, 3000)
    assert len(cuts) > 3
    plain = running_totals(df, "f", order, {"s": "n"}, [], axis, descending)
    ranged = running_totals(df, "f", order, {"s": "n"}, cuts, axis, descending)
    assert sorted(plain.collect()) == sorted(ranged.select(plain.columns).collect())


@pytest.mark.parametrize("before, after, rows", [(2, 3, 100), (0, 4, 30), (5, 0, 30), (1, 1, 3)])
def test_neighbours_in_ranges_equal_the_plain_window(skewed, before, after, rows):
    order = [F.col("v"), F.col("id")]

    def add(table, window):
        return table.withColumns({"a": F.lag("id", before).over(window), "b": F.lead("id", after).over(window)})

    df = skewed.withColumn("g", F.when(F.col("g") != "g3", F.col("g")))
    cuts = cut_points(df, F.col("v"), rows, 3000)
    plain = neighbour_windows(df, ["g"], order, F.col("v"), before, after, [], add)
    ranged = neighbour_windows(df, ["g"], order, F.col("v"), before, after, cuts, add)
    key = lambda row: row["id"]
    assert sorted(plain.collect(), key=key) == sorted(ranged.select(plain.columns).collect(), key=key)


def test_narrowed_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(5)
    a = rng.lognormal(3, 4, 5000)
    b = np.where(rng.random(5000) < 0.4, 7.0, rng.normal(0, 1e6, 5000))
    c = np.full(5000, 3.5)
    rows = [(float(x), float(y), float(z), None if i % 2 else float(x)) for i, (x, y, z) in enumerate(zip(a, b, c))]
    rows += [(float("nan"), float("inf"), None, None)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    shares = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = exact_quantiles(df, ["a", "b", "c", "d"], shares, last_rows=10)
    small = exact_quantiles(df, ["a", "b", "c", "d"], shares)
    for name, values in {"a": a, "b": b, "c": c, "d": a[::2]}.items():
        np.testing.assert_allclose(got[name], np.quantile(values, shares), rtol=1e-12)
        np.testing.assert_allclose(small[name], np.quantile(values, shares), rtol=1e-12)


def test_order_statistics_close_in_over_several_passes(spark):
    values = np.concatenate([np.random.default_rng(1).exponential(1, 4000), [1e300, -1e300, 1.7e308, -1.7e308]])
    df = spark.createDataFrame([(float(x),) for x in values], "v double")
    ordered = np.sort(values)
    start = Bracket("v", ordered[0], ordered[-1], 0, len(values))
    ranks = [0, 1, 17, 2000, 4001, 4003]
    got = order_statistics(df, {("v", r): start for r in ranks}, bins=4, last_rows=20)
    assert [got["v", r] for r in ranks] == [ordered[r] for r in ranks]


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None,), (None,)], "v double")
    assert exact_quantiles(df, ["v"], [0.5]) == {"v": [None]}
    assert exact_quantiles(df, ["v"], [0.5], last_rows=0) == {"v": [None]}
    assert exact_quantiles(df, [], [0.5]) == {}
