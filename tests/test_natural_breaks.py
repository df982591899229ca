"""Natural breaks of more rows than a sample would hold, against the plain dynamic programme over all of them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoframe.operators import classify


def deviation(x, edges):
    """Squared deviation within the classes that end at edges[1:]."""
    at = np.searchsorted(edges[1:], x, "left")
    return sum(((x[at == k] - x[at == k].mean()) ** 2).sum() for k in np.unique(at))


def plain(x, classes):
    """Least squared deviation, by all starts of the last class."""
    v, n = np.unique(x, return_counts=True)
    w, s, q = (np.r_[0, np.cumsum(n * y)] for y in (np.ones(len(v)), v, v * v))
    cost = lambda i, j: q[j] - q[i] - (s[j] - s[i]) ** 2 / (w[j] - w[i])
    best = [cost(0, j) for j in range(1, len(v) + 1)]
    for _ in range(1, classes):
        best = [min((best[i - 1] + cost(i, j) for i in range(1, j)), default=np.inf) for j in range(1, len(v) + 1)]
    return best[-1]


def frame(spark, x):
    return spark.createDataFrame([(float(v),) for v in x], "v double")


def test_values_with_many_copies(spark):
    """50 values with 1,200 copies each: a sample by the value's hash holds copies of one."""
    df = spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet")
    x = np.array([r[0] for r in df.select(F.col("l_quantity").cast("double")).collect()])
    edges = classify.natural(df, F.col("l_quantity"), 5)
    assert len(edges) == 6 and edges == sorted(edges) and len(set(edges[1:])) == 5
    assert edges[0] == x.min() and edges[-1] == x.max()
    assert deviation(x, edges) == pytest.approx(plain(x, 5))


def test_all_of_3000_values_count(spark):
    x = np.random.default_rng(1).lognormal(0, 1, 3000).round(2)
    edges = classify.natural(frame(spark, x), F.col("v"), 4)
    assert deviation(x, edges) == pytest.approx(plain(x, 4))


def test_beyond_the_bound_all_rows_are_in_bins(spark, monkeypatch):
    x = np.r_[np.random.default_rng(2).normal(0, 1, 1500), 1e6]
    monkeypatch.setattr(classify, "NATURAL_DISTINCT", 100)
    monkeypatch.setattr(classify, "NATURAL_QUANTILES", 400)
    edges = classify.natural(frame(spark, x), F.col("v"), 4)
    assert edges[0] == x.min() and edges[-1] == 1e6
    assert plain(x, 4) <= deviation(x, edges) <= 1.02 * plain(x, 4)


def test_few_distinct_values(spark):
    assert classify.natural(frame(spark, [3.0] * 5 + [1.0] * 4), F.col("v"), 5) == [1, 1, 3]
