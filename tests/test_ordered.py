"""Ordered scans: hot keys cut into several runs give the same result as a window."""

import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerops.operators.ordered import OrderedRows, exact_quantiles, unfold
from tests.conftest import rows


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(5)
    data = []
    for i in range(600):
        key = "hot" if rng.random() < 0.6 else rng.choice(["a", "b", "c", None])
        data.append((key, rng.randint(0, 200), i, rng.choice([None, rng.randint(-5, 9)])))
    return spark.createDataFrame(data, "k string, t int, id int, v int").cache()


@pytest.mark.parametrize("partitions", [1, 3, 7])
def test_steps_equal_windows(skewed, partitions):
    scan = OrderedRows.of(skewed, ["k"], ["t", "id"], partitions)
    got = (
        scan.previous(pv=F.col("v")).following(nv=F.col("v")).running_sum(s=F.col("v"))
        .latest(l=F.when(F.col("v") > 3, F.col("v"))).upcoming(u=F.when(F.col("v") > 3, F.col("v"))).rows
    )
    w = W.partitionBy("k").orderBy("t", "id")
    big = F.when(F.col("v") > 3, F.col("v"))
    want = skewed.select(
        "k", "t", "id", "v", F.lag("v").over(w).alias("pv"), F.lead("v").over(w).alias("nv"), F.sum("v").over(w).alias("s"),
        F.last(big, True).over(w).alias("l"), F.first(big, True).over(w.rowsBetween(0, W.unboundedFollowing)).alias("u"),
    )
    assert rows(got.select(want.columns)) == rows(want)
    if partitions > 1:
        assert len(scan._frame.inputFiles()) > 1  # the hot key really spans several runs


def test_no_key_and_empty(spark, skewed):
    total = OrderedRows.of(skewed, [], ["t", "id"], 4).running_sum(n=F.lit(1)).rows
    assert sorted(r["n"] for r in total.collect()) == list(range(1, 601))
    empty = OrderedRows.of(skewed.limit(0), ["k"], ["t"]).previous(p=F.col("v")).rows
    assert empty.count() == 0


def test_exact_quantiles(spark, skewed):
    qs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {r["q"]: r["value"] for r in exact_quantiles(skewed, "v", qs).collect()}
    want = skewed.agg(F.percentile("v", F.array(*map(F.lit, qs)))).first()[0]
    assert [got[q] for q in qs] == pytest.approx(want)
    by = {(r["k"], r["q"]): r["value"] for r in exact_quantiles(skewed.where("k is not null"), "v", [0.3], ["k"]).collect()}
    for r in skewed.where("k is not null").groupBy("k").agg(F.percentile("v", 0.3).alias("p")).collect():
        assert by[r["k"], 0.3] == pytest.approx(r["p"])
    assert exact_quantiles(skewed.limit(0), "v", [0.5]).count() == 0


def test_unfold_covers_the_range(spark):
    df = spark.createDataFrame([(1, 250_001), (5, 4), (7, 7)], "lo bigint, hi bigint")
    got = unfold(df, "lo", "hi", "n")
    assert got.count() == 250_001 + 1
    assert got.where("hi = 250001").select("n").distinct().count() == 250_001
    stepped = unfold(df.where("hi = 7"), "lo", "hi", "n", 3)
    assert [r["n"] for r in stepped.collect()] == [7]


def test_quantiles_keep_the_null_group(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 2.0)], "g string, v double")
    got = {r["g"]: r["value"] for r in exact_quantiles(df, "v", [0.5], ["g"]).collect()}
    assert got == {None: 2.0, "a": 2.0}
