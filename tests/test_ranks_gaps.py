"""Exact ranks, medians, percent-rank mid value and purchase gaps against brute force."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from basketlens.operators import categories as ca
from basketlens.operators import ranks
from tests.helpers import tables


def _hist(spark, groups):
    rows = [(g, v) for g, vals in groups.items() for v in vals]
    df = spark.createDataFrame(rows, "g string, v long")
    return df.groupBy("g", "v").agg(F.count(F.lit(1)).alias("n"))


@pytest.mark.parametrize("vals, expected", [
    ([1, 1, 1, 1, 5], 5), ([1, 2, 3, 4], 3), ([100, 208, 208, 208, 209, 300], 209),
    ([7], None), ([3, 3], None), ([1, 2, 2, 2, 2], None)])
def test_percent_rank_mid_fixtures(spark, vals, expected):
    out = ca.percent_rank_mid(_hist(spark, {"a": vals}), "g", "v", name="mid").collect()
    got = out[0].mid if out else None
    assert got == expected


def test_percent_rank_mid_and_median_match_brute_force(spark):
    rng = random.Random(7)
    groups = {f"g{i}": [rng.randint(0, 12) for _ in range(rng.randint(1, 9))] for i in range(120)}
    rows = [(g, v) for g, vals in groups.items() for v in vals]
    df = spark.createDataFrame(rows, "g string, v long")
    brute = (df.withColumn("pr", F.percent_rank().over(Window.partitionBy("g").orderBy("v")))
             .where("pr >= 0.5").groupBy("g").agg(F.min("v").alias("mid")))
    want = {r.g: r.mid for r in brute.collect()}
    got = {r.g: r.mid for r in ca.percent_rank_mid(_hist(spark, groups), "g", "v", name="mid").collect()}
    assert got == want
    med = {r.g: r.m for r in ca.median_from_histogram(_hist(spark, groups), "g", "v", name="m").collect()}
    assert med == {g: float(np.median(v)) for g, v in groups.items()}


def test_value_ranks_exact(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"g": rng.integers(0, 3, 2000).astype(str),
                        "v": rng.integers(-150, 150, 2000) * 0.5 * 10.0 ** rng.integers(-3, 9, 2000)})
    pdf.loc[:600, "v"] = 42.0                       # one value holds a third of the rows
    df = spark.createDataFrame(pdf)
    ranked = ranks.value_ranks(df, "v", ["g"])
    assert ranked.select(ranks.value_range(F.col("v"))).distinct().count() > 100     # many ranges
    got = ranked.toPandas()
    for _, row in got.sample(200, random_state=1).iterrows():
        grp = pdf[pdf.g == row.g].v
        assert row.below == (grp < row.v).sum()
        assert row.n == (grp == row.v).sum()
        assert row.total == len(grp)
    glob = ranks.value_ranks(df, "v").toPandas()
    assert glob.n.sum() == len(pdf)
    assert set(glob.below) == {(pdf.v < v).sum() for v in glob.v}


def test_median_from_ranks(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"g": rng.integers(0, 4, 999).astype(str), "v": rng.normal(size=999)})
    df = spark.createDataFrame(pdf)
    got = {r.g: r.med for r in ranks.median_from_ranks(ranks.value_ranks(df, "v", ["g"]),
                                                       "v", ["g"], "med").collect()}
    for g, grp in pdf.groupby("g"):
        assert got[g] == pytest.approx(float(np.median(grp.v)), abs=1e-12)


def test_ntile_formula_matches_spark_ntile(spark):
    for total in (1, 4, 5, 7, 23, 100):
        df = spark.range(1, total + 1).withColumnRenamed("id", "p")
        got = df.select("p", ranks.ntile_of(F.col("p"), F.lit(total)).alias("a"),
                        F.ntile(5).over(Window.orderBy("p")).alias("b")).collect()
        assert all(r.a == r.b for r in got), total


def test_quintile_score_ties_share_a_score(spark):
    df = spark.createDataFrame([(i, f) for i, f in enumerate([1] * 6 + [2, 3, 4, 5])], "id long, f long")
    sc = ranks.quantile_score(ranks.value_ranks(df, "f"), 5).collect()
    assert {r.f: r.score for r in sc} == {1: 1, 2: 4, 3: 4, 4: 5, 5: 5}


def _gap_tables(spark):
    orders = [(1, 1, "2024-01-01", 1), (2, 1, "2024-01-01", 1), (3, 1, "2024-01-11", 1),
              (4, 1, "2024-01-11", 1), (5, 1, "2024-01-11", 1), (6, 2, "2024-03-01", 1),
              (7, 2, "2024-02-01", 1), (8, 1, "2024-02-01", 1)]
    items = [(10 + o, o, 1 if o != 8 else 2, "Completed", 1) for o, *_ in orders]
    return tables(spark, customers=[(1, "2020-01-01"), (2, "2020-01-01")], orders=orders, items=items,
                  products=[(1, "a", "Home", 1), (2, "b", "Electronics", 1)], sellers=[(1, "Company", "FBS")])


def test_purchase_gaps_same_day_zero_and_first_null(spark, monkeypatch):
    monkeypatch.setattr(ca, "GAP_CHUNK", 2)           # exercise the chunked expansion
    t = _gap_tables(spark)
    got = sorted((r.category, r.customer_id, r.days_since_prev if r.days_since_prev is not None else -1)
                 for r in ca.purchase_gaps(t).collect())
    assert got == sorted([("Home", 1, -1), ("Home", 1, 0), ("Home", 1, 10), ("Home", 1, 0), ("Home", 1, 0),
                          ("Home", 2, -1), ("Home", 2, 29), ("Electronics", 1, -1)])


@pytest.mark.parametrize("higher_is_better", [True, False])
def test_edges_score_equals_rank_score(spark, higher_is_better):
    rng = np.random.default_rng(11)
    pdf = pd.DataFrame({"id": range(997), "v": rng.integers(0, 40, 997).astype(float)})
    pdf.loc[:300, "v"] = 7.0                         # a third of the rows share one value
    df = spark.createDataFrame(pdf)
    rk = ranks.value_ranks(df, "v")
    by_rank = {r.v: r.score for r in ranks.quantile_score(rk, 5, higher_is_better).collect()}
    edges = ranks.quantile_edges(rk, "v", (), 5, higher_is_better)
    arr = edges.select(F.array(*[f"edge_{j}" for j in range(1, 5)])).scalar()
    got = df.select("v", ranks.score_by_edges(F.col("v"), arr, 5, higher_is_better).alias("s")).collect()
    assert all(r.s == by_rank[r.v] for r in got)


def test_value_range_rises_with_the_value(spark):
    near = [2.0 ** e * f for e in range(-40, 41) for f in (1 - 1e-15, 1.0, 1 + 1e-15, 1.3, 1.999999)]
    values = sorted(set(near + [-x for x in near] + [0.0]))
    df = spark.createDataFrame([(v,) for v in values], "v double").coalesce(1)
    got = [r.b for r in df.select(ranks.value_range(F.col("v")).alias("b")).collect()]
    assert got == sorted(got)


def test_value_ranks_is_lazy(spark):
    before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    ranks.value_ranks(spark.range(100).withColumn("v", F.col("id") * 1.5), "v")
    assert list(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) == list(before)
