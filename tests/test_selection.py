"""Order statistics by ranges and cells against sorting, medians, score edges."""

import random

import pytest
from pyspark.sql import functions as F

from basketlens.operators.ranks import medians, order_statistics, quantile_edges, selected_edges, value_ranks

GROUPS = ("skewed", "ties", "single", None, "wide")


def _rows(seed):
    r = random.Random(seed)
    rows = [("single", 7.5)]
    rows += [("skewed", round(r.lognormvariate(5, 2), 2)) for _ in range(900)] + [("skewed", 100.0)] * 450
    rows += [("ties", float(r.randint(-3, 3))) for _ in range(700)]
    rows += [(None, r.uniform(-1e-3, 1e-3)) for _ in range(501)]
    rows += [("wide", r.choice([-1, 1]) * 10.0 ** r.randint(-200, 200) * r.random()) for _ in range(400)]
    rows += [("wide", None), ("empty", None)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("cells", [4096, 3])
def test_order_statistics_equal_sorting(spark, monkeypatch, cells):
    from basketlens.operators import ranks
    monkeypatch.setattr(ranks, "CELLS", cells)
    rows = _rows(1)
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    places = {"least": lambda n: F.lit(0), "third": lambda n: F.floor(n / 3), "most": lambda n: n - 1, "past": lambda n: n}
    got = {x.g: x for x in order_statistics(df, "v", places, ["g"]).collect()}
    assert set(got) == set(GROUPS)
    for g in GROUPS:
        v = sorted(x for h, x in rows if h == g and x is not None)
        assert (got[g].total, got[g].least, got[g].third, got[g].most, got[g].past) == (len(v), v[0], v[len(v) // 3], v[-1], None)


def test_medians_equal_sorting(spark):
    from statistics import median
    rows = _rows(2)
    got = {x.g: x["median"] for x in medians(spark.createDataFrame(rows, "g string, v double"), "v", ["g"]).collect()}
    assert got == {g: median(x for h, x in rows if h == g and x is not None) for g in GROUPS}


@pytest.mark.parametrize("k", [2, 5, 10])
def test_selected_edges_equal_ranked_ones(spark, k):
    df = spark.createDataFrame(_rows(k), "g string, v double").repartition(3)
    better = F.coalesce(F.col("g") != "ties", F.lit(True))
    want = quantile_edges(value_ranks(df, "v", ["g"]), "v", ["g"], k, better).collect()
    got = selected_edges(df, "v", ["g"], k, better).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, want), key=repr)


def _shuffled_records(df):
    """Records that all exchanges of an executed plan have written."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    total, todo, seen = 0, [plan], set()
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(node.plan())
        elif name != "ReusedExchangeExec":
            if name == "ShuffleExchangeExec" and node.id() not in seen:
                seen.add(node.id())
                total += node.metrics().apply("shuffleRecordsWritten").value()
            todo += [node.children().apply(k) for k in range(node.children().size())]
    return total


def test_shuffle_does_not_grow_with_distinct_values(spark):
    """Ten times the distinct values in the same span: selection shuffles about the same, ranks ten times."""
    def frame(n):
        return spark.range(n).select(F.lit("a").alias("g"), (1000 + F.rand(3) * 1000).alias("v"))

    small, large = (_shuffled_records(medians(frame(n), "v", ["g"])) for n in (40_000, 400_000))
    ranked = _shuffled_records(value_ranks(frame(400_000), "v", ["g"]))
    assert large < 3 * small and ranked > 10 * large
