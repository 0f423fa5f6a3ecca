"""Additive R+F+M quintile score and the tie diagnostic that led to rejecting it.

The analysis describes (and rejects) an additive score with each of R, F and M
scored 1-5 by quintile, because many customers share a frequency and equal
values straddle quintile edges.  No formula is given; ours is:

* a measure's score is ``1 + floor(5 * worse / N)`` where ``worse`` counts the
  customers with a strictly worse value (lower F or M, higher recency), so equal
  values always share a score;
* ``rfm_score = r_score + f_score + m_score`` (3..15).

:func:`tie_split_report` counts the tie groups that a position-based
``NTILE(5)`` would cut in two -- the reason the score was rejected.

The three measures are stacked into one long frame, grouped by measure.  The score needs
only the few values where it steps up (:func:`selected_edges`); the tie report needs the
ranks of all values (:func:`value_ranks`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlens.operators.ranks import score_by_edges, selected_edges, tie_split, value_ranks

MEASURES = ("recency", "frequency", "monetary")
LOWER_IS_BETTER = ("recency",)


def _long(seg: DataFrame) -> DataFrame:
    wide = seg.select("customer_id", *[F.col(m).cast("double").alias(m) for m in MEASURES])
    return wide.unpivot("customer_id", list(MEASURES), "measure", "value")


def _better_when_higher():
    return ~F.col("measure").isin(list(LOWER_IS_BETTER))


def measure_ranks(seg: DataFrame) -> DataFrame:
    """Exact ranks of the three measures (see :func:`value_ranks`), grouped by ``measure``."""
    return value_ranks(_long(seg), "value", ["measure"])


def rfm_score(seg: DataFrame, k: int = 5) -> DataFrame:
    """``customer_id, r_score, f_score, m_score, rfm_score`` for every customer of ``seg``.

    Exact selection gives, per measure, the ``k - 1`` values where the score steps
    up (:func:`selected_edges`); the three short edge lists travel as one scalar
    subquery, and every customer is scored by comparing its values with them.
    No customer-grain join or shuffle is needed, neither for the edges nor for the scoring.
    """
    edges = selected_edges(_long(seg), "value", ["measure"], k, _better_when_higher())
    edge_cols = [f"edge_{j}" for j in range(1, k)]
    packed = edges.agg(*[F.max(F.when(F.col("measure") == m, F.array(*edge_cols))).alias(m)
                         for m in MEASURES])
    lists = packed.select(F.struct(*MEASURES)).scalar()
    # the subquery is referenced once, as a column; the scores read that column
    with_edges = seg.select("customer_id", *MEASURES, lists.alias("_edges"))
    scored = with_edges.select(
        "customer_id",
        *[score_by_edges(F.col(m).cast("double"), F.col("_edges")[m], k, m not in LOWER_IS_BETTER)
          .alias(f"{m[0]}_score") for m in MEASURES])
    return scored.withColumn("rfm_score", F.col("r_score") + F.col("f_score") + F.col("m_score"))


def tie_split_report(seg: DataFrame, k: int = 5, ranks: DataFrame | None = None) -> DataFrame:
    """One row per measure: ``measure, distinct_values, split_values, customers_in_split_values``."""
    report = tie_split(ranks if ranks is not None else measure_ranks(seg), ["measure"], k, _better_when_higher())
    return report.withColumnRenamed("rows_in_split_values", "customers_in_split_values")
