"""Share, index and scaling operators over already-aggregated frames.

The grand-total windows here (``OVER ()``) move their input to one task, so they
are only ever applied to the output of a ``groupBy`` whose keys come from a fixed
domain (statuses, bands, segments, categories, seller types): the window sees one
row per group, never row-grain data.  This keeps each query a single pass; a
scalar-subquery total would recompute the aggregate when it is not materialized.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketlens.functions import pct, round_half_up, safe_div, to_double


def _cols(x) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


def share_of_total(df: DataFrame, keys, *, count_name: str = "n", pct_name: str = "pct",
                   digits: int = 1) -> DataFrame:
    """``groupBy(keys).count()`` plus each group's percentage of all rows."""
    keys = _cols(keys)
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(count_name))
    total = F.sum(count_name).over(Window.partitionBy())
    return counted.withColumn(pct_name, pct(F.col(count_name), total, digits))


def share_within(df: DataFrame, outer, inner, *, value: str | None = None,
                 pct_name: str = "pct", digits: int = 1) -> DataFrame:
    """Percentage of each ``inner`` group inside its ``outer`` group.

    The measure is the row count or the sum of ``value``; the denominator is the
    sum of the cells of the outer group (a partitioned window over the small
    aggregate: one row per inner value).
    """
    outer, inner = _cols(outer), _cols(inner)
    measure = F.sum(value) if value is not None else F.count(F.lit(1))
    cells = df.groupBy(*outer, *inner).agg(measure.alias("_m"))
    denom = F.sum("_m").over(Window.partitionBy(*outer))
    return cells.select(*outer, *inner, pct(F.col("_m"), denom, digits).alias(pct_name))


def over_index(cells: DataFrame, group: str, item: str, measure: str,
               groups: Sequence[str] | None = None) -> DataFrame:
    """Over-index of ``item`` inside ``group``: (share of item in group) / (share overall).

    ``cells`` is one row per (group, item) with a summed ``measure``.  The overall
    baseline is taken over *all* groups before the optional ``groups`` filter.
    Output: ``group, item, pct_of_segment_revenue, overall_pct_baseline, over_index``
    (rounded 1 / 1 / 2) plus the unrounded ``_over_index``.
    """
    m = to_double(measure)
    group_total = F.sum(measure).over(Window.partitionBy(group))
    item_total = F.sum(measure).over(Window.partitionBy(item))
    grand_total = F.sum(measure).over(Window.partitionBy())
    overall_share = safe_div(item_total, grand_total)
    within = m / F.nullif(to_double(group_total), F.lit(0.0))
    out = cells.select(
        group, item,
        pct(F.col(measure), group_total, 1).alias("pct_of_segment_revenue"),
        round_half_up(overall_share * 100, 1).alias("overall_pct_baseline"),
        round_half_up(within / overall_share, 2).alias("over_index"),
        (within / overall_share).alias("_over_index"),
    )
    if groups is not None:
        out = out.where(F.col(group).isin(list(groups)))
    return out


def max_scaled(df: DataFrame, value: str, *, by: Sequence[str] = (), name: str | None = None,
               digits: int = 1) -> DataFrame:
    """Value as a percentage of the largest value of its series (bar length)."""
    top = F.max(value).over(Window.partitionBy(*by))
    return df.withColumn(name or f"{value}_bar_pct", pct(F.col(value), top, digits))
