"""Chart-ready extract tables: the numbers the dashboard draws, as small DataFrames.

Drawing is out of scope; bar lengths, axis positions and labels are data work.
All inputs are already aggregated (bands, categories, segments, seller types).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlens.config import (AOV_LOG_MAX, AOV_LOG_MIN, CURRENCY_SYMBOL, OVER_INDEX_AXIS_MAX,
                               OVER_INDEX_AXIS_MIN, REPEAT_AXIS_MAX, REPEAT_AXIS_MIN)
from basketlens.functions import round_half_up, to_double
from basketlens.operators.ratios import max_scaled


def short_label(col: str):
    """Text before the first ``:`` of a band label (``'2-3: Occasional repeat'`` -> ``'2-3'``)."""
    return F.split_part(F.col(col), F.lit(":"), F.lit(1))


def bars(band_summary: DataFrame, category_mix: DataFrame) -> DataFrame:
    """Bar lengths as % of the series maximum: ``series, label, value, bar_pct``."""
    customers = band_summary.select(F.lit("customers").alias("series"),
                                    short_label("freq_band").alias("label"),
                                    to_double("customers").alias("value"))
    revenue = band_summary.select(F.lit("avg_revenue_per_customer").alias("series"),
                                  short_label("freq_band").alias("label"),
                                  to_double("avg_revenue_per_customer").alias("value"))
    mix = category_mix.select(F.lit("category_pct_revenue").alias("series"),
                              F.col("category").alias("label"),
                              to_double("pct_revenue").alias("value"))
    allbars = customers.unionByName(revenue).unionByName(mix)
    return max_scaled(allbars, "value", by=["series"], name="bar_pct")


def aov_repeat(repeat_rate: DataFrame, aov: DataFrame) -> DataFrame:
    """AOV (log10 axis between fixed bounds) against repeat rate, as % positions."""
    lo, hi = F.log10(F.lit(AOV_LOG_MIN)), F.log10(F.lit(AOV_LOG_MAX))
    joined = repeat_rate.select("category", "pct_repeat_within_category").join(aov, "category")
    x = (F.log10("aov") - lo) / (hi - lo) * 100.0
    y = ((F.col("pct_repeat_within_category") - F.lit(REPEAT_AXIS_MIN))
         / (F.lit(REPEAT_AXIS_MAX) - F.lit(REPEAT_AXIS_MIN)) * 100.0)
    return joined.select("category", "aov", "pct_repeat_within_category",
                         round_half_up(x, 1).alias("x_pct"), round_half_up(y, 1).alias("y_pct"))


def over_index_offset(over_index: DataFrame) -> DataFrame:
    """Position of each (rounded) over-index on the fixed 0.85-1.15 axis, in %."""
    span = F.lit(OVER_INDEX_AXIS_MAX) - F.lit(OVER_INDEX_AXIS_MIN)
    pos = (F.col("over_index") - F.lit(OVER_INDEX_AXIS_MIN)) / span * 100.0
    return over_index.select("customer_segment", "category", "over_index",
                             round_half_up(pos, 1).alias("offset_pct"))


def seller_views(logistics_means: DataFrame) -> DataFrame:
    """Raw (millions, r1) and normalized (thousands, r0) seller means, each scaled to
    its own maximum: ``view, fbs_standard, value, bar_pct``."""
    scaled = logistics_means.select(
        "fbs_standard",
        round_half_up(F.col("mean_raw_revenue") / 1e6, 1).alias("raw"),
        round_half_up(F.col("mean_revenue_per_product") / 1e3, 0).alias("norm"))
    long = scaled.unpivot("fbs_standard", ["raw", "norm"], "view", "value")
    return max_scaled(long.select("view", "fbs_standard", "value"), "value", by=["view"], name="bar_pct")


def band_labels(band_summary: DataFrame) -> DataFrame:
    """Short band labels and display strings with thousands separators."""
    return band_summary.select(
        "freq_band",
        short_label("freq_band").alias("short_label"),
        F.format_number(F.col("customers"), 0).alias("customers_label"),
        F.concat(F.lit(CURRENCY_SYMBOL), F.format_number(F.col("avg_revenue_per_customer"), 0)).alias("revenue_label"),
        F.format_string("%.1f%%", F.col("pct_customers")).alias("pct_customers_label"))
