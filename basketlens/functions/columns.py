"""Column-level building blocks.

Numeric rules used everywhere (so that results do not depend on partitioning):

* money is summed as DECIMAL (exact, order independent) and only turned into
  DOUBLE for ratios and output;
* averages of money are ``sum / count`` in DOUBLE;
* ratios divide by ``NULLIF(den, 0)``: a zero denominator gives NULL, never an error;
* results are rounded once, half away from zero.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from basketlens.config import LABELS, THRESHOLDS, Labels, Thresholds


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def money_sum(x, scale: int = 2) -> Column:
    """Exact sum of a source money column, as DECIMAL(38, scale).

    The input is cast to DECIMAL(18, scale) -- a no-op for the schemas' money columns,
    exact cents for DOUBLE input -- and summed as DECIMAL, so no total overflows
    before 38 digits.
    """
    return F.sum(_c(x).cast(f"decimal(18,{scale})")).cast(f"decimal(38,{scale})")


def money_total(x, scale: int = 2) -> Column:
    """Exact sum of amounts that are sums themselves, as DECIMAL(38, scale)."""
    return F.sum(_c(x).cast(f"decimal(38,{scale})"))


def to_double(x) -> Column:
    return _c(x).cast("double")


def round_half_up(x, digits: int) -> Column:
    """Round a numeric column to ``digits`` decimals, once, half away from zero, as DOUBLE."""
    return F.round(_c(x), digits).cast("double")


def safe_div(num, den) -> Column:
    """``num / den`` in DOUBLE; NULL when the denominator is 0 or NULL."""
    return to_double(num) / F.nullif(to_double(den), F.lit(0.0))


def pct(num, den, digits: int | None = 1) -> Column:
    """Percentage ``num * 100 / den`` (DOUBLE), optionally rounded."""
    value = to_double(num) * 100.0 / F.nullif(to_double(den), F.lit(0.0))
    return value if digits is None else round_half_up(value, digits)


def tenure_group(registration_date, as_of, months: int = THRESHOLDS.tenure_months,
                 labels: Labels = LABELS) -> Column:
    """Recent if registered on/after ``as_of - months`` (month end clamps); NULL -> Established."""
    cutoff = F.add_months(_c(as_of), -months)
    return (F.when(_c(registration_date) >= cutoff, F.lit(labels.tenure_recent))
            .otherwise(F.lit(labels.tenure_established)))


def freq_band(frequency, labels: Labels = LABELS) -> Column:
    """Frequency band: 1 / 2-3 / 4-5 / 6-8 / 9+ (anything else, NULL included, is 9+)."""
    f = _c(frequency)
    *limited, (open_label, _, _) = labels.band_limits
    return F.coalesce(*[F.when(f.between(first, last), label) for label, first, last in limited],
                      F.lit(open_label))


def customer_segment(frequency, recency, tenure, t: Thresholds = THRESHOLDS,
                     labels: Labels = LABELS) -> Column:
    """Business-rule segment; the first matching rule wins.

    A NULL recency fails every comparison and falls through to B4, as in SQL.
    """
    f, r = _c(frequency), _c(recency)
    return (F.when(_c(tenure) == labels.tenure_recent, labels.seg_b0)
            .when((f == 1) & (r <= t.engaged_days), labels.seg_b5)
            .when((f == 1) & (r > t.engaged_days), labels.seg_b6)
            .when((f >= t.high_frequency) & (r <= t.engaged_days), labels.seg_b1)
            .when((f >= t.high_frequency) & (r > t.engaged_days), labels.seg_b2)
            .when(f.between(2, t.high_frequency - 1) & (r <= t.active_days), labels.seg_b3)
            .otherwise(labels.seg_b4))
