"""Fixed values and analysis thresholds.

The labels below must be equal to the reference analysis for results to
compare; they are stated here once, in natural order.
"""

from __future__ import annotations

from dataclasses import dataclass, field


# --- fixed values: status, category, seller domains and output labels ---
@dataclass(frozen=True)
class Labels:
    completed: str = "Completed"
    cancelled: str = "Cancelled"
    refunded: str = "Refunded"

    categories: tuple[str, ...] = ("Home", "Electronics", "Fashion", "Groceries", "Beauty")
    company: str = "Company"
    individual: str = "Individual"
    fbs: str = "FBS"
    standard: str = "Standard"

    tenure_recent: str = "Recent (<3mo tenure)"
    tenure_established: str = "Established"

    band_1: str = "1: One-time"
    band_2_3: str = "2-3: Occasional repeat"
    band_4_5: str = "4-5: Regular"
    band_6_8: str = "6-8: Frequent"
    band_9_plus: str = "9+: Power buyer"

    seg_b0: str = "B0: New / recently acquired"
    seg_b1: str = "B1: High-frequency, engaged"
    seg_b2: str = "B2: High-value, declining engagement"
    seg_b3: str = "B3: Regular/occasional, active"
    seg_b4: str = "B4: Regular/occasional, inactive"
    seg_b5: str = "B5: One-time buyer"
    seg_b6: str = "B6: One-time buyer, inactive"

    @property
    def seller_types(self) -> tuple[str, ...]:
        return (self.company, self.individual)

    @property
    def logistics(self) -> tuple[str, ...]:
        return (self.fbs, self.standard)

    @property
    def band_limits(self) -> tuple[tuple[str, int, int | None], ...]:
        """``(label, first, last)`` of every frequency band; the last one is open."""
        return ((self.band_1, 1, 1), (self.band_2_3, 2, 3), (self.band_4_5, 4, 5),
                (self.band_6_8, 6, 8), (self.band_9_plus, 9, None))

    @property
    def bands(self) -> tuple[str, ...]:
        return tuple(label for label, _, _ in self.band_limits)

    @property
    def segments(self) -> tuple[str, ...]:
        return (self.seg_b0, self.seg_b1, self.seg_b2, self.seg_b3,
                self.seg_b4, self.seg_b5, self.seg_b6)


# --- fixed values: business thresholds of the analysis ---
@dataclass(frozen=True)
class Thresholds:
    tenure_months: int = 3            # registered within 3 months of the as-of date
    engaged_days: int = 90            # recency <= 90 days: engaged / active one-timer
    active_days: int = 180            # recency <= 180 days: active regular customer
    high_frequency: int = 6           # frequency >= 6: high-frequency customer
    watchlist_days: int = 180         # watchlist: frequency >= 6 and recency > 180
    min_product_buyers: int = 100     # product-level test: at least 100 buyers
    top_products: int = 30            # product-level test: top 30 by revenue
    reconcile_tolerance: str = "0.05"  # money tolerance of the reconciliation
    over_index_band: float = 0.15     # heuristic +/-15% over-index flag
    focus_categories: tuple[str, ...] = ("Electronics", "Home")
    pair_categories: tuple[str, ...] = ("Home", "Electronics")   # combined share of the two largest
    focus_segments: tuple[str, ...] = field(
        default=("B1: High-frequency, engaged", "B2: High-value, declining engagement"))


# --- fixed values: chart scales and money label of the dashboard extracts ---
CURRENCY_SYMBOL = "฿"
AOV_LOG_MIN = 150.0
AOV_LOG_MAX = 22000.0
REPEAT_AXIS_MIN = 0.0
REPEAT_AXIS_MAX = 85.0
OVER_INDEX_AXIS_MIN = 0.85
OVER_INDEX_AXIS_MAX = 1.15

LABELS = Labels()
THRESHOLDS = Thresholds()
