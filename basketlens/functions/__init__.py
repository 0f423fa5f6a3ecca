"""Column expressions shared by the operators (all built-in Spark functions, no UDFs)."""

from basketlens.functions.columns import (
    customer_segment,
    freq_band,
    money_sum,
    money_total,
    pct,
    round_half_up,
    safe_div,
    tenure_group,
    to_double,
)

__all__ = ["customer_segment", "freq_band", "money_sum", "money_total", "pct", "round_half_up", "safe_div",
           "tenure_group", "to_double"]
