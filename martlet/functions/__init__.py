from martlet.functions.labels import (
    above_average,
    above_average_badge,
    currency_label,
    full_name,
    growth_direction,
    month_label,
    percent_label,
    rank_tier,
    signed_percent_label,
)
from martlet.functions.measures import (
    as_double,
    exact_sum,
    gross_revenue,
    money,
    net_of,
    net_revenue,
    percent_of,
)

__all__ = [
    "above_average",
    "above_average_badge",
    "as_double",
    "currency_label",
    "exact_sum",
    "full_name",
    "gross_revenue",
    "growth_direction",
    "money",
    "month_label",
    "net_of",
    "net_revenue",
    "percent_label",
    "percent_of",
    "rank_tier",
    "signed_percent_label",
]
