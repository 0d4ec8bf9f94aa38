from martlet.operators.growth import period_change, same_period_before
from martlet.operators.prefix import SLICES, ordered_prefix
from martlet.operators.ranking import rank_by, running_total, top_n_per_group
from martlet.operators.shares import flag_above_average, group_share, mean_of, share_of_total

__all__ = [
    "SLICES",
    "flag_above_average",
    "group_share",
    "mean_of",
    "ordered_prefix",
    "period_change",
    "rank_by",
    "running_total",
    "same_period_before",
    "share_of_total",
    "top_n_per_group",
]
