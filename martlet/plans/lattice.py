"""Stored aggregates, and the rule that answers from the smallest one that will do.

A stored aggregate holds the additive measures by some attributes as exact decimals.
It covers a question if it has each attribute asked for, or a finer one of the same
date. What no aggregate covers is answered from the lines. Aggregates are themselves
built from the smallest aggregate that covers them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martlet.plans.model import _ADDITIVE, _DATES, as_report, exact_measures
from martlet.session import materialise
from martlet.sources.star import Star

#: Date attribute -> those that follow from it.
_FOLLOWS = {"order_date": set(_DATES), "month": {"month", "quarter", "year"}}


@dataclass(frozen=True)
class Stored:
    attributes: tuple[str, ...]
    rows: int
    table: DataFrame

    def expression(self, attribute: str) -> str | None:
        """The attribute out of this table, or None if it does not follow from what is there."""
        if attribute in self.attributes:
            return f"`{attribute}`"
        for finer in self.attributes:
            if attribute in _FOLLOWS.get(finer, ()):
                return _DATES[attribute].replace("order_date", f"`{finer}`")
        return None

    def covers(self, by: tuple[str, ...]) -> bool:
        return all(self.expression(a) for a in by)

    def measures(self, by: tuple[str, ...]) -> DataFrame:
        keys = [F.expr(self.expression(a)).alias(a) for a in by]
        return self.table.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in _ADDITIVE])


class Lattice:
    """A star with aggregates beside it. ``store`` gives a lattice with one more."""

    def __init__(self, star: Star, stored: tuple[Stored, ...] = ()):
        self.star = star
        self.stored = stored

    def source(self, *by: str) -> Stored | None:
        """The smallest aggregate that covers ``by``; None means the lines."""
        return min((s for s in self.stored if s.covers(by)), key=lambda s: s.rows, default=None)

    def measures(self, *by: str) -> DataFrame:
        found = self.source(*by)
        return found.measures(by) if found else exact_measures(self.star, *by)

    def store(self, *by: str) -> Lattice:
        """Write the aggregate by these attributes to the scratch folder."""
        table = materialise(self.measures(*by), "aggregate")
        return Lattice(self.star, (*self.stored, Stored(by, table.count(), table)))

    def revenue_by(self, *by: str) -> DataFrame:
        """As ``model.revenue_by``, from the smallest table that will do."""
        return as_report(self.measures(*by), *by)


def rollup_from_aggregate(star: Star) -> DataFrame:
    """Quarters and regions out of an aggregate by month, nation and category, without the lines."""
    lattice = Lattice(star).store("month", "category_name", "region", "nation").store("month", "region")
    return lattice.revenue_by("year", "quarter", "region")
