"""Facts laid out by order, on which seller totals move no line.

Orders and lines are saved in the same number of buckets by order id, sorted, so that
they meet and group without an exchange. A bucket is read by one task, so an order that
holds very many lines would make one task slow. Such orders are kept apart in tables
without buckets, where their lines are spread over as many files as their size asks for;
as they are few, their keys are broadcast by size. Each line is in exactly one of the two
places, and sums of both are added.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martlet.functions import exact_sum
from martlet.functions.measures import MONEY
from martlet.plans.analyses import seller_rank
from martlet.session import materialise
from martlet.sources.star import Star
from martlet.sources.writers import write_bucketed

#: Lines of an order beyond which it is kept apart.
HOT_LINES = 1_000_000


@dataclass(frozen=True)
class Layout:
    """Names of the saved tables, and the star whose dimensions go with them."""

    star: Star
    orders: str
    lines: str
    hot_orders: DataFrame
    hot_lines: DataFrame

    def _table(self, name: str) -> DataFrame:
        return self.star.orders.sparkSession.table(name)

    def seller_sums(self) -> DataFrame:
        """``seller_id`` and exact ``total_sales`` over lines of known orders; the first exchange carries sums."""
        seller = "lines" if self.star.seller_on_lines else "orders"
        parts = []
        for orders, lines in (
            (self._table(self.orders), self._table(self.lines)),
            (self.hot_orders, self.hot_lines),
        ):
            found = lines.join(orders, "order_id", "left_semi") if seller == "lines" else lines.join(orders, "order_id")
            parts.append(found.groupBy("seller_id").agg(exact_sum("net").alias("part")))
        both = parts[0].unionByName(parts[1])
        return both.groupBy("seller_id").agg(F.sum("part").cast(MONEY).alias("total_sales"))


def hot_order_ids(star: Star, hot_lines: int = HOT_LINES) -> DataFrame:
    """Orders with more lines than one task should take."""
    counts = star.lines.groupBy("order_id").agg(F.count("*").alias("n"))
    return materialise(counts.filter(F.col("n") > hot_lines).select("order_id"), "hot-orders")


def lay_out(star: Star, buckets: int, name: str, hot_lines: int = HOT_LINES) -> Layout:
    """Save orders and lines as the tables ``<name>_orders`` and ``<name>_lines``, hot orders beside them."""
    hot = hot_order_ids(star, hot_lines)
    write_bucketed(star.orders.join(hot, "order_id", "left_anti"), f"{name}_orders", "order_id", buckets)
    write_bucketed(star.lines.join(hot, "order_id", "left_anti"), f"{name}_lines", "order_id", buckets)
    return Layout(
        star,
        f"{name}_orders",
        f"{name}_lines",
        materialise(star.orders.join(hot, "order_id", "left_semi"), "hot-orders"),
        materialise(star.lines.join(hot, "order_id", "left_semi"), "hot-lines"),
    )


def seller_rank_laid_out(star: Star, hot_lines: int = HOT_LINES) -> DataFrame:
    """The seller ranking over freshly laid out facts."""
    spark = star.orders.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    made = lay_out(star, buckets, f"laid_out_{uuid.uuid4().hex}", hot_lines)
    return seller_rank(star.with_shared(seller_sums=made.seller_sums()))
