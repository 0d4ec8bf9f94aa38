"""Revenue measures.

A line amount is a double. A sum of amounts is exact: it is taken over whole
hundred-millionths, so it does not depend on the order in which tasks finish, and
becomes a double only when a result is handed out. Single amounts, sums and the SQL
twins share the eight decimals and the rule that halves are rounded away from zero.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCALE = 8
MONEY = f"decimal(28,{SCALE})"

_LOW_BITS = 20


def gross_revenue(price: Column, quantity: Column) -> Column:
    """Price times quantity. Inputs are widened first, whatever the ANSI mode."""
    return price.cast("double") * quantity.cast("double")


def net_of(gross: Column, discount: Column) -> Column:
    """A gross amount after its discount rate."""
    return gross.cast("double") * (F.lit(1.0) - discount.cast("double"))


def net_revenue(price: Column, quantity: Column, discount: Column) -> Column:
    """Revenue of a line. Feed it the charged price for the canonical measure,
    the product's list price for the list-price measure."""
    return net_of(gross_revenue(price, quantity), discount)


def money(amount: Column) -> Column:
    """One amount at the scale of the sums."""
    return amount.cast(MONEY)


def exact_sum(amount: str, scale: int = SCALE) -> Column:
    """Exact sum of a double SQL expression at ``scale`` decimals, as ``decimal(28, scale)``.

    The scaled amounts are added as two bigint sums (high and low bits), which
    stay in generated code and cannot overflow before 8e12 rows; a plain decimal
    sum costs about three times as much per row. An amount of over 9e18 units fails
    the job, which takes ANSI mode.
    """
    scaled = f"CAST({amount} AS DOUBLE) * {10**scale}"
    units = f"CAST(sign({scaled}) * floor(abs({scaled}) + 0.5D) AS BIGINT)"
    high = f"CAST(sum(shiftright({units}, {_LOW_BITS})) AS DECIMAL(24,0))"
    low = f"CAST(sum({units} & {(1 << _LOW_BITS) - 1}) AS DECIMAL(24,0))"
    whole = f"CAST({high} * {1 << _LOW_BITS}BD + {low} AS DECIMAL(28,0))"
    return F.expr(f"CAST({whole} * {10**-scale:.{scale}f}BD AS DECIMAL(28,{scale}))")


def as_double(amount: Column) -> Column:
    return amount.cast("double")


def percent_of(part: Column, whole: Column) -> Column:
    """``part`` as a percentage of ``whole``; NULL when ``whole`` is 0."""
    return as_double(part) / F.nullif(as_double(whole), F.lit(0.0)) * 100
