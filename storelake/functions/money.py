"""Money expressions: exact sums, price display and price parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CENTS = "decimal(18,2)"


def cents(col: Column) -> Column:
    return col.cast(CENTS)


def cents_long(col: Column) -> Column:
    """Amount rounded to cents (half up) as a whole number of cents."""
    return (cents(col) * F.lit(100)).cast("bigint")


def from_cents(total_cents: Column) -> Column:
    """Whole cents back to currency as DOUBLE (the double nearest the exact sum)."""
    return total_cents / F.lit(100.0)


def money_sum(col: Column) -> Column:
    """Sum of a money column in exact cents, returned as DOUBLE.

    Sums are kept as BIGINT cents: exact, independent of the order rows are
    added in (every partitioning gives the same figure), and on the fast
    codegen path -- wide decimal sums would fall back to BigDecimal buffers.
    """
    return from_cents(F.sum(cents_long(col)))


def line_revenue_sum(price: Column, quantity: Column) -> Column:
    """SUM(price * quantity) in exact cents (see K1 on what price means)."""
    return from_cents(F.sum(cents_long(price) * quantity))


def line_revenue_partial(price: Column, quantity: Column) -> Column:
    """Partial revenue in whole cents so a later re-aggregation stays exact."""
    return F.sum(cents_long(price) * quantity)


def format_price(value: Column) -> Column:
    """'Rs.45/-' for whole amounts, otherwise two decimals 'Rs.45.50/-'."""
    # '%.0f' prints any whole double exactly (no bigint overflow); adding 0.0
    # turns -0.0 into 0.0, which a browser also prints as '0'
    whole = F.format_string("%.0f", value + F.lit(0.0))
    frac = F.format_string("%.2f", value)
    body = F.when(value == F.floor(value), whole).otherwise(frac)
    return F.concat(F.lit("Rs."), body, F.lit("/-"))


def parse_price(text: Column) -> Column:
    """price text to number; keeps digits, '.', '-'; leading number or 0.

    A leading 'Rs.' currency prefix is dropped first (K25), so 'Rs.45/-' is 45.
    """
    no_prefix = F.regexp_replace(F.trim(text), r"^(?i)rs\.", "")
    cleaned = F.regexp_replace(no_prefix, r"[^0-9.\-]", "")
    number = F.regexp_extract(cleaned, r"^(-?(\d+\.?\d*|\.\d+))", 1)
    return F.coalesce(F.nullif(number, F.lit("")).try_cast("double"), F.lit(0.0))
