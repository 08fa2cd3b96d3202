"""Parsing expressions for form and message text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Complaint message layout written by the feedback form.
RATING_PREFIX = r"^\[Star Rating: (\d+)/5\] ?"
MAX_IMAGE_BYTES = 5 * 1024 * 1024


def complaint_rating(message: Column) -> Column:
    """F8: the star rating of '[Star Rating: n/5] text', NULL without one."""
    return F.nullif(F.regexp_extract(message, RATING_PREFIX, 1), F.lit("")).try_cast("int")


def complaint_text(message: Column) -> Column:
    """F8: the message without its rating prefix."""
    return F.regexp_replace(message, RATING_PREFIX, "")


def form_price(text: Column) -> Column:
    """product form price: a number, or 0 when empty or not a number."""
    return F.coalesce(F.trim(text).try_cast("double"), F.lit(0.0))


def form_stock(text: Column) -> Column:
    """product form stock: an integer, or 0 ('1.5' is not an integer)."""
    t = F.trim(text)
    return F.when(t.rlike(r"^[+-]?\d+$"), t.try_cast("int")).otherwise(F.lit(0)).cast("int")


def image_within_limit(image: Column) -> Column:
    """the 5 MB upload cap; a missing image is within the limit."""
    return F.coalesce(F.length(image) <= MAX_IMAGE_BYTES, F.lit(True))
