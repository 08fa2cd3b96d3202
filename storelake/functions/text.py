"""String expressions: shop search semantics and label formatting."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER = string.ascii_uppercase
_LOWER = string.ascii_lowercase
_ASCII_FOLD = str.maketrans(_UPPER, _LOWER)


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only; every other character is left alone (the shop's
    search folds ASCII letters only, so 'É' never matches 'é')."""
    return F.translate(col, _UPPER, _LOWER)


def contains_term(col: Column | str, term: str) -> Column:
    """Case-insensitive (ASCII) 'contains' with the shop's LIKE semantics.

    ``%`` and ``_`` typed by the user stay wildcards; a backslash is a
    literal character.  Spark's LIKE treats ``\\`` as its escape character,
    so it is doubled here.  The pattern is a literal, so the predicate stays
    a codegen'd JVM expression.
    """
    col = F.col(col) if isinstance(col, str) else col
    pattern = "%" + term.translate(_ASCII_FOLD).replace("\\", "\\\\") + "%"
    return ascii_lower(col).like(pattern)


def sql_contains_term(col_sql: str, term: str) -> str:
    """The same predicate as SQL text for DuckDB (no escape character there)."""
    pattern = "%" + term.translate(_ASCII_FOLD) + "%"
    quoted = pattern.replace("'", "''")
    return f"translate({col_sql}, '{_UPPER}', '{_LOWER}') LIKE '{quoted}'"


def variant_description(short_desc: Column, full_desc: Column) -> Column:
    """' - ' joins the trimmed short and full description, skipping empty parts."""
    parts = [F.nullif(F.trim(short_desc), F.lit("")), F.nullif(F.trim(full_desc), F.lit(""))]
    return F.concat_ws(" - ", *parts)


def address_label(house: Column, area: Column, city: Column, province: Column) -> Column:
    """'house, area, city, province' as printed at checkout."""
    return F.concat_ws(", ", house, area, city, province)


def string_predicates(text: Column, probe: Column) -> dict[str, Column]:
    """the three template filters startswith / endswith / contains."""
    return {
        "starts_with": text.startswith(probe),
        "ends_with": text.endswith(probe),
        "contains": text.contains(probe),
    }
