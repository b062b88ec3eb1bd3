"""Scalar functions as column expressions, with driver-side twins where a caller needs them."""

from __future__ import annotations

import math
from string import ascii_uppercase, digits

from pyspark.sql import Column
from pyspark.sql import functions as F


def truncate(c: Column, size: int = 50) -> Column:
    return F.when(F.length(c) > size, F.concat(F.left(c, F.lit(size)), F.lit("…"))).otherwise(c)


def safe_tag(c: Column, default: str = "field", dots: bool = True) -> Column:
    """Letters, digits, ``_``, ``-`` (and ``.``); other runs become ``_``, which is trimmed at the ends."""
    kept = F.regexp_replace(c, r"[^A-Za-z0-9_.\-]+" if dots else r"[^A-Za-z0-9_\-]+", "_")
    kept = F.regexp_replace(kept, "^_+|_+$", "")
    return F.when(kept == "", default).otherwise(kept)


def pair_key(y: Column, x: Column) -> Column:
    return F.concat(y, F.lit("__vs__"), x)


def literal(value) -> Column:
    """The constant that a condition on categories compares with: a whole number where the value reads as one (also "3.0"),
    else a decimal number, else text as it is. Values are constants of the plan, never text of a statement, so quotes in
    them mean nothing; "nan" and "inf" are text, as no number of a table equals them."""
    try:
        number = float(value)
    except (TypeError, ValueError):
        return F.lit(str(value))
    if not math.isfinite(number):
        return F.lit(str(value))
    return F.lit(int(number)) if number.is_integer() and abs(number) < 2**63 else F.lit(number)


def letter_label(n: int) -> str:
    """A, B, .. Z, AA, AB .. for 0, 1, ..: labels by length, each length in order of the alphabet."""
    length = 1
    while n >= len(ascii_uppercase) ** length:
        n -= len(ascii_uppercase) ** length
        length += 1
    return "".join(ascii_uppercase[n // len(ascii_uppercase) ** place % len(ascii_uppercase)] for place in reversed(range(length)))


def column_number(letters: str) -> int:
    """The place of a column by its letters, from 1."""
    return sum((ascii_uppercase.index(x) + 1) * 26**place for place, x in enumerate(reversed(letters.upper())))


def cell(name: str) -> tuple[int, int]:
    """Row and column, from 1, of a cell name: letters, then digits."""
    letters = name.rstrip(digits)
    if not (letters.isascii() and letters.isalpha()) or letters == name:
        raise ValueError(f"{name} is no cell")
    return int(name[len(letters) :]), column_number(letters)


def sheet_size(dimension: str) -> tuple[int, int] | None:
    """Rows and columns of a cell range such as A1:F100, or of one cell; None for anything else."""
    corners = (dimension or "").split(":")
    try:
        rows, columns = zip(*map(cell, corners))
    except ValueError:
        return None
    return None if len(corners) > 2 else (abs(rows[-1] - rows[0]) + 1, abs(columns[-1] - columns[0]) + 1)


def full_width_commas(c: Column) -> Column:
    return F.translate(c, ",", "，")


def number_text(c: Column, digits: int = 4) -> Column:
    return F.when(c.isNull(), "").otherwise(F.format_string(f"%.{digits}f", c))


def safe_number(c: Column) -> Column:
    """A finite number, else null."""
    v = c.try_cast("double")
    return F.when(F.isnan(v) | (F.abs(v) == math.inf), None).otherwise(v)


def iso_date(c: Column) -> Column:
    """YYYYMMDD as an ISO date text, null where it is no date."""
    return F.date_format(F.try_to_timestamp(c, F.lit("yyyyMMdd")), "yyyy-MM-dd")


def iou(inter: Column, a: Column, b: Column) -> Column:
    both = a + b - inter
    return F.when(both > 0, inter / both).otherwise(0.0)


def crs_name(wkt: Column) -> Column:
    return F.nullif(F.regexp_extract(wkt, r'(?:PROJCS|GEOGCS|GEOCCS)\s*\[\s*"([^"]+)"', 1), F.lit(""))
