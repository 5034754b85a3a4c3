"""Printed numbers: parsing, grouping and currency formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_grouped_number(c: Column) -> Column:
    """``2,77,190`` / ``277,190`` / ``277190.5`` to double; anything else is NULL."""
    return F.regexp_replace(F.trim(c), ",", "").try_cast("double")


def indian_grouping(n: Column) -> Column:
    """Non-negative integer with a last group of three digits and groups of two before it."""
    digits = n.cast("long").cast("string")
    tail = F.right(digits, F.lit(3))
    head = F.substring(digits, F.lit(1), F.length(digits) - 3)
    # Groups of two count from the right, so group the mirrored text and mirror it back.
    pairs = F.reverse(F.regexp_replace(F.reverse(head), r"(\d{2})(?=\d)", "$1,"))
    return F.when(F.length(digits) <= 3, digits).otherwise(F.concat(pairs, F.lit(","), tail))


def printed_forms(n: Column) -> Column:
    """Ways an amount may be printed, as an array of strings."""
    whole = n == F.floor(n)
    plain = n.cast("decimal(30,4)")
    trimmed = F.regexp_replace(F.regexp_replace(plain.cast("string"), "0+$", ""), r"\.$", "")
    integer_forms = F.array(
        n.cast("long").cast("string"),
        F.format_number(n.cast("double"), 0),
        indian_grouping(n),
        F.concat(n.cast("long").cast("string"), F.lit(".00")),
    )
    below = F.floor(n)
    fraction = F.regexp_extract(trimmed, r"(\.\d+)$", 1)
    grouped = [F.concat(g, fraction) for g in (F.format_number(below.cast("double"), 0), indian_grouping(below))]
    return F.when(whole, integer_forms).otherwise(F.array(trimmed, *grouped))


def rupees_in_crore(c: Column) -> Column:
    """``₹6.45 Cr``; a minus sign (U+2212) goes before the currency sign."""
    return F.concat(
        F.when(c < 0, "−").otherwise(""), F.lit("₹"), F.format_string("%.2f", F.abs(c) / 1e7), F.lit(" Cr")
    )


def flatten_spaces(c: Column) -> Column:
    return F.regexp_replace(F.replace(c, F.lit("’"), F.lit("'")), r"\s+", " ")
