"""Phone identity keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SIGNIFICANT_DIGITS = 10


def digits_only(phone: Column) -> Column:
    return F.regexp_replace(phone, "[^0-9]", "")


def last_digits(digits: Column, n: int = SIGNIFICANT_DIGITS) -> Column:
    return F.right(digits, F.lit(n))


def is_placeholder(key: Column) -> Column:
    """True for ten digits that cannot identify one person.

    That is one digit repeated (which includes 5555555555) or a subscriber number in
    the range 555-0100 to 555-0199 reserved for fiction, under any area code.
    """
    return key.rlike(r"^(.)\1{9}$") | key.rlike("55501[0-9][0-9]$")


# The last ten digits, unless is_placeholder() holds for them.
USABLE = r"(?!([0-9])\1{9}$)(?![0-9]{3}55501[0-9]{2}$)[0-9]{10}$"


def normalize_phone(phone: Column) -> Column:
    """Ten-digit identity key, or null where the number cannot serve as one.

    One pattern on one mention of `phone`, so the expression stays small when it is
    inlined into filters and keys.
    """
    return F.get(F.regexp_extract_all(digits_only(phone), F.lit(USABLE), F.lit(0)), F.lit(0))


def mask_phone(key: Column) -> Column:
    """Only the last four digits, for reports."""
    return F.concat(F.lit("..."), F.right(key, F.lit(4)))
