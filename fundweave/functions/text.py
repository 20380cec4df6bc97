"""String expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NOT_ALNUM = r"[^\p{L}\p{N}]"


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def clean_account(c: Column) -> Column:
    """Letters and digits of any script only."""
    return F.regexp_replace(c, NOT_ALNUM, "")


def clean_identifier(c: Column) -> Column:
    return clean_account(F.upper(F.coalesce(c, F.lit(""))))


def normal_header(c: Column) -> Column:
    """White space, underscores, hyphens, brackets and colons gone, lower case."""
    return F.lower(F.translate(c, " \t\n\x0b\f\r_-（）()：:", ""))


def contains_any(c: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(c, F.lit(w))
    return out


def mask_account(c: Column) -> Column:
    """Over 8 characters: the first and last four show."""
    n = F.length(c)
    return F.when(n > 8, F.concat(F.substr(c, F.lit(1), F.lit(4)), F.repeat(F.lit("*"), n - 8), F.right(c, F.lit(4)))).otherwise(c)


def random_id(prefix: str, digits: int) -> Column:
    """A prefix and random upper-case hexadecimal digits, 32 at most, of a version 4 UUID. Write the rows before reading them twice."""
    return F.concat(F.lit(prefix), F.upper(F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, digits)))
