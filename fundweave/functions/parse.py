"""Amounts, times and rows of statements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from .text import blank_to_null, normal_header


def amount(c: Column) -> Column:
    """Digits, dots, minus and round brackets are kept; the value is absolute; null if no number is left or it is beyond MONEY."""
    kept = F.regexp_replace(F.coalesce(c, F.lit("")), r"[^0-9.\-()]", "")
    return F.abs(F.regexp_replace(kept, r"^[()]+|[()]+$", "").try_cast("decimal(38,6)")).try_cast(S.MONEY)


#: Year, month and day, then perhaps hours, minutes, seconds and their fraction (six digits count).
TIME_FORM = r"^(\d{4})-(\d{1,2})-(\d{1,2})(?:[ T-]\s*(\d{1,2}):(\d{1,2})(?::(\d{1,2})(?:(\.\d{1,6})\d*)?)?)?\s*$"


def time(c: Column) -> Column:
    """Wall-clock time without a zone, so that no hour is missing or twice; a zone suffix is dropped, not applied. Fractions of seconds stay."""
    text = F.trim(F.coalesce(c, F.lit("")))
    text = F.translate(F.replace(F.replace(text, F.lit("日"), F.lit(" ")), F.lit("/"), F.lit("-")), "年月", "--")
    text = F.regexp_replace(text, r"(?<=\d:\d\d)(\.\d+)?(Z|[+-]\d\d:?\d\d)$", "$1")
    # every part at once, with a zero before it, which then goes where two digits follow; what is absent is that zero alone
    dashed = F.regexp_replace(F.regexp_replace(text, TIME_FORM, "$1-0$2-0$3 0$4:0$5:0$6$7"), r"(?<=[- :])0(?=\d\d(?!\d))", "")
    solid = F.concat(F.substring(text, 1, 4), F.lit("-"), F.substring(text, 5, 2), F.lit("-"), F.substring(text, 7, 2))
    return F.when(F.regexp_like(text, F.lit(TIME_FORM)), dashed.try_cast("timestamp_ntz")).when(F.regexp_like(text, F.lit(r"^\d{8}$")), solid.try_cast("timestamp_ntz"))


def header_cells(row: Column) -> Column:
    """The cells of a map of header -> text as (normalised header, text), in their order."""
    return F.transform(F.map_entries(row), lambda e: F.struct(normal_header(e["key"]).alias("key"), e["value"].alias("value")))


def filled_cells(cells: Column) -> Column:
    """A map of header_cells(): of headers that are alike the last one counts, and only if it is not blank."""
    later = lambda e, i: F.exists(F.slice(cells, i + 2, F.size(cells)), lambda x: x["key"] == e["key"])
    alike = F.size(F.array_distinct(F.transform(cells, lambda e: e["key"]))) < F.size(cells)
    last = F.when(alike, F.filter(cells, lambda e, i: ~later(e, i))).otherwise(cells)
    return F.map_from_entries(F.filter(last, lambda e: e["value"] != ""))


def mapped_fields(row: Column, filled: Column | None = None) -> dict[str, Column]:
    """Canonical fields of a map of header -> text: the first alias that is not blank. filled: its filled_cells() as a column, if there is one."""
    filled = filled_cells(header_cells(row)) if filled is None else filled
    look = lambda names: F.coalesce(*(F.try_element_at(filled, normal_header(F.lit(a))) for a in names), F.lit(""))
    out = {field: look(names) for field, names in S.ALIASES.items()}
    first = lambda names: F.coalesce(*(F.try_element_at(row, F.lit(a)) for a in names), F.lit(""))  # noqa: E731  the second only if the first header is absent
    income, expense, given = first(S.INCOME_HEADERS), first(S.EXPENSE_HEADERS), out["debit_credit"]
    split = (given == "") & ((income != "") | (expense != ""))
    out["amount"] = F.when(split & (income != ""), income).when(split, expense).otherwise(out["amount"])
    out["debit_credit"] = F.when(split & (income != ""), F.lit("贷")).when(split, F.lit("借")).otherwise(given)
    return out


def normalise_rows(rows: DataFrame, row_col: str = "row_data") -> DataFrame:
    """rows with the canonical fields and reject_reason (null: accepted). Checks: accounts, time, amount (0 is rejected)."""
    # a projection for each step whose values the next one reads more than once, so that none is worked out for every use
    cells = rows.withColumn("__cells", header_cells(F.col(row_col))).withColumn("__filled", filled_cells(F.col("__cells")))
    got = {k: F.trim(v) for k, v in mapped_fields(F.col(row_col), F.col("__filled")).items()}
    read = cells.select(*rows.columns, *(v.alias(f"__{k}") for k, v in got.items()))
    of = lambda k: F.col(f"__{k}")
    or_else = lambda k, v: F.coalesce(blank_to_null(of(k)), F.lit(v))
    fields = {k: of(k) for k in got} | {"transaction_time": time(of("transaction_time")), "amount": amount(of("amount")), "balance_after": amount(of("balance_after"))}
    fields |= {"debit_credit": or_else("debit_credit", "借"), "currency": or_else("currency", "CNY"), "transaction_type": or_else("transaction_type", "转账")}
    parsed = read.select(*rows.columns, *(v.alias(k) for k, v in fields.items()))
    bad = F.when((F.col("payer_account") == "") | (F.col("payee_account") == ""), S.REJECT_ACCOUNT)
    bad = bad.when(F.col("transaction_time").isNull(), S.REJECT_TIME).when(F.coalesce("amount", F.lit(0)) == 0, S.REJECT_AMOUNT)
    return parsed.withColumns({"reject_reason": bad, "review_status": F.lit("pending"), "provenance": F.lit("original"), "parser_name": F.lit("structured")})
