"""Predicates and projections over transactions. Column builders: compose them in one filter so that they reach the scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.text import blank_to_null
from .running import places

TEXT_FIELDS = ("serial_number", "payer_account", "payer_name", "payee_account", "payee_name", "summary")


def min_amount(least: float) -> Column:
    return F.col("amount") >= least


def text_query(query: str, trimmed: bool = True) -> Column:
    """Case-insensitive literal substring of the joined text fields; a match may straddle two fields."""
    q = query.lower().strip() if trimmed else query.lower()
    return F.lit(True) if not q else F.contains(F.lower(F.concat_ws(" ", *(F.coalesce(c, F.lit("")) for c in TEXT_FIELDS))), F.lit(q))


def direction(kind: str) -> Column:
    returns = F.contains("summary", F.lit(S.RETURN_WORD))
    return {"all": F.lit(True), "return": returns, "forward": ~returns}.get(kind, F.lit(False))


def channel(name: str) -> Column:
    return F.col("channel") == name if name else F.lit(True)


def bank(part: str) -> Column:
    return F.contains("payer_bank", F.lit(part)) | F.contains("payee_bank", F.lit(part)) if part else F.lit(True)


def region(name: str) -> Column:
    return F.col("region") == name if name else F.lit(True)


def date_range(first: str = "", last: str = "") -> Column:
    """Inclusive comparison of ISO date strings."""
    day = F.date_format("transaction_time", "yyyy-MM-dd")
    return (day >= first if first else F.lit(True)) & (day <= last if last else F.lit(True))


def status(name: str) -> Column:
    return F.col("review_status") == name


def endpoint(side: str) -> Column:
    return F.coalesce(blank_to_null(F.col(f"{side}_endpoint_id")), F.col(f"{side}_account"))


def eligible() -> Column:
    """Confirmed, live, canonical money movements with both ends known; apply after canonical()."""
    related = F.coalesce("relation_type", F.lit("")).isin(*S.NON_CANONICAL_RELATIONS)
    ends = (F.coalesce(endpoint("payer"), F.lit("")) != "") & (F.coalesce(endpoint("payee"), F.lit("")) != "")
    return status("confirmed") & F.col("event_status").isin(*S.LIVE_EVENTS) & ~related & (F.col("amount") > 0) & ends


def graph_filter(query: str = "", least: float = 0, kind: str = "all", channel_name: str = "", bank_part: str = "", region_name: str = "", first: str = "", last: str = "") -> Column:
    return min_amount(least) & text_query(query) & direction(kind) & channel(channel_name) & bank(bank_part) & region(region_name) & date_range(first, last)


def edge_id() -> Column:
    return F.concat(endpoint("payer"), F.lit(">"), endpoint("payee"))


def synthetic_endpoints(df: DataFrame) -> DataFrame:
    """Merchants of card payments without a payee account and ATMs of cash records become endpoints."""
    merchant = (F.col("record_type") == "card_payment") & (F.coalesce("merchant_id", F.lit("")) != "") & (F.coalesce("payee_account", F.lit("")) == "")
    atm = F.coalesce("terminal_id", F.lit("")) != ""
    out_atm, in_atm = atm & (F.col("record_type") == "cash_withdrawal"), atm & (F.col("record_type") == "cash_deposit")
    machine = F.concat(F.lit("ATM:"), "terminal_id")
    return df.withColumns({
        "payee_endpoint_id": F.when(merchant, F.concat(F.lit("MERCHANT:"), "merchant_id")).when(out_atm, machine).otherwise(F.col("payee_endpoint_id")),
        "payee_entity_type": F.when(merchant, F.lit("merchant")).when(out_atm, F.lit("atm")).otherwise(F.col("payee_entity_type")),
        "payer_endpoint_id": F.when(in_atm, machine).otherwise(F.col("payer_endpoint_id")),
        "payer_entity_type": F.when(in_atm, F.lit("atm")).otherwise(F.col("payer_entity_type")),
    })


def blank_defaults(df: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls become blank; the currency becomes CNY."""
    return df.withColumns({c: F.coalesce(c, F.lit("CNY" if c == "currency" else "")) for c in columns})


def source_label(name: Column, page: Column, sheet: Column, row: Column) -> Column:
    return F.concat_ws(" · ", blank_to_null(name), F.concat(F.lit("p"), page.cast("string")), blank_to_null(sheet), F.concat(F.lit("r"), row.cast("string")))


def sorted_page(df: DataFrame, order: str = "time_asc", page: int = 1, size: int = 50) -> DataFrame:
    """One page in a total order: descending sorts keep the record order on ties."""
    if page < 1 or not 1 <= size <= 500:
        raise ValueError("page starts at 1; size is 1 to 500")
    return df.orderBy(*sort_keys(order)).offset((page - 1) * size).limit(size)


def placed(df: DataFrame, order: str = "time_asc") -> DataFrame:
    """Every row with its place from 1 on in the total order."""
    return places(df, sort_keys(order), "placed").orderBy("place")


def related(transaction: str = "", edge: str = "", node: str = "") -> Column:
    """Rows that belong to a selected transaction, else to an edge (payer>payee), else to an account; all rows if nothing is selected."""
    if transaction:
        return F.col("transaction_id") == transaction
    if edge:
        return F.concat("payer_account", F.lit(">"), "payee_account") == edge
    return (F.col("payer_account") == node) | (F.col("payee_account") == node) if node else F.lit(True)


def sort_keys(order: str) -> list[Column]:
    by = {"time_desc": F.desc("transaction_time"), "amount_desc": F.desc("amount")}.get(order, F.asc("transaction_time"))
    return [by, F.asc("seq")]
