"""Ordered classification rules over a chunk's text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import contains_any

#: Markers of each kind of document.
PAIRED_HEADERS = (("付款账号", "收款账号"), ("付款方账号", "收款方账号"), ("转出账号", "转入账号"), ("payer_account", "payee_account"))
POS_MARKERS = ("商户号", "终端号", "授权码")
ATM_WORDS = ("atm", "取现", "存现", "自助柜员")
PAYMENT_WORDS = ("支付订单", "支付方式", "商家订单号", "支付宝", "微信支付")
BALANCE_WORDS, NOT_BALANCE = ("余额", "期初余额", "期末余额", "账户冻结"), ("交易金额", "流水号", "付款账号")
STATEMENT_WORDS = ("交易时间", "交易日期", "借贷", "流水号", "付款账号", "收款账号")
STRUCTURED_SUFFIXES = (".csv", ".xlsx", ".xls", ".pdf", ".docx")


def classify(text: Column, suffix: Column, requires_vision: Column) -> Column:
    """struct<document_type, record_type, confidence>."""
    t = F.lower(F.coalesce(text, F.lit("")))
    has = lambda w: F.contains(t, F.lit(w))
    paired = F.lit(False)
    for left, right in PAIRED_HEADERS:
        paired = paired | (has(left) & has(right))
    markers = sum((has(w).cast("int") for w in POS_MARKERS), F.lit(0))
    kind = lambda a, b: F.struct(F.lit(a).alias("document_type"), F.lit(b).alias("record_type"), F.lit(0.2 if b == "unknown" else 0.9).alias("confidence"))
    return (
        F.when(paired, kind("bank_statement", "bank_transfer"))
        .when(has("pos") | (markers >= 2), kind("pos_receipt", "card_payment"))
        .when(contains_any(t, ATM_WORDS), kind("atm_receipt", "cash_withdrawal"))
        .when(F.coalesce(requires_vision, F.lit(False)), kind("image_statement", "unknown"))
        .when(contains_any(t, PAYMENT_WORDS), kind("payment_platform_bill", "payment_order"))
        .when(contains_any(t, BALANCE_WORDS) & ~contains_any(t, NOT_BALANCE), kind("account_snapshot", "balance_snapshot"))
        .when(F.lower(suffix).isin(*STRUCTURED_SUFFIXES) | contains_any(t, STATEMENT_WORDS), kind("bank_statement", "bank_transfer"))
        .otherwise(kind("unknown", "unknown"))
    )
