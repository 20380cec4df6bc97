"""Transactions made from the events table: a deterministic stand-in for a case's drafts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One confirmed transaction for each event with a positive value; payees follow a fixed rule over user ids."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value")
    n = ev.select(F.max("user_id") + 1).scalar()
    k = F.col("event_id") % (1 + F.col("user_id") % 4)
    step = F.when(k == 0, 1).when(k == 1, 2).when(k == 2, 5).otherwise(n - 3)
    payee = (F.col("user_id") + step) % n
    u, e = F.col("user_id"), F.col("event_id")
    words = F.when(F.col("event_type") == "purchase", "商户消费").when(F.col("event_type") == "view", "资金回流").when(F.col("event_type") == "click", "资金拆分").otherwise("跨行转账")
    named = lambda p, x: F.concat(F.lit(p), x.cast("string"))
    return ev.where("value > 0").select(
        e.alias("seq"), named("T", e).alias("transaction_id"), F.lit("bank_transfer").alias("record_type"), F.col("ts").alias("transaction_time"), named("S", e).alias("serial_number"),
        named("U", u).alias("payer_account"), named("户", u).alias("payer_name"), named("行", u % 5).alias("payer_bank"),
        named("U", payee).alias("payee_account"), named("户", payee).alias("payee_name"), named("行", payee % 5).alias("payee_bank"),
        F.lit("bank_account").alias("payer_entity_type"), F.lit("bank_account").alias("payee_entity_type"),
        F.lit(None).cast("string").alias("payer_endpoint_id"), F.lit(None).cast("string").alias("payee_endpoint_id"),
        F.lit("CNY").alias("currency"), F.col("value").cast(S.MONEY).alias("amount"),
        F.when(e % 3 == 0, "手机银行").when(e % 3 == 1, "网银").otherwise("柜台").alias("channel"), words.alias("summary"), named("区", u % 7).alias("region"),
        F.when(F.col("event_type") == "error", "failed").otherwise("success").alias("event_status"), F.lit(None).cast("string").alias("relation_type"), F.lit("confirmed").alias("review_status"),
    )


def two_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """transactions() of source A, every tenth again from source B, one in five of those with another amount; statuses vary."""
    a = transactions(spark, sf_dir)
    e = F.col("seq")
    status = F.when(e % 7 == 1, "pending").when(e % 7 == 2, "rejected").when(e % 7 == 3, "conflict").otherwise("confirmed")
    a = a.withColumn("review_status", status)
    b = a.where(e % 10 == 0).withColumns({
        "seq": e + 10**9, "transaction_id": F.concat("transaction_id", F.lit("B")),
        "amount": F.when(e % 50 == 0, F.col("amount") + 1).otherwise(F.col("amount")).cast(S.MONEY), "review_status": F.lit("pending"),
    })
    return a.withColumn("source_file_id", F.lit("A")).unionByName(b.withColumn("source_file_id", F.lit("B")))
