"""Generated cases: spark.range and modular arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S


def _rows(base: DataFrame, payer, payee, amount, time, prefix: str) -> DataFrame:
    blank = F.lit("")
    none = F.lit(None).cast("string")
    return base.select(
        F.col("id").alias("seq"), F.concat(F.lit(prefix), F.col("id").cast("string")).alias("transaction_id"), time.cast("timestamp_ntz").alias("transaction_time"), blank.alias("serial_number"),
        payer.alias("payer_account"), F.concat(F.lit("账户"), payer).alias("payer_name"), blank.alias("payer_bank"), payee.alias("payee_account"), F.concat(F.lit("账户"), payee).alias("payee_name"), blank.alias("payee_bank"),
        F.lit("bank_account").alias("payer_entity_type"), F.lit("bank_account").alias("payee_entity_type"), none.alias("payer_endpoint_id"), none.alias("payee_endpoint_id"), F.lit("CNY").alias("currency"),
        amount.cast(S.MONEY).alias("amount"), blank.alias("channel"), blank.alias("summary"), blank.alias("region"), F.lit("success").alias("event_status"), none.alias("relation_type"), F.lit("confirmed").alias("review_status"),
    )


def benchmark(spark: SparkSession, n: int = 100_000, accounts: int = 500) -> DataFrame:
    """n transactions, one a second, over so many accounts."""
    i = F.col("id")
    name = lambda x: F.concat(F.lit("A"), (x % accounts).cast("string"))
    time = F.timestamp_seconds(F.lit(1767225600) + i)  # 2026-01-01 00:00:00
    return _rows(spark.range(n), name(i), name(7 * i + 13), 100 + i % 1000, time, "B")


def layered(spark: SparkSession, layers: tuple[int, ...] = (4, 12, 14, 14, 8), n: int = 118) -> DataFrame:
    """A demonstration case: money runs from each layer of accounts to the next; transaction i starts in layer i mod (layers - 1)."""
    i, hops = F.col("id"), len(layers) - 1
    at = i % hops
    pick = lambda layer, k: F.element_at(F.array(*(F.lit(x) for x in layers)), (layer + 1).cast("int")).cast("long")
    account = lambda layer, k: F.concat(F.lit("L"), layer.cast("string"), F.lit("-"), (k % pick(layer, k)).cast("string"))
    time = F.timestamp_seconds(F.lit(1767225600) + i * 420)
    return _rows(spark.range(n), account(at, F.floor(i / hops)), account(at + 1, i), 1000 + (i * 137) % 9000, time, "D")


#: Fixed values. Stages of the case: name, transactions, first payer, payers, first payee, payees; payee = (a * j + j div b) mod payees + c, for the j-th.
STAGES = (
    ("victim_input", 16, 0, 4, 4, 8, 3, None, 0), ("split", 32, 4, 8, 12, 8, 3, 8, 0), ("aggregate", 32, 12, 8, 20, 6, 5, 8, 0),
    ("exit", 24, 20, 6, 26, 6, 2, 6, 0), ("return", 8, 20, 6, 4, 8, 1, None, 2), ("third_party", 8, 12, 8, 26, 6, 1, None, 1),
)
#: Fixed values. Files of the case: suffix, transactions of their own, transactions repeated from other files.
FILES = ((".csv", 18, 2), (".xlsx", 18, 2), (".pdf", 14, 1), (".docx", 14, 1), (".png", 9, 1), (".xlsx", 13, 2), (".jpg", 9, 1), (".csv", 9, 1), (".pdf", 8, 2), (".docx", 8, 2))


def truth(spark: SparkSession) -> DataFrame:
    """The 120 true transactions of a case of 32 entities, with their stage."""
    i = F.col("id")
    first, payer, payee, stage = 0, F.lit(None), F.lit(None), F.lit(None)
    for name, n, payer0, payers, payee0, payees, a, b, c in reversed(STAGES):
        first = sum(s[1] for s in STAGES[: [s[0] for s in STAGES].index(name)])
        j, here = i - first, (i >= first) & (i < first + n)
        to = a * j + (F.floor(j / b) if b else F.lit(0)) + c
        payer, payee, stage = F.when(here, payer0 + j % payers).otherwise(payer), F.when(here, payee0 + to % payees).otherwise(payee), F.when(here, name).otherwise(stage)
    account = lambda k: F.concat(F.lit("62"), (17 + k % 7).cast("string"), F.lpad(k.cast("string"), 15, "0"))
    amount = 5800 + i % 11 * 3700 + (i % 3).cast(S.MONEY) * F.lit("260.50").cast(S.MONEY)
    time = F.timestamp_seconds(F.lit(1781773200) + 60 * (11 * i + i % 7))  # 2026-06-18 09:00:00
    made = _rows(spark.range(sum(s[1] for s in STAGES)).select("id", account(payer).alias("p"), account(payee).alias("q"), amount.alias("a"), time.alias("t"), stage.alias("stage")), F.col("p"), F.col("q"), F.col("a"), F.col("t"), "F")
    serial = F.concat(F.lit("SN20260618"), F.lpad((F.col("seq") + 1).cast("string"), 6, "0"))
    return made.withColumns({"serial_number": serial, "transaction_id": F.concat(F.lit("FT"), F.lpad((F.col("seq") + 1).cast("string"), 4, "0"))})


def distribution(spark: SparkSession) -> DataFrame:
    """(source_file_id, suffix, transaction_id, place): which file shows which transactions. Every file repeats some of others', none is repeated twice."""
    total, done, repeated, out = sum(f[1] for f in FILES), 0, set(), []
    for k, (suffix, own, again) in enumerate(FILES):
        mine = range(done, done + own)
        others = [t for t in ((5 + 13 * k + 17 * s) % total for s in range(total)) if t not in mine and t not in repeated][:again]
        repeated.update(others)
        out += [(f"F{k:02d}", suffix, f"FT{t + 1:04d}", 1000 * k + at) for at, t in enumerate([*mine, *others])]
        done += own
    return spark.createDataFrame(out, "source_file_id string, suffix string, transaction_id string, place long")


def appearances(spark: SparkSession) -> DataFrame:
    """truth() as the files show it: one record for each appearance, in the files' order."""
    return distribution(spark).join(truth(spark).drop("seq"), "transaction_id").withColumnRenamed("place", "seq")
