"""Mixed-fund attribution: closed forms over running sums, for one source account or all at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .running import running_sum

METHODS = ("fifo", "conservative", "proportional", "possible_max")
#: Fixed value: the note that goes with every result.
DISCLAIMER = "本结果为资金研判推定，不代表银行原始事实或司法认定。"


def attribute(tx: DataFrame, victim_amount: float, prior_balance: float, source: str | None = None) -> DataFrame:
    """(payer_account, method, transaction_id, …, attributed_amount) of every outgoing row of each source account with a share.

    The share of a row is T(row) - T(row before), with C the running sum of the source's amounts in
    time order (possible_max: by amount, largest first): fifo T = min(V, C), conservative
    T = min(V, max(0, C - P)), proportional T = min(V, C * V / (V + P)) and T = V at the last row,
    possible_max as fifo. V, P >= 0. Shares that are not positive go before rounding to cents.
    """
    v, p = float(victim_amount), float(prior_balance)
    rows = tx.where(F.col("payer_account") == source) if source is not None else tx
    rows = rows.select("payer_account", "payee_account", "transaction_id", "transaction_time", "seq", "amount")
    by_time = running_sum(rows, "payer_account", [F.asc("transaction_time"), F.asc("seq")], "amount", "c")
    by_size = running_sum(rows, "payer_account", [F.desc("amount"), F.asc("transaction_time"), F.asc("seq")], "amount", "c")
    c = F.col("c").cast("double")
    before = (F.col("c") - F.col("amount")).cast("double")
    r = v / (v + p) if v + p else 0.0
    cap = lambda x: F.least(F.lit(v), x)
    zero = F.lit(0.0)
    shares = {
        "fifo": cap(c) - cap(before),
        "conservative": cap(F.greatest(zero, c - p)) - cap(F.greatest(zero, before - p)),
        "proportional": F.when(F.col("c_last"), F.lit(v)).otherwise(cap(c * r)) - cap(before * r),
    }
    out = ["payer_account", "payee_account", "transaction_id", "transaction_time", "seq", "amount"]
    timed = by_time.select(*out, F.explode(F.array(*(F.struct(F.lit(m).alias("method"), x.alias("x")) for m, x in shares.items()))).alias("s")).select(*out, "s.method", "s.x")
    sized = by_size.select(*out, F.lit("possible_max").alias("method"), (cap(c) - cap(before)).alias("x"))
    return timed.unionByName(sized).where("x > 0").withColumn("attributed_amount", F.col("x").cast("decimal(18,2)")).drop("x")


def summarise(shares: DataFrame, victim_amount: float) -> DataFrame:
    v = F.lit(float(victim_amount)).cast("decimal(18,2)")
    total = F.least(v, F.sum("attributed_amount"))
    return shares.groupBy("payer_account", "method").agg(F.count("*").alias("n_edges"), total.cast("double").alias("total_attributed"), F.greatest(F.lit(0).cast("decimal(18,2)"), v - total).cast("double").alias("remaining_amount"), F.lit(True).alias("is_inference"), F.lit(DISCLAIMER).alias("disclaimer"))
