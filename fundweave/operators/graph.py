"""The fund-flow graph: edges, nodes and the time windows of each account."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.text import blank_to_null, contains_any
from .dedup import canonical
from .filters import edge_id, eligible, endpoint, graph_filter

#: Width of a time bucket. A busy account's rows are spread over its buckets; a bucket also sees the rows just before it.
BUCKET_MINUTES = 6 * 60


def edge_totals(tx: DataFrame) -> DataFrame:
    """edges() without the lists of transactions: sums are made before the shuffle, and no row grows with the data."""
    ends = tx.select(endpoint("payer").alias("source"), endpoint("payee").alias("target"), "seq", "amount", "transaction_time")
    got = ends.groupBy("source", "target").agg(F.sum("amount").alias("amount"), F.count("*").alias("count"), F.min("transaction_time").alias("first_transaction_time"), F.min("seq").alias("first_seq"))
    return got.withColumn("id", F.concat("source", F.lit(">"), "target"))


def edge_transactions(tx: DataFrame) -> DataFrame:
    """(id, seq, transaction_id): which transactions an edge has, as rows, for edges with too many for one list."""
    return tx.select(edge_id().alias("id"), "seq", "transaction_id")


def edges(tx: DataFrame) -> DataFrame:
    """Edges with the list of their transactions in one row; edge_totals() and edge_transactions() are the form without lists."""
    return (
        tx.select(endpoint("payer").alias("source"), endpoint("payee").alias("target"), "seq", "transaction_id", "amount", "transaction_time")
        .groupBy("source", "target")
        .agg(
            F.sum("amount").alias("amount"), F.count("*").alias("count"),
            F.transform(F.array_sort(F.collect_list(F.struct("seq", "transaction_id"))), lambda x: x["transaction_id"]).alias("transaction_ids"),
            F.min("transaction_time").alias("first_transaction_time"), F.min("seq").alias("first_seq"),
        )
        .withColumn("id", F.concat("source", F.lit(">"), "target"))
    )


def sides(tx: DataFrame, victims: list[str] = ()) -> DataFrame:
    """Two rows for each transaction, one for each end. A self-loop is seen twice by its account."""
    side = lambda me, out: F.struct(
        endpoint(me).alias("account"), F.lit(out).alias("is_out"), (F.col("seq") * 2 + (0 if out else 1)).alias("ord"),
        F.coalesce(blank_to_null(F.col(f"{me}_name")), endpoint(me)).alias("label"), F.col(f"{me}_bank").alias("bank"),
        (F.when(endpoint("payer") == endpoint("payee"), F.col("payer_entity_type")).otherwise(F.col(f"{me}_entity_type"))).alias("entity_type"),
        F.col(f"{'payee' if out else 'payer'}_account").alias("other"),
    )
    texts = F.concat_ws(" ", F.coalesce("summary", F.lit("")), F.coalesce("channel", F.lit("")))
    exits = F.concat_ws(" ", texts, F.coalesce("payee_name", F.lit("")))
    base = tx.select(
        "amount", "transaction_time", F.contains("summary", F.lit(S.RETURN_WORD)).alias("is_return"), contains_any(texts, S.RISK_WORDS).alias("is_risky"),
        contains_any(exits, S.EXIT_WORDS).alias("is_exit"), F.col("payer_account").isin(*victims).alias("from_victim") if victims else F.lit(False).alias("from_victim"),
        F.explode(F.array(side("payer", True), side("payee", False))).alias("s"),
    )
    return base.select("s.*", *[c for c in base.columns if c != "s"])


def _bucketed(rows: DataFrame, minutes: int, halo: Column) -> DataFrame:
    """rows with t (microseconds), bucket and own. Rows where halo holds, of the last `minutes` of a bucket, come again, not own, in the next."""
    width, t = BUCKET_MINUTES * 60_000_000, F.unix_micros(F.col("transaction_time").cast("timestamp"))
    rows = rows.withColumn("t", t).withColumn("bucket", F.floor(F.col("t") / width))
    near = halo & (F.col("t") >= (F.col("bucket") + 1) * width - minutes * 60_000_000)
    copies = F.when(near, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = rows.withColumn("__k", F.explode(copies))
    return rows.withColumns({"bucket": F.col("bucket") + F.col("__k"), "own": F.col("__k") == 0}).drop("__k")


def _before(minutes: int):
    return Window.partitionBy("account", "bucket").orderBy("t").rangeBetween(-minutes * 60_000_000, 0)


def rapid_pairs(both: DataFrame) -> DataFrame:
    """(account, rapid): pairs of an incoming and an outgoing row at most 30 minutes later, both ends included."""
    rows = _bucketed(both.select("account", "is_out", "transaction_time"), S.RAPID_MINUTES, ~F.col("is_out"))
    seen = F.sum(F.when(~F.col("is_out"), 1).otherwise(0)).over(_before(S.RAPID_MINUTES))
    return rows.withColumn("n", seen).where("is_out and own").groupBy("account").agg(F.sum("n").alias("rapid"))


def splits(both: DataFrame) -> DataFrame:
    """(account, split): whether some 60 minutes hold three or more outgoing rows."""
    rows = _bucketed(both.where("is_out").select("account", "transaction_time"), S.SPLIT_MINUTES, F.lit(True))
    return rows.withColumn("n", F.count("*").over(_before(S.SPLIT_MINUTES))).where("own").groupBy("account").agg((F.max("n") >= S.SPLIT_COUNT).alias("split"))


def rapid_range_join(tx: DataFrame) -> DataFrame:
    """rapid_pairs() as a range join: rows meet by account and half-hour slot, so a pair of rows is looked at only if it is near in time."""
    slot = lambda c: F.floor(F.unix_seconds(F.col(c).cast("timestamp")) / (60 * S.RAPID_MINUTES))
    out = tx.select(endpoint("payer").alias("account"), F.col("transaction_time").alias("t_out")).withColumn("slot", slot("t_out"))
    into = tx.select(endpoint("payee").alias("account"), F.col("transaction_time").alias("t_in"))
    into = into.withColumn("slot", F.explode(F.array(slot("t_in"), slot("t_in") + 1)))
    near = (F.col("t_out") >= F.col("t_in")) & (F.col("t_out") <= F.col("t_in") + F.expr(f"INTERVAL {S.RAPID_MINUTES} MINUTES"))
    return out.join(into, ["account", "slot"]).where(near).groupBy("account").agg(F.count("*").alias("rapid"))


def nodes(both: DataFrame) -> DataFrame:
    """One row for each account with all that the scores need."""
    first = F.min_by(F.struct("label", "bank", "entity_type"), "ord")
    incoming, outgoing = ~F.col("is_out"), F.col("is_out")
    zero = F.lit(0).cast(S.MONEY)
    got = both.groupBy("account").agg(
        first.alias("f"), F.min("ord").alias("first_ord"),
        F.coalesce(F.sum(F.when(incoming, F.col("amount"))), zero).alias("incoming"), F.coalesce(F.sum(F.when(outgoing, F.col("amount"))), zero).alias("outgoing"),
        F.coalesce(F.sum(F.when(incoming & F.col("from_victim"), F.col("amount"))), zero).alias("direct"),
        F.count_if("is_return").alias("returns"), F.count_if("is_risky").alias("risky"), F.count_if(outgoing & F.col("is_exit")).alias("exits"),
    )
    pairs = both.groupBy("account", "other").agg(F.max(incoming).alias("up"))
    parties = pairs.groupBy("account").agg(F.count("*").alias("counterparties"), F.count_if("up").alias("upstream"))
    out = got.join(parties, "account").join(rapid_pairs(both), "account", "left").join(splits(both), "account", "left")
    return out.select(
        "account", F.col("f.label").alias("label"), F.col("f.bank").alias("bank"), F.col("f.entity_type").alias("entity_type"), "first_ord", "incoming", "outgoing", "direct",
        "returns", "risky", "exits", "counterparties", "upstream", F.coalesce("rapid", F.lit(0)).alias("rapid"), F.coalesce("split", F.lit(False)).alias("split"),
    )


def topology(drafts: DataFrame, **filtered) -> DataFrame:
    """The records of a graph: one of each duplicate group, eligible, and within the filters of graph_filter()."""
    return canonical(drafts).where(eligible()).where(graph_filter(**filtered))


def in_time_order(edge_rows: DataFrame) -> DataFrame:
    """Edges as they are played back: by first transaction, then by first sight."""
    return edge_rows.orderBy("first_transaction_time", "first_seq")


def totals(tx: DataFrame) -> DataFrame:
    return tx.agg(F.count("*").alias("transaction_count"), F.coalesce(F.sum("amount"), F.lit(0)).cast("double").alias("total_amount"))
