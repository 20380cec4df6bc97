"""Risk and priority scores as column expressions over nodes()."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import materialise
from . import graph

METHOD, DISCLAIMER = "internal_rules_v1", "内部规则风险提示，不构成犯罪事实或司法认定。"


def percent(c: Column) -> Column:
    return F.concat(F.bround(c * 100, 0).cast("long").cast("string"), F.lit("%"))


def _ratio() -> Column:
    i, o = F.col("incoming").cast("double"), F.col("outgoing").cast("double")
    return F.least(i, o) / F.when(i == 0, 1.0).otherwise(i)


def _factor(code: str, name, score: Column, evidence: Column) -> Column:
    return F.struct(F.lit(code).alias("code"), (name if isinstance(name, Column) else F.lit(name)).alias("name"), score.cast("int").alias("score"), evidence.alias("evidence"))


def _text(before: str, c: Column, after: str) -> Column:
    return F.concat(F.lit(before), c.cast("string"), F.lit(after))


def risk_factors() -> Column:
    c, r = F.col, _ratio()
    points = lambda when, n: F.when(when, n).otherwise(0)
    return F.array(
        _factor("rapid_transfer", "快速转出", points(c("rapid") > 0, 20), _text("入账后30分钟内转出 ", c("rapid"), " 组")),
        _factor("pass_through", F.when(r >= 0.6, "高资金穿透率").otherwise("中等资金穿透率"), F.when(r >= 0.6, 25).when(r >= 0.3, 15).otherwise(0), F.concat(F.lit("流出/流入穿透率 "), percent(r))),
        _factor("multiple_counterparties", "多收多转", points(c("counterparties") >= 4, 10), _text("关联对手账户 ", c("counterparties"), " 个")),
        _factor("split_transfer", "短时分拆", points(c("split"), 20), F.lit("60分钟内向至少3个下游转出")),
        _factor("return_flow", "资金回流", points(c("returns") > 0, 15), _text("发现回流流水 ", c("returns"), " 笔")),
        _factor("risky_signal", "风险语义命中", points(c("risky") > 0, 10), _text("摘要或渠道命中风险词 ", c("risky"), " 笔")),
    )


def priority_factors() -> Column:
    """Needs largest_direct beside the columns of nodes()."""
    c = F.col
    direct, largest = c("direct").cast("double"), c("largest_direct").cast("double")
    share = direct / F.when(largest == 0, 1.0).otherwise(largest)
    points = lambda when, n: F.when(when, n).otherwise(0)
    step = lambda x, *pairs: F.coalesce(*(F.when(x >= at, n) for at, n in pairs), F.lit(0))
    return F.array(
        _factor("direct_victim_receiver", "直接承接受害人付款", points(direct != 0, 30), F.concat(F.lit("已确认直接收款 "), F.format_number(F.bround(direct, 0), 0), F.lit(" 元"))),
        _factor("victim_fund_scale", "被害资金规模", points(direct != 0, F.greatest(F.lit(1), F.bround(10 * share, 0).cast("int"))), F.concat(F.lit("相对本案最大直接收款占比 "), percent(share))),
        _factor("aggregation", "多源资金汇聚", step(c("upstream"), (4, 15), (2, 8)), _text("上游账户 ", c("upstream"), " 个")),
        _factor("rapid_transfer", "快速过账", step(c("rapid"), (3, 15), (1, 8)), _text("30分钟内转出 ", c("rapid"), " 组")),
        _factor("split_transfer", "短时分拆", points(c("split"), 10), F.lit("60分钟内向至少3个下游转出")),
        _factor("topology_centrality", "链路交汇", step(c("counterparties"), (6, 10), (4, 5)), _text("关联上下游账户 ", c("counterparties"), " 个")),
        _factor("return_flow", "资金回流", points(c("returns") > 0, 10), _text("发现回流流水 ", c("returns"), " 笔")),
        _factor("exit_channel", "高风险出口", points(c("exits") > 0, 10), _text("流向取现、商户或支付出口 ", c("exits"), " 笔")),
    )


def _total(factors: Column) -> Column:
    return F.least(F.lit(100), F.aggregate(factors, F.lit(0), lambda a, x: a + x["score"]))


def scored(tx: DataFrame, victims: list[str] = ()) -> DataFrame:
    """nodes() with risk, priority, their levels and factors."""
    n = graph.nodes(graph.sides(tx, victims))
    # the largest direct amount of the case: a scalar subquery, one row by construction
    n = n.withColumn("largest_direct", n.select(F.max("direct")).scalar())
    hits = lambda a: F.filter(a, lambda x: x["score"] > 0)
    n = n.withColumns({"risk_factors": hits(risk_factors()), "priority_factors": hits(priority_factors())})
    n = n.withColumns({"risk": _total(F.col("risk_factors")), "priority_score": _total(F.col("priority_factors"))})
    r, p = F.col("risk"), F.col("priority_score")
    return n.withColumns({
        "risk_level": F.when(r >= 70, "高风险").when(r >= 40, "中风险").otherwise("低风险"),
        "priority_level": F.when(p >= 70, "一级重点").when(p >= 40, "二级重点").when(p >= 20, "三级关注").otherwise("常规节点"),
    })


def summary(nodes: DataFrame) -> DataFrame:
    """The node of the highest risk, the first seen on ties; defaults for an empty graph."""
    best = nodes.agg(F.max_by(F.struct("risk", "risk_level", "account", "label"), F.struct("risk", -F.col("first_ord"))).alias("b"))
    return best.select(
        F.coalesce("b.risk", F.lit(0)).alias("score"), F.coalesce("b.risk_level", F.lit("低风险")).alias("level"), F.col("b.account").alias("account_id"),
        F.coalesce("b.label", F.lit("无")).alias("account_label"), F.lit(METHOD).alias("method"), F.lit(DISCLAIMER).alias("disclaimer"),
    )


def ranked(nodes: DataFrame, k: int) -> DataFrame:
    return nodes.orderBy(F.desc("risk"), "first_ord").limit(k)


def build_graph(drafts: DataFrame, victims: list[str] = (), **filtered) -> dict[str, DataFrame]:
    """nodes (scored), edges, edge_transactions, totals and summary of the drafts' graph. The records are written once and shared by all."""
    tx = materialise(graph.topology(drafts, **filtered), "graph-records")
    nodes = materialise(scored(tx, victims), "graph-nodes")
    return {"nodes": nodes, "edges": graph.edges(tx), "edge_transactions": graph.edge_transactions(tx), "totals": graph.totals(tx), "summary": summary(nodes)}
