"""The registered queries over the fund-flow operators, each with the SQL that gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import classify as C
from ..functions import parse, text
from ..operators import attribution, dedup, filters, graph, layout, reconcile, running, scoring, trace
from ..scratch import materialise, scratch_dir
from ..sources import adapter, csv_rows, files, generators, repository
from ..streaming import ingest as stream

VICTIMS = ["U0", "U5", "U10"]
V, P = 5000.0, 2000.0
SOURCE, START, END, HOPS = "U0", "U0", "U9", 3

TX = """
n AS (SELECT max(user_id) + 1 AS n FROM events),
tx0 AS (SELECT event_id, ts, user_id, event_type, value, n, event_id % (1 + user_id % 4) AS k FROM events, n WHERE value > 0),
tx1 AS (SELECT *, (user_id + CASE k WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 5 ELSE n - 3 END) % n AS payee FROM tx0),
tx AS (SELECT event_id AS seq, 'T' || event_id AS transaction_id, ts AS transaction_time, 'S' || event_id AS serial_number,
 'U' || user_id AS payer_account, '户' || user_id AS payer_name, '行' || user_id % 5 AS payer_bank, 'U' || payee AS payee_account, '户' || payee AS payee_name, '行' || payee % 5 AS payee_bank,
 CAST(value AS DECIMAL(18,2)) AS amount, CASE event_id % 3 WHEN 0 THEN '手机银行' WHEN 1 THEN '网银' ELSE '柜台' END AS channel,
 CASE event_type WHEN 'purchase' THEN '商户消费' WHEN 'view' THEN '资金回流' WHEN 'click' THEN '资金拆分' ELSE '跨行转账' END AS summary,
 '区' || user_id % 7 AS region, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS event_status, 'confirmed' AS review_status FROM tx1),
live AS (SELECT * FROM tx WHERE event_status = 'success' AND amount > 0)"""
TWO = """
a AS (SELECT * REPLACE (CASE seq % 7 WHEN 1 THEN 'pending' WHEN 2 THEN 'rejected' WHEN 3 THEN 'conflict' ELSE 'confirmed' END AS review_status), 'A' AS source_file_id FROM tx),
b AS (SELECT * REPLACE (seq + 1000000000 AS seq, transaction_id || 'B' AS transaction_id, CAST(CASE WHEN seq % 50 = 0 THEN amount + 1 ELSE amount END AS DECIMAL(18,2)) AS amount, 'pending' AS review_status, 'B' AS source_file_id) FROM a WHERE seq % 10 = 0),
two AS (SELECT * FROM a UNION ALL SELECT * FROM b),
marked AS (SELECT *, count(*) OVER (PARTITION BY serial_number, amount) AS same, count(*) OVER (PARTITION BY serial_number) AS all_same FROM two)"""
SIDES = f"""
sides AS (SELECT payer_account AS account, true AS is_out, 2 * seq AS ord, payer_name AS label, payee_account AS other, * FROM live UNION ALL SELECT payee_account, false, 2 * seq + 1, payee_name, payer_account, * FROM live),
rapid AS (SELECT o.payer_account AS account, count(*) AS rapid FROM live o JOIN live i ON i.payee_account = o.payer_account AND o.transaction_time BETWEEN i.transaction_time AND i.transaction_time + INTERVAL 30 MINUTE GROUP BY 1),
split AS (SELECT payer_account AS account, max(c) >= 3 AS split FROM (SELECT payer_account, count(*) OVER (PARTITION BY payer_account ORDER BY transaction_time RANGE BETWEEN INTERVAL 60 MINUTE PRECEDING AND CURRENT ROW) AS c FROM live) GROUP BY 1),
nodes0 AS (SELECT account, arg_min(label, ord) AS label, min(ord) AS first_ord, CAST(coalesce(sum(amount) FILTER (WHERE NOT is_out), 0) AS DOUBLE) AS incoming, CAST(coalesce(sum(amount) FILTER (WHERE is_out), 0) AS DOUBLE) AS outgoing,
 CAST(coalesce(sum(amount) FILTER (WHERE NOT is_out AND payer_account IN ({', '.join(f"'{v}'" for v in VICTIMS)})), 0) AS DOUBLE) AS direct,
 count(*) FILTER (WHERE contains(summary, '{S.RETURN_WORD}')) AS returns, count(*) FILTER (WHERE {' OR '.join(f"contains(summary || ' ' || channel, '{w}')" for w in S.RISK_WORDS)}) AS risky,
 count(*) FILTER (WHERE is_out AND ({' OR '.join(f"contains(summary || ' ' || channel || ' ' || payee_name, '{w}')" for w in S.EXIT_WORDS)})) AS exits,
 count(DISTINCT other) AS counterparties, count(DISTINCT other) FILTER (WHERE NOT is_out) AS upstream FROM sides GROUP BY account),
nodes1 AS (SELECT nodes0.*, coalesce(rapid, 0) AS rapid, coalesce(split, false) AS split, least(incoming, outgoing) / CASE WHEN incoming = 0 THEN 1 ELSE incoming END AS ratio, max(direct) OVER () AS largest FROM nodes0 LEFT JOIN rapid USING (account) LEFT JOIN split USING (account)),
nodes2 AS (SELECT *, direct / CASE WHEN largest = 0 THEN 1 ELSE largest END AS share FROM nodes1),
pts AS (SELECT *, CASE WHEN rapid > 0 THEN 20 ELSE 0 END AS r1, CASE WHEN ratio >= 0.6 THEN 25 WHEN ratio >= 0.3 THEN 15 ELSE 0 END AS r2, CASE WHEN counterparties >= 4 THEN 10 ELSE 0 END AS r3, CASE WHEN split THEN 20 ELSE 0 END AS r4,
 CASE WHEN returns > 0 THEN 15 ELSE 0 END AS r5, CASE WHEN risky > 0 THEN 10 ELSE 0 END AS r6, CASE WHEN direct <> 0 THEN 30 ELSE 0 END AS p1, CASE WHEN direct <> 0 THEN greatest(1, CAST(round_even(10 * share, 0) AS INT)) ELSE 0 END AS p2,
 CASE WHEN upstream >= 4 THEN 15 WHEN upstream >= 2 THEN 8 ELSE 0 END AS p3, CASE WHEN rapid >= 3 THEN 15 WHEN rapid >= 1 THEN 8 ELSE 0 END AS p4, CASE WHEN split THEN 10 ELSE 0 END AS p5,
 CASE WHEN counterparties >= 6 THEN 10 WHEN counterparties >= 4 THEN 5 ELSE 0 END AS p6, CASE WHEN returns > 0 THEN 10 ELSE 0 END AS p7, CASE WHEN exits > 0 THEN 10 ELSE 0 END AS p8 FROM nodes2),
scored AS (SELECT *, CAST(least(100, r1 + r2 + r3 + r4 + r5 + r6) AS INT) AS risk, CAST(least(100, p1 + p2 + p3 + p4 + p5 + p6 + p7 + p8) AS INT) AS priority_score FROM pts),
levels AS (SELECT *, CASE WHEN risk >= 70 THEN '高风险' WHEN risk >= 40 THEN '中风险' ELSE '低风险' END AS risk_level, CASE WHEN priority_score >= 70 THEN '一级重点' WHEN priority_score >= 40 THEN '二级重点' WHEN priority_score >= 20 THEN '三级关注' ELSE '常规节点' END AS priority_level FROM scored)"""
SHARES = f"""
runs AS (SELECT payer_account, transaction_id, seq, amount, CAST(sum(amount) OVER w AS DOUBLE) AS c, CAST(sum(amount) OVER w - amount AS DOUBLE) AS b, row_number() OVER w = count(*) OVER (PARTITION BY payer_account) AS last,
 CAST(sum(amount) OVER s AS DOUBLE) AS sc, CAST(sum(amount) OVER s - amount AS DOUBLE) AS sb FROM tx
 WINDOW w AS (PARTITION BY payer_account ORDER BY transaction_time, seq ROWS UNBOUNDED PRECEDING), s AS (PARTITION BY payer_account ORDER BY amount DESC, transaction_time, seq ROWS UNBOUNDED PRECEDING)),
shares0 AS (SELECT payer_account, transaction_id, 'fifo' AS method, least({V}::DOUBLE, c) - least({V}::DOUBLE, b) AS x FROM runs
 UNION ALL SELECT payer_account, transaction_id, 'conservative', least({V}::DOUBLE, greatest(0::DOUBLE, c - {P}::DOUBLE)) - least({V}::DOUBLE, greatest(0::DOUBLE, b - {P}::DOUBLE)) FROM runs
 UNION ALL SELECT payer_account, transaction_id, 'proportional', CASE WHEN last THEN {V}::DOUBLE ELSE least({V}::DOUBLE, c * ({V}::DOUBLE / {V + P}::DOUBLE)) END - least({V}::DOUBLE, b * ({V}::DOUBLE / {V + P}::DOUBLE)) FROM runs
 UNION ALL SELECT payer_account, transaction_id, 'possible_max', least({V}::DOUBLE, sc) - least({V}::DOUBLE, sb) FROM runs),
shares AS (SELECT payer_account, transaction_id, method, CAST(CAST(x AS DECIMAL(18,2)) AS DOUBLE) AS attributed_amount, CAST(x AS DECIMAL(18,2)) AS d FROM shares0 WHERE x > 0)"""
_dbl = lambda c="amount": F.col(c).cast("double").alias(c)
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, ctes: str = TX):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = f"WITH RECURSIVE {ctes.strip()}\n{sql}" if ctes else sql
        return f

    return add


def live(spark: SparkSession, sf: str) -> DataFrame:
    return adapter.transactions(spark, sf).where(filters.eligible())


def drafts(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.mark(adapter.two_sources(spark, sf))


def _filter(name: str, predicate, where: str) -> None:
    query(name, f"SELECT transaction_id, CAST(amount AS DOUBLE) AS amount FROM tx WHERE {where}")(lambda s, sf: adapter.transactions(s, sf).where(predicate()).select("transaction_id", _dbl()))


_filter("flt_min_amount", lambda: filters.min_amount(100), "amount >= 100")
_filter("flt_text_query", lambda: filters.text_query(" 户1 "), "contains(lower(concat_ws(' ', serial_number, payer_account, payer_name, payee_account, payee_name, summary)), '户1')")
_filter("flt_direction", lambda: filters.direction("return"), "contains(summary, '回流')")
_filter("flt_direction_forward", lambda: filters.direction("forward"), "NOT contains(summary, '回流')")
_filter("flt_channel", lambda: filters.channel("网银"), "channel = '网银'")
_filter("flt_bank", lambda: filters.bank("行3"), "contains(payer_bank, '行3') OR contains(payee_bank, '行3')")
_filter("flt_region", lambda: filters.region("区2"), "region = '区2'")
_filter("flt_date_range", lambda: filters.date_range("2024-01-02", "2024-01-20"), "strftime(transaction_time, '%Y-%m-%d') BETWEEN '2024-01-02' AND '2024-01-20'")
_filter("flt_topology", lambda: filters.eligible(), "event_status = 'success' AND amount > 0")
_filter("flt_evidence", lambda: F.col("transaction_id") == "T42", "transaction_id = 'T42'")
_filter("flt_related", lambda: filters.related(node="U1"), "payer_account = 'U1' OR payee_account = 'U1'")
_filter("flt_related_edge", lambda: filters.related(edge="U0>U1", node="U2"), "payer_account = 'U0' AND payee_account = 'U1'")
_filter("flt_related_tx", lambda: filters.related("T42", "U0>U1"), "transaction_id = 'T42'")
_filter("flt_combined", lambda: filters.graph_filter("户", 50, "forward", "柜台"), "amount >= 50 AND NOT contains(summary, '回流') AND channel = '柜台'")

_ENDS = "coalesce(nullif(CASE seq % 5 WHEN 0 THEN 'E' || seq WHEN 1 THEN '' END, ''), CASE WHEN seq % 11 <> 0 THEN payer_account END)"


@query("flt_topology_relations", f"""SELECT transaction_id, {_ENDS} || '>' || payee_account AS id FROM tx WHERE {_ENDS} <> '' AND amount > 0 AND event_status = 'success' AND seq % 7 NOT IN (1, 2) AND seq % 13 NOT IN (3, 4)
UNION ALL SELECT transaction_id, {_ENDS} || '>' || payee_account FROM tx WHERE {_ENDS} <> '' AND amount > 0 AND event_status <> 'success' AND seq % 2 = 0 AND seq % 7 NOT IN (1, 2) AND seq % 13 NOT IN (3, 4)""")
def flt_topology_relations(spark, sf):
    at = lambda n, *values: F.coalesce(*(F.when(F.col("seq") % n == k, F.lit(v)) for k, v in values))
    t = adapter.transactions(spark, sf).withColumns({
        "payer_endpoint_id": F.when(F.col("seq") % 5 == 0, F.concat(F.lit("E"), "seq")).when(F.col("seq") % 5 == 1, ""), "payer_account": F.when(F.col("seq") % 11 != 0, F.col("payer_account")),
        "relation_type": at(7, (1, "same_business_event"), (2, "corroborates"), (3, "derived"), (4, "")), "review_status": F.coalesce(at(13, (3, "pending"), (4, "rejected")), F.lit("confirmed")),
        "event_status": F.when((F.col("event_status") != "success") & (F.col("seq") % 2 == 0), "returned").otherwise(F.col("event_status")),
    })
    return t.where(filters.eligible()).select("transaction_id", filters.edge_id().alias("id"))


query("flt_status", "SELECT transaction_id FROM two WHERE review_status = 'pending'", f"{TX}, {TWO}")(lambda s, sf: adapter.two_sources(s, sf).where(filters.status("pending")).select("transaction_id"))
query("flt_pending_count", "SELECT count(*) FILTER (WHERE review_status NOT IN ('confirmed', 'rejected')) AS n FROM two", f"{TX}, {TWO}")(
    lambda s, sf: adapter.two_sources(s, sf).agg(F.count_if(~F.col("review_status").isin("confirmed", "rejected")).alias("n"))
)
query("flt_seed_candidates", f"SELECT transaction_id FROM two WHERE review_status = 'confirmed' AND payer_account IN ({', '.join(repr(v) for v in VICTIMS)}) AND (contains(payer_name, '户5') OR contains(payee_name, '户5')) ORDER BY seq LIMIT 24", f"{TX}, {TWO}")(
    lambda s, sf: adapter.two_sources(s, sf).where(filters.status("confirmed") & F.col("payer_account").isin(VICTIMS) & (F.contains("payer_name", F.lit("户5")) | F.contains("payee_name", F.lit("户5")))).orderBy("seq").limit(24).select("transaction_id")
)
query("prj_edge_id", "SELECT transaction_id, payer_account || '>' || payee_account AS id FROM tx")(lambda s, sf: adapter.transactions(s, sf).select("transaction_id", filters.edge_id().alias("id")))
query("prj_account_mask", "SELECT c_custkey, CASE WHEN length(c_name) > 8 THEN left(c_name, 4) || repeat('*', length(c_name) - 8) || right(c_name, 4) ELSE c_name END AS masked FROM customer", "")(
    lambda s, sf: s.read.parquet(f"{sf}/customer.parquet").select("c_custkey", text.mask_account(F.col("c_name")).alias("masked"))
)
query("nrm_account", r"SELECT c_custkey, regexp_replace(c_name, '[^\p{L}\p{N}]', '', 'g') AS cleaned FROM customer", "")(
    lambda s, sf: s.read.parquet(f"{sf}/customer.parquet").select("c_custkey", text.clean_account(F.col("c_name")).alias("cleaned"))
)
query("nrm_amount", "SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS amount FROM orders", "")(
    lambda s, sf: s.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", parse.amount(F.concat(F.lit("¥("), F.format_number("o_totalprice", 2), F.lit(")"))).cast("double").alias("amount"))
)
query("nrm_datetime", "SELECT o_orderkey, CAST(o_orderdate AS TIMESTAMP) AS t FROM orders", "")(
    lambda s, sf: s.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", parse.time(F.date_format("o_orderdate", "yyyy年M月d日HH:mm:ss")).alias("t"))
)
# statement cells as files spell them, by order: what the parsers make of each is known from the order itself
_PRICE = "CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE)"


@query("nrm_amount_forms", f"SELECT o_orderkey, CASE WHEN o_orderkey % 10 < 6 THEN {_PRICE} WHEN o_orderkey % 10 = 6 THEN CAST(o_orderkey AS DOUBLE) END AS amount FROM orders", "")
def nrm_amount_forms(spark, sf):
    price, key = F.format_number("o_totalprice", 2), F.col("o_orderkey").cast("string")
    plain = F.replace(price, F.lit(","), F.lit(""))
    around = lambda a, x, b="": F.concat(F.lit(a), x, F.lit(b))
    cells = [price, plain, around("-", plain), around("(", price, ")"), around("人民币 ", price, " 元"), around("（￥", plain, "）"), key, F.rpad(around("6222021234567890", key), 19, "1"), around("1-", plain), F.lit("n/a")]
    cell = F.coalesce(*(F.when(F.col("o_orderkey") % 10 == k, c) for k, c in enumerate(cells)))
    return spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", parse.amount(cell).cast("double").alias("amount"))


@query("nrm_datetime_forms", """SELECT o_orderkey, strftime(CASE WHEN k < 4 THEN day + to_seconds(second) WHEN k = 4 THEN day + to_minutes(second // 60) WHEN k < 7 THEN day WHEN k = 7 THEN day + to_seconds(second) + to_milliseconds(250) WHEN k = 8 THEN TIMESTAMP '2026-03-08 02:30:00' END, '%Y-%m-%d %H:%M:%S.%g') AS t
FROM (SELECT o_orderkey, o_orderkey % 11 AS k, date_trunc('day', o_orderdate) AS day, o_orderkey * 7919 % 86400 AS second FROM orders)""", "")
def nrm_datetime_forms(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    at = F.col("o_orderkey") * 7919 % 86400
    clock = F.concat_ws(":", *(F.lpad((F.floor(at / size) % most).cast("string"), 2, "0") for size, most in ((3600, 24), (60, 60), (1, 60))))
    day = lambda form: F.date_format("o_orderdate", form)
    cells = [
        F.concat(day("yyyy-MM-dd "), clock), F.concat(day("yyyy/M/d-"), clock), F.concat(day("yyyy年M月d日"), clock), F.concat(day("yyyy-MM-dd'T'"), clock, F.lit("+08:00")),
        F.concat(day("yyyy-M-d "), F.substring(clock, 1, 5)), day("yyyyMMdd"), day(" yyyy年MM月dd日 "), F.concat(day("yyyy-MM-dd "), clock, F.lit(".250")),
        F.lit("2026-03-08 02:30:00"), F.lit("2024-13-45"), F.lit("昨天"),
    ]
    cell = F.coalesce(*(F.when(F.col("o_orderkey") % 11 == k, c) for k, c in enumerate(cells)))
    return o.select("o_orderkey", F.date_format(parse.time(cell), "yyyy-MM-dd HH:mm:ss.SSS").alias("t"))


_CLASSES = [  # text, suffix, seen as an image only, document type, record type
    ("付款账号 12 收款账号 34 POS", ".jpg", True, "bank_statement", "bank_transfer"), ("PAYER_ACCOUNT,payee_account", ".txt", False, "bank_statement", "bank_transfer"), ("Pos 小票", ".txt", False, "pos_receipt", "card_payment"),
    ("商户号 1 授权码 2", ".jpg", True, "pos_receipt", "card_payment"), ("ATM 回执", ".txt", False, "atm_receipt", "cash_withdrawal"), ("自助柜员机 商户号", ".png", True, "atm_receipt", "cash_withdrawal"),
    ("微信支付", ".png", True, "image_statement", "unknown"), ("微信支付 余额", ".pdf", False, "payment_platform_bill", "payment_order"), ("期末余额", ".csv", False, "account_snapshot", "balance_snapshot"),
    ("余额 交易金额", ".txt", False, "unknown", "unknown"), ("余额 流水号", ".txt", False, "bank_statement", "bank_transfer"), ("x", ".CSV", False, "bank_statement", "bank_transfer"), ("借贷", ".txt", False, "bank_statement", "bank_transfer"),
    ("付款账号 商户号", ".txt", False, "bank_statement", "bank_transfer"), ("x", ".txt", False, "unknown", "unknown"),
]
_of_class = lambda k: "CASE " + " ".join(f"WHEN o_orderkey % {len(_CLASSES)} = {i} THEN '{c[k]}'" for i, c in enumerate(_CLASSES)) + " END"


@query("cls_all_rules", f"SELECT o_orderkey, {_of_class(3)} AS document_type, {_of_class(4)} AS record_type FROM orders", "")
def cls_all_rules(spark, sf):
    cell = lambda k: F.coalesce(*(F.when(F.col("o_orderkey") % len(_CLASSES) == i, F.lit(c[k])) for i, c in enumerate(_CLASSES)))
    got = C.classify(F.concat(cell(0), F.lit(" "), F.col("o_orderkey").cast("string")), cell(1), cell(2))
    return spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", got["document_type"].alias("document_type"), got["record_type"].alias("record_type"))


query("cls_rules", "SELECT doc_id, CASE WHEN contains(lower(text), 'pos') THEN 'card_payment' WHEN contains(lower(text), 'atm') THEN 'cash_withdrawal' ELSE 'unknown' END AS record_type FROM documents", "")(
    lambda s, sf: s.read.parquet(f"{sf}/documents.parquet").select("doc_id", C.classify(F.col("text"), F.lit(".txt"), F.lit(False))["record_type"].alias("record_type"))
)


@query("nrm_rows", "SELECT seq, transaction_id, CASE WHEN seq % 10 = 1 THEN '缺少付款账号或收款账号' WHEN seq % 10 = 2 THEN '缺少或无法解析交易时间' WHEN seq % 10 = 3 THEN '缺少或无法解析交易金额' END AS reject_reason, CASE WHEN seq % 10 = 3 THEN 0 ELSE CAST(amount AS DOUBLE) END AS amount FROM tx")
def nrm_rows(spark, sf):
    at = F.col("seq") % 10
    rows = adapter.transactions(spark, sf).select("seq", "transaction_id", F.create_map(
        F.lit("付款账号"), F.when(at == 1, "").otherwise(F.col("payer_account")), F.lit("转入账户"), F.col("payee_account"), F.lit("交易 日期"), F.when(at == 2, "x").otherwise(F.date_format("transaction_time", "yyyy/MM/dd HH:mm:ss")),
        F.lit("支出金额"), F.when(at == 3, "0").otherwise(F.concat(F.lit("¥"), F.col("amount").cast("string"))),
    ).alias("row_data"))
    return parse.normalise_rows(rows).select("seq", "transaction_id", "reject_reason", F.col("amount").cast("double").alias("amount"))


query("agg_edges", "SELECT payer_account AS source, payee_account AS target, CAST(sum(amount) AS DOUBLE) AS amount, count(*) AS count, min(transaction_time) AS first_transaction_time, string_agg(transaction_id, ',' ORDER BY seq) AS transaction_ids FROM live GROUP BY ALL")(
    lambda s, sf: graph.edges(live(s, sf)).select("source", "target", _dbl(), "count", "first_transaction_time", F.array_join("transaction_ids", ",").alias("transaction_ids"))
)
_NODE = ["account", "label", "returns", "risky", "exits", "counterparties", "upstream", "rapid", "split"]
query("agg_nodes", f"SELECT {', '.join(_NODE)}, incoming, outgoing, direct FROM nodes1", f"{TX}, {SIDES}")(
    lambda s, sf: graph.nodes(graph.sides(live(s, sf), VICTIMS)).select(*_NODE, *map(_dbl, ("incoming", "outgoing", "direct")))
)
query("agg_totals", "SELECT count(*) AS transaction_count, CAST(sum(amount) AS DOUBLE) AS total_amount FROM live")(lambda s, sf: graph.totals(live(s, sf)))
query("agg_direct_victim", "SELECT max(direct) AS largest FROM nodes1", f"{TX}, {SIDES}")(lambda s, sf: graph.nodes(graph.sides(live(s, sf), VICTIMS)).agg(F.max("direct").cast("double").alias("largest")))
query("win_rapid", "SELECT account, rapid FROM rapid", f"{TX}, {SIDES}")(lambda s, sf: graph.rapid_pairs(graph.sides(live(s, sf))).where("rapid > 0"))
query("win_split", "SELECT account, split FROM split", f"{TX}, {SIDES}")(lambda s, sf: graph.splits(graph.sides(live(s, sf))))


@query("win_rapid_rangejoin", "SELECT account, rapid FROM rapid", f"{TX}, {SIDES}")
def win_rapid_rangejoin(spark, sf):
    t = live(spark, sf)
    return graph.rapid_range_join(t)



_GROUP = "CASE WHEN same > 1 THEN 'DUP-' || upper(left(sha256('serial|' || serial_number || '|' || strftime(transaction_time, '%Y-%m-%dT%H:%M:%S') || '|' || payer_account || '|' || payee_account || '|CNY|' || amount), 12)) END"
query("ded_groups", f"SELECT transaction_id, {_GROUP} AS duplicate_group FROM marked", f"{TX}, {TWO}")(lambda s, sf: drafts(s, sf).select("transaction_id", "duplicate_group"))
query("ded_conflicts", "SELECT transaction_id, CASE WHEN all_same > same THEN 'same_serial_conflicting_fields' END AS conflict_status FROM marked", f"{TX}, {TWO}")(lambda s, sf: drafts(s, sf).select("transaction_id", "conflict_status"))
query("ded_canonical", "SELECT transaction_id FROM marked WHERE same = 1 OR seq < 1000000000", f"{TX}, {TWO}")(lambda s, sf: dedup.canonical(drafts(s, sf)).select("transaction_id"))
query("agg_dup_histogram", "SELECT count(*) AS n_rows, count(DISTINCT CASE WHEN same > 1 THEN serial_number END) AS n_groups, count(*) FILTER (WHERE same = 1 OR seq < 1000000000) AS n_canonical, count(*) FILTER (WHERE all_same > same) AS n_conflict_rows FROM marked", f"{TX}, {TWO}")(lambda s, sf: dedup.histogram(drafts(s, sf)))

query("score_risk", "SELECT account, risk, risk_level FROM levels", f"{TX}, {SIDES}")(lambda s, sf: scoring.scored(live(s, sf), VICTIMS).select("account", "risk", "risk_level"))
query("score_priority", "SELECT account, priority_score, priority_level FROM levels", f"{TX}, {SIDES}")(lambda s, sf: scoring.scored(live(s, sf), VICTIMS).select("account", "priority_score", "priority_level"))
query("score_summary", f"SELECT risk AS score, risk_level AS level, account AS account_id, label AS account_label, '{scoring.METHOD}' AS method, '{scoring.DISCLAIMER}' AS disclaimer FROM levels ORDER BY risk DESC, first_ord LIMIT 1", f"{TX}, {SIDES}")(lambda s, sf: scoring.summary(scoring.scored(live(s, sf), VICTIMS)))
query("topk_risk", "SELECT account, risk FROM levels ORDER BY risk DESC, first_ord LIMIT 10", f"{TX}, {SIDES}")(lambda s, sf: scoring.ranked(scoring.scored(live(s, sf), VICTIMS), 10).select("account", "risk"))
_PCT = "CAST(CAST(round_even({0} * 100, 0) AS BIGINT) AS VARCHAR) || '%'"
_FACTORS = [
    ("rapid_transfer", "r1", "'入账后30分钟内转出 ' || rapid || ' 组'"), ("pass_through", "r2", "'流出/流入穿透率 ' || " + _PCT.format("ratio")), ("multiple_counterparties", "r3", "'关联对手账户 ' || counterparties || ' 个'"),
    ("split_transfer", "r4", "'60分钟内向至少3个下游转出'"), ("return_flow", "r5", "'发现回流流水 ' || returns || ' 笔'"), ("risky_signal", "r6", "'摘要或渠道命中风险词 ' || risky || ' 笔'"),
    ("direct_victim_receiver", "p1", "'已确认直接收款 ' || format('{:,}', CAST(round_even(direct, 0) AS BIGINT)) || ' 元'"), ("victim_fund_scale", "p2", "'相对本案最大直接收款占比 ' || " + _PCT.format("share")), ("aggregation", "p3", "'上游账户 ' || upstream || ' 个'"),
    ("rapid_transfer", "p4", "'30分钟内转出 ' || rapid || ' 组'"), ("split_transfer", "p5", "'60分钟内向至少3个下游转出'"), ("topology_centrality", "p6", "'关联上下游账户 ' || counterparties || ' 个'"), ("return_flow", "p7", "'发现回流流水 ' || returns || ' 笔'"), ("exit_channel", "p8", "'流向取现、商户或支付出口 ' || exits || ' 笔'"),
]


@query("score_factors", " UNION ALL ".join(f"SELECT account, '{'risk' if p[0] == 'r' else 'priority'}' AS kind, '{code}' AS code, CAST({p} AS INT) AS score, {e} AS evidence FROM levels WHERE {p} > 0" for code, p, e in _FACTORS), f"{TX}, {SIDES}")
def score_factors(spark, sf):
    n = scoring.scored(live(spark, sf), VICTIMS)
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(f"{k}_factors").alias("f")) for k in ("risk", "priority")))
    return n.select("account", F.explode(kinds).alias("k")).select("account", "k.kind", F.explode("k.f").alias("x")).select("account", "kind", "x.code", "x.score", "x.evidence")


for _m in attribution.METHODS:
    query(f"attr_{_m}", f"SELECT transaction_id, attributed_amount FROM shares WHERE method = '{_m}' AND payer_account = '{SOURCE}'", f"{TX}, {SHARES}")(
        lambda s, sf, m=_m: attribution.attribute(adapter.transactions(s, sf), V, P, SOURCE).where(F.col("method") == m).select("transaction_id", _dbl("attributed_amount"))
    )
query("attr_bulk", "SELECT payer_account, method, transaction_id, attributed_amount FROM shares", f"{TX}, {SHARES}")(lambda s, sf: attribution.attribute(adapter.transactions(s, sf), V, P).select("payer_account", "method", "transaction_id", _dbl("attributed_amount")))
query("attr_summary", f"SELECT payer_account, method, count(*) AS n_edges, CAST(least({V}, sum(d)) AS DOUBLE) AS total_attributed, CAST(greatest(0, {V} - least({V}, sum(d))) AS DOUBLE) AS remaining_amount, true AS is_inference, '{attribution.DISCLAIMER}' AS disclaimer FROM shares GROUP BY ALL", f"{TX}, {SHARES}")(lambda s, sf: attribution.summarise(attribution.attribute(adapter.transactions(s, sf), V, P), V))

_E = ", e AS (SELECT DISTINCT payer_account AS src, payee_account AS dst FROM tx)"
_walk = lambda a, b: f", w AS (SELECT '{START}' AS node, 0 AS depth UNION SELECT e.{b}, depth + 1 FROM w JOIN e ON e.{a} = w.node WHERE depth < {HOPS})"
query("trace_down", "SELECT node, CAST(min(depth) AS INT) AS depth FROM w GROUP BY node", TX + _E + _walk("src", "dst"))(lambda s, sf: trace.reach(trace.account_edges(adapter.transactions(s, sf)), START, HOPS))
query("trace_up", "SELECT node, CAST(min(depth) AS INT) AS depth FROM w GROUP BY node", TX + _E + _walk("dst", "src"))(lambda s, sf: trace.reach(trace.account_edges(adapter.transactions(s, sf), True), START, HOPS))
query("trace_cycles", f"SELECT array_to_string(list_append(p, '{START}'), '>') AS path FROM c JOIN e ON e.src = c.p[-1] WHERE e.dst = '{START}' AND len(p) > 1 ORDER BY list_append(p, '{START}') LIMIT 50", TX + _E + f", c AS (SELECT ['{START}'] AS p UNION ALL SELECT list_append(p, e.dst) FROM c JOIN e ON e.src = p[-1] WHERE len(p) < {HOPS + 2} AND NOT list_contains(p, e.dst))")(
    lambda s, sf: trace.cycles(trace.account_edges(adapter.transactions(s, sf)), START, HOPS).select(F.array_join("path", ">").alias("path"))
)
query("trace_path", f"SELECT array_to_string(p, '>') AS path FROM (SELECT p FROM c WHERE p[-1] = '{END}' ORDER BY len(p), p LIMIT 1)", TX + _E + f", c AS (SELECT ['{START}'] AS p UNION ALL SELECT list_append(p, e.dst) FROM c JOIN e ON e.src = p[-1] WHERE len(p) < 8 AND p[-1] <> '{END}' AND NOT list_contains(p, e.dst))")(
    lambda s, sf: trace.shortest_path(trace.account_edges(adapter.transactions(s, sf)), START, END).select(F.array_join("path", ">").alias("path"))
)
query("trace_bundle")(lambda s, sf: trace.bundle(adapter.transactions(s, sf), START, END, HOPS))
_BUNDLE = f"""{TX}{_E},
up AS (SELECT '{START}' AS node, 0 AS depth UNION SELECT e.src, depth + 1 FROM up JOIN e ON e.dst = up.node WHERE depth < {HOPS}),
down AS (SELECT '{START}' AS node, 0 AS depth UNION SELECT e.dst, depth + 1 FROM down JOIN e ON e.src = down.node WHERE depth < {HOPS}),
way AS (SELECT ['{START}'] AS p UNION ALL SELECT list_append(p, e.dst) FROM way JOIN e ON e.src = p[-1] WHERE len(p) < 8 AND p[-1] <> '{END}' AND NOT list_contains(p, e.dst)),
ring AS (SELECT ['{START}'] AS p UNION ALL SELECT list_append(p, e.dst) FROM ring JOIN e ON e.src = p[-1] WHERE len(p) < {HOPS + 2} AND NOT list_contains(p, e.dst))"""
query("trace_bundle_rows", f"""SELECT 'upstream' AS kind, node AS item, CAST(min(depth) AS INT) AS depth FROM up GROUP BY node UNION ALL SELECT 'downstream', node, CAST(min(depth) AS INT) FROM down GROUP BY node
UNION ALL SELECT 'shortest_path', array_to_string(p, '>'), NULL FROM (SELECT p FROM way WHERE p[-1] = '{END}' ORDER BY len(p), p LIMIT 1)
UNION ALL SELECT 'cycle', path, NULL FROM (SELECT array_to_string(list_append(p, '{START}'), '>') AS path FROM ring JOIN e ON e.src = ring.p[-1] WHERE e.dst = '{START}' AND len(p) > 1 ORDER BY list_append(p, '{START}') LIMIT 50)""", _BUNDLE)(
    lambda s, sf: trace.bundle_rows(adapter.transactions(s, sf), START, END, HOPS).withColumn("item", F.array_join("item", ">"))
)

for _o, _sql in (("time_asc", "transaction_time, seq"), ("time_desc", "transaction_time DESC, seq"), ("amount_desc", "amount DESC, seq")):
    query(f"sort_{_o}", f"SELECT transaction_id, CAST(row_number() OVER (ORDER BY {_sql}) AS BIGINT) AS place FROM tx")(
        lambda s, sf, o=_o: filters.placed(adapter.transactions(s, sf).select("transaction_id", "transaction_time", "amount", "seq"), o).select("transaction_id", "place")
    )
query("page", "SELECT transaction_id FROM tx ORDER BY amount DESC, seq LIMIT 50 OFFSET 100")(lambda s, sf: filters.sorted_page(adapter.transactions(s, sf), "amount_desc", 3, 50).select("transaction_id"))
query("set_union", "SELECT payer_account AS account FROM tx UNION SELECT payee_account FROM tx")(lambda s, sf: (t := adapter.transactions(s, sf)).select(F.col("payer_account").alias("account")).union(t.select("payee_account")).distinct())
query("set_except", "SELECT serial_number FROM two WHERE source_file_id = 'A' EXCEPT SELECT serial_number FROM two WHERE source_file_id = 'B'", f"{TX}, {TWO}")(lambda s, sf: (t := adapter.two_sources(s, sf)).where("source_file_id = 'A'").select("serial_number").subtract(t.where("source_file_id = 'B'").select("serial_number")))


@query("jon_oracle_report", "SELECT 'A' AS source_file_id, (SELECT count(*) FROM b) AS expected, count(*) FILTER (WHERE b.amount = a.amount) AS correct, (SELECT count(*) FROM b) - count(b.seq) AS missing, count(*) FILTER (WHERE b.amount <> a.amount) AS mismatched, count(*) - count(b.seq) AS extra, count(*) FILTER (WHERE b.amount = a.amount) / (SELECT count(*) FROM b) AS accuracy FROM a LEFT JOIN b USING (serial_number)", f"{TX}, {TWO}")
def jon_oracle_report(spark, sf):
    two = adapter.two_sources(spark, sf)
    return reconcile.format_metrics(reconcile.compare(two.where("source_file_id = 'B'").withColumn("source_file_id", F.lit("A")), two.where("source_file_id = 'A'")))


@query("jon_reconcile", """SELECT transaction_id, CAST(amount AS DOUBLE) AS amount, 'other' AS origin FROM a UNION ALL
SELECT b.transaction_id, CAST(b.amount + 1 AS DOUBLE), 'updated' FROM b WHERE seq % 20 = 0 UNION ALL SELECT transaction_id, CAST(amount AS DOUBLE), 'leftover' FROM b WHERE seq % 20 <> 0""", f"{TX}, {TWO}")
def jon_reconcile(spark, sf):
    two = adapter.two_sources(spark, sf)
    new = two.where("source_file_id = 'B' AND seq % 20 = 0").withColumns({"transaction_id": F.concat(F.lit("N"), "transaction_id"), "amount": (F.col("amount") + 1).cast(S.MONEY)})
    return reconcile.reconcile(two, new, "B", False).select("transaction_id", _dbl(), "origin")


@query("jon_reconcile_rows", """SELECT transaction_id, CAST(amount AS DOUBLE) AS amount, 'other' AS origin FROM b UNION ALL
SELECT transaction_id, CAST(CASE WHEN seq % 2 = 0 AND seq % 3 = 2 AND NOT kept THEN amount + 1 ELSE amount END AS DOUBLE), CASE WHEN seq % 2 = 1 THEN 'leftover' WHEN kept THEN 'kept' ELSE 'updated' END FROM (SELECT *, review_status IN ('confirmed', 'conflict') AS kept FROM a)""", f"{TX}, {TWO}")
def jon_reconcile_rows(spark, sf):
    """All rows of a source have one serial or none; only sheet and row tell them apart, and a null sheet is no blank one. Every second row is read again."""
    two = adapter.two_sources(spark, sf)
    e = F.col("seq")
    two = two.withColumns({"serial_number": F.when(e % 3 > 0, F.when(e % 3 > 1, "S").otherwise("")), "sheet_name": F.when(e % 4 > 1, F.when(e % 8 > 3, "").otherwise("1")), "row_number": F.when(e % 4 < 2, F.floor(e / 8)).otherwise(F.floor(e / 8) + 1).cast("int"), "archive_member_path": F.when(e % 4 == 0, "1").when(e % 8 == 2, F.lit("")), "page_number": (e % 8).cast("int")})
    new = two.where("source_file_id = 'A' AND seq % 2 = 0").withColumns({"transaction_id": F.concat(F.lit("N"), "transaction_id"), "amount": F.when(F.col("serial_number") == "S", F.col("amount") + 1).otherwise(F.col("amount")).cast(S.MONEY)})
    return reconcile.reconcile(two, new, "A", False).select("transaction_id", _dbl(), "origin")


@query("mut_case", """SELECT transaction_id, CAST(amount AS DOUBLE) AS amount, CASE WHEN review_status = 'pending' OR transaction_id = 'T42' THEN 'confirmed' ELSE review_status END AS review_status,
coalesce(review_status = 'pending', false) AS noted, EXISTS (SELECT 1 FROM kept k WHERE k.serial_number = kept.serial_number AND k.amount = kept.amount AND k.transaction_id <> kept.transaction_id) AS duplicate,
EXISTS (SELECT 1 FROM kept k WHERE k.serial_number = kept.serial_number AND k.amount <> kept.amount) AS conflict FROM kept""", f"{TX}, {TWO}, kept AS (SELECT * REPLACE (CASE WHEN transaction_id = 'T42' THEN 'rejected' ELSE review_status END AS review_status) FROM a UNION ALL SELECT * FROM b WHERE seq % 20 = 0)")
def mut_case(spark, sf):
    """A case's folder over time: two sources are added, one is read again with half its rows, a draft is edited, all pending ones are confirmed."""
    folder = f"{scratch_dir(spark)}/case-{uuid.uuid4().hex}"
    two = adapter.two_sources(spark, sf)
    source = F.struct("source_file_id", *(F.lit(None).cast(t).alias(n) for n, t in (("archive_member_path", "string"), ("page_number", "int"), ("sheet_name", "string"), ("table_number", "int"), ("paragraph_number", "int"))), (F.col("seq") % 10**9).cast("int").alias("row_number"), F.lit(None).cast("array<double>").alias("region"))
    two = two.withColumn("source", source).drop("source_file_id")
    repository.add_drafts(two.where("source.source_file_id = 'A'"), folder)
    repository.replace_source(two.where("source.source_file_id = 'B'"), folder, "B")
    repository.replace_source(two.where("source.source_file_id = 'B' AND seq % 20 = 0").withColumn("transaction_id", F.concat(F.lit("N"), "transaction_id")), folder, "B")
    repository.update_draft(spark, folder, "T42", {"review_status": "confirmed"})
    repository.confirm_all(spark, folder)
    got = repository.list_drafts(spark, folder)
    return got.select("transaction_id", _dbl(), "review_status", (F.col("review_note") == repository.BULK_NOTE).alias("noted"), F.col("duplicate_group").isNotNull().alias("duplicate"), F.col("conflict_status").isNotNull().alias("conflict")).fillna(False, "noted")


@query("src_csv", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents", "")
def src_csv(spark, sf):
    """documents as CSV files with line ends inside quoted cells, read back by byte ranges."""
    path = f"{scratch_dir(spark)}/csv-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "source", "text")
    docs.write.option("header", True).option("quoteAll", True).option("escape", '"').option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return csv_rows.read_csv(spark, path).select(*(F.col("row_data")[c].alias(c) for c in docs.columns))


@query("src_pdf", """SELECT doc_id, CAST(k + 1 AS INT) AS page_number, CASE WHEN p = '' THEN '' ELSE p || chr(10) END AS text FROM (SELECT doc_id, k, array_to_string(lines[40 * k + 1:40 * k + 40], chr(10)) AS p
FROM (SELECT doc_id, lines, unnest(range((len(lines) + 39) // 40)) AS k FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)))""", "")
def src_pdf(spark, sf):
    """documents as PDF files, 40 lines a page, and the text of their pages."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.concat(F.col("doc_id").cast("string"), F.lit(".pdf")).alias("name"), "text")
    pages = files.chunks(materialise(files.as_pdf(docs), "pdf-files"))
    return pages.select(F.regexp_extract("path", r"(\d+)\.pdf$", 1).cast("long").alias("doc_id"), "page_number", "text")


#: Headers of a bank statement, by the record's field.
STATEMENT = {"serial_number": "交易流水号", "transaction_time": "交易时间", "payer_account": "付款账号", "payer_name": "付款户名", "payee_account": "收款账号", "payee_name": "收款户名", "amount": "交易金额", "channel": "交易渠道", "summary": "摘要"}


def _statement(spark, sf):
    """(seq, cells): transactions as rows of a statement; every 97th lacks its payer."""
    tx = adapter.transactions(spark, sf)
    cells = {f: F.col(f) for f in STATEMENT} | {"transaction_time": F.date_format("transaction_time", "yyyy-MM-dd HH:mm:ss"), "payer_account": F.when(F.col("seq") % 97 == 0, "").otherwise(F.col("payer_account"))}
    return tx.select("seq", *(v.cast("string").alias(STATEMENT[f]) for f, v in cells.items()))


_CELLS = "serial_number, CAST(date_trunc('second', transaction_time) AS TIMESTAMP) AS transaction_time, payer_account, payee_account, CAST(amount AS DOUBLE) AS amount, channel, summary"


@query("snk_xlsx", f"SELECT CAST(seq // 1000 AS VARCHAR) || '.xlsx' AS path, CAST(row_number() OVER (PARTITION BY seq // 1000 ORDER BY seq) + 1 AS INT) AS row_number, serial_number, CASE WHEN seq % 97 = 0 THEN '' ELSE payer_account END AS payer_account, payee_account, CAST(amount AS DOUBLE) AS amount, summary FROM tx")
def snk_xlsx(spark, sf):
    """Transactions as XLSX workbooks, written in tasks and read back, every cell as text."""
    rows = files.chunks(materialise(files.as_tables(_statement(spark, sf), ".xlsx"), "xlsx-files"))
    cell = lambda f: F.col("row_data")[STATEMENT[f]]
    return rows.select("path", "row_number", cell("serial_number").alias("serial_number"), cell("payer_account").alias("payer_account"), cell("payee_account").alias("payee_account"), cell("amount").cast("double").alias("amount"), cell("summary").alias("summary"))


@query("snk_docx", "SELECT CAST(f AS VARCHAR) || '.docx' AS path, CAST(8 * ((k - 1) // 8) + 2 AS INT) AS first_row, CAST(count(*) AS INT) AS n_rows, string_agg(serial_number, ',' ORDER BY k) AS serials FROM (SELECT serial_number, seq // 1000 AS f, row_number() OVER (PARTITION BY seq // 1000 ORDER BY seq) AS k FROM tx) GROUP BY f, (k - 1) // 8")
def snk_docx(spark, sf):
    """Transactions as tables of DOCX files, read back in chunks of eight rows with each row's number."""
    chunks = files.chunks(materialise(files.as_tables(_statement(spark, sf), ".docx"), "docx-files"))
    serials = F.transform("row_evidence", lambda e: F.split(e["text"], "\t")[0])
    return chunks.select("path", F.col("row_evidence")[0]["row_number"].alias("first_row"), F.size("row_evidence").alias("n_rows"), F.array_join(serials, ",").alias("serials"))


@query("ing_materials", f"SELECT {_CELLS}, 'pending' AS review_status, 'structured' AS parser_name, true AS located FROM tx WHERE seq % 97 <> 0")
def ing_materials(spark, sf):
    """Transactions as CSV statements in a folder that a stream takes into a case, in two runs; the drafts of the case."""
    base = f"{scratch_dir(spark)}/ingest-{uuid.uuid4().hex}"
    rows = _statement(spark, sf)
    for k in (0, 1):
        some = rows.where(F.col("seq") % 2 == k).drop("seq")
        some.write.option("header", True).option("maxRecordsPerFile", 200_000).option("emptyValue", "").csv(f"{base}/in/{k}")
        stream.watch_materials(spark, f"{base}/in", f"{base}/case", f"{base}/checkpoint").awaitTermination()
    got = repository.list_drafts(spark, f"{base}/case")
    located = F.col("source.row_number").isNotNull() & (F.size("evidence_locations") == 1)
    return got.select("serial_number", F.col("transaction_time").cast("timestamp").alias("transaction_time"), "payer_account", "payee_account", _dbl(), "channel", "summary", "review_status", "parser_name", located.alias("located"))


query("agg_reported_losses", "SELECT region AS case_id, CAST(sum(amount) AS DOUBLE) AS reported_loss FROM tx GROUP BY region")(
    lambda s, sf: repository.reported_losses(adapter.transactions(s, sf).select(F.col("region").alias("case_id"), F.col("amount").alias("reported_loss"))).select("case_id", _dbl("reported_loss"))
)
query("agg_seed_total", "SELECT CAST(coalesce(sum(amount), 0) AS DOUBLE) AS amount FROM a WHERE review_status = 'confirmed' AND payer_account IN ('U0', 'U5', 'U10')", f"{TX}, {TWO}")(
    lambda s, sf: repository.seed_total(adapter.two_sources(s, sf).where(F.col("payer_account").isin(*VICTIMS) & (F.col("source_file_id") == "A") & filters.status("confirmed"))).select(_dbl())
)
query("set_first_seen", "SELECT user_id, CAST(row_number() OVER (ORDER BY min(event_id)) AS BIGINT) AS place FROM events GROUP BY user_id", "")(
    lambda s, sf: running.places(s.read.parquet(f"{sf}/events.parquet").groupBy("user_id").agg(F.min("event_id").alias("first")), [F.asc("first")], "first-seen").select("user_id", "place")
)


@query("jon_replace", """SELECT transaction_id, CAST(amount AS DOUBLE) AS amount, review_status, 'other' AS origin FROM b UNION ALL
SELECT transaction_id, CAST(CASE WHEN kept THEN amount ELSE amount + 1 END AS DOUBLE), review_status, CASE WHEN kept THEN 'kept' ELSE 'updated' END FROM (SELECT *, review_status IN ('confirmed', 'conflict') OR seq % 13 = 0 AS kept FROM a WHERE seq % 20 = 0)
UNION ALL SELECT 'X' || transaction_id, CAST(amount AS DOUBLE), 'pending', 'new' FROM a WHERE seq % 20 = 5""", f"{TX}, {TWO}")
def jon_replace(spark, sf):
    two = adapter.two_sources(spark, sf).withColumn("provenance", F.when(F.col("seq") % 13 == 0, "human_confirmed").otherwise("original"))
    met = F.col("seq") % 20 == 0
    new = two.where("source_file_id = 'A' AND seq % 20 IN (0, 5)").withColumns({
        "transaction_id": F.concat(F.when(met, "N").otherwise("X"), "transaction_id"), "serial_number": F.concat(F.when(met, "").otherwise("X"), "serial_number"),
        "amount": F.when(met, F.col("amount") + 1).otherwise(F.col("amount")).cast(S.MONEY), "review_status": F.lit("pending"), "provenance": F.lit("original"),
    })
    return reconcile.reconcile(two, new, "A", True).select("transaction_id", _dbl(), "review_status", "origin")


@query("jon_seed_gate", """SELECT transaction_id, CASE WHEN seq % 9 = 0 THEN '所选受害人不存在' WHEN review_status <> 'confirmed' THEN '起点必须来自已确认流水' WHEN payer_account NOT IN ('U0', 'U5', 'U10') THEN '起点流水的付款账号必须属于所选受害人' END AS reason FROM a""", f"{TX}, {TWO}")
def jon_seed_gate(spark, sf):
    a = adapter.two_sources(spark, sf).where("source_file_id = 'A'")
    victims = spark.createDataFrame([("V-1", ["U-0", " U5", "U10"])], "victim_id string, accounts array<string>")
    seeds = a.select("transaction_id", F.when(F.col("seq") % 9 == 0, "V-9").otherwise("V-1").alias("victim_id"))
    return reconcile.seed_reasons(seeds, victims, a).select("transaction_id", "reason")


query("mut_confirm_all", "SELECT transaction_id, CASE review_status WHEN 'pending' THEN 'confirmed' ELSE review_status END AS review_status FROM two", f"{TX}, {TWO}")(lambda s, sf: reconcile.confirm_all(adapter.two_sources(s, sf)).select("transaction_id", "review_status"))
query("mut_update", "SELECT transaction_id, CASE transaction_id WHEN 'T42' THEN 'rejected' ELSE review_status END AS review_status FROM two", f"{TX}, {TWO}")(lambda s, sf: reconcile.update(adapter.two_sources(s, sf), "T42", {"review_status": "rejected", "summary": None}).select("transaction_id", "review_status"))
query("mut_material_dedupe", "SELECT doc_id, doc_id > min(doc_id) OVER (PARTITION BY text) AS duplicate FROM documents", "")(lambda s, sf: reconcile.first_by_content(s.read.parquet(f"{sf}/documents.parquet").withColumn("seq", F.col("doc_id")), "text").select("doc_id", "duplicate"))
query("mut_material_status", "SELECT event_id, CASE WHEN event_id % 3 > 0 AND event_id % 2 > 0 THEN 'partial' WHEN event_id % 3 > 0 THEN 'failed' WHEN event_id % 2 > 0 OR event_id % 5 = 0 THEN 'parsed' ELSE 'extracted' END AS status FROM events", "")(lambda s, sf: s.read.parquet(f"{sf}/events.parquet").select("event_id", reconcile.material_status(F.col("event_id") % 3, F.col("event_id") % 2, F.col("event_id") % 5 == 0).alias("status")))
query("src_benchmark", "SELECT 500 AS nodes, 500 AS edges, 59950000.0::DOUBLE AS total", "")(lambda s, sf: (e := graph.edges(generators.benchmark(s))).agg(F.count_distinct("source").cast("int").alias("nodes"), F.count("*").cast("int").alias("edges"), F.sum("amount").cast("double").alias("total")))
query("grf_benchmark", "SELECT 500 AS nodes, 500 AS edges, 59950000.0::DOUBLE AS incoming", "")(
    lambda s, sf: (g := scoring.build_graph(generators.benchmark(s).withColumn("duplicate_group", F.lit(None).cast("string"))))["nodes"].agg(F.count("*").cast("int").alias("nodes"), F.sum("incoming").cast("double").alias("incoming")).withColumn("edges", g["edges"].agg(F.count("*").cast("int")).scalar())
)
query("src_demo")(lambda s, sf: graph.edges(generators.layered(s)).select("source", "target", _dbl(), "count"))


def _layout(spark, sf):
    e = materialise(graph.edge_totals(live(spark, sf)), "layout-edges")
    return layout.layered(e)


_LAYOUT = f"""{TX},
le AS MATERIALIZED (SELECT payer_account || '>' || payee_account AS id, payer_account AS source, payee_account AS target, sum(amount) AS amount, min(transaction_time) AS first FROM live GROUP BY ALL),
ids AS MATERIALIZED (SELECT source AS node FROM le UNION SELECT target FROM le),
down AS (SELECT node, 0 AS depth FROM ids WHERE node NOT IN (SELECT target FROM le) UNION SELECT target, depth + 1 FROM down JOIN le ON source = node WHERE depth < (SELECT count(*) FROM ids)),
d0 AS MATERIALIZED (SELECT node, min(depth) AS depth FROM down GROUP BY node),
rest AS MATERIALIZED (SELECT node FROM ids WHERE node NOT IN (SELECT node FROM d0)),
reached AS (SELECT node AS a, node AS b FROM rest UNION SELECT a, target FROM reached JOIN le ON source = b WHERE target IN (SELECT node FROM rest)),
rooted AS MATERIALIZED (SELECT b AS node, min(a) AS root FROM reached GROUP BY b),
walked AS (SELECT DISTINCT root, root AS node, 0 AS depth FROM rooted UNION SELECT walked.root, target, depth + 1 FROM walked JOIN le ON source = walked.node JOIN rooted ON rooted.node = target AND rooted.root = walked.root WHERE depth < (SELECT count(*) FROM ids)),
dep AS MATERIALIZED (SELECT node, depth FROM d0 UNION ALL SELECT node, min(depth) FROM walked GROUP BY node),
prim AS MATERIALIZED (SELECT target AS node, arg_min(id, row(first, -amount, id)) AS primary_edge, arg_min(source, row(first, -amount, id)) AS parent FROM le JOIN dep s ON s.node = source JOIN dep t ON t.node = target WHERE s.depth = t.depth - 1 GROUP BY target),
path AS (SELECT node, [node] AS p FROM dep WHERE depth = 0 UNION ALL SELECT prim.node, list_append(path.p, prim.node) FROM path JOIN prim ON prim.parent = path.node)"""
query("lay_positions", "SELECT node, CAST(depth AS INT) AS depth, CAST(80 + 260 * depth AS INT) AS x, CAST(60 + 20 * (max(n) OVER () - n) + 40 * (place - 1) AS DOUBLE) AS y FROM (SELECT node, depth, count(*) OVER (PARTITION BY depth) AS n, row_number() OVER (PARTITION BY depth ORDER BY p) AS place FROM path JOIN dep USING (node))", _LAYOUT)(lambda s, sf: _layout(s, sf).select("node", "depth", "x", "y"))
query("lay_primary_edges", "SELECT node, primary_edge FROM prim", _LAYOUT)(lambda s, sf: _layout(s, sf).where("primary_edge is not null").select("node", "primary_edge"))
query("lay_focus", "SELECT node, CASE WHEN node = 'U0' THEN 'selected' WHEN max(last_in) > max(last_out) THEN 'incoming-neighbor' WHEN max(last_out) >= 0 THEN 'outgoing-neighbor' ELSE 'inactive' END AS state FROM (SELECT payer_account AS node, CASE WHEN payee_account = 'U0' THEN min(seq) ELSE -1 END AS last_in, -1 AS last_out FROM live GROUP BY payer_account, payee_account UNION ALL SELECT payee_account, -1, CASE WHEN payer_account = 'U0' THEN min(seq) ELSE -1 END FROM live GROUP BY payer_account, payee_account) GROUP BY node")(lambda s, sf: layout.focus(graph.edge_totals(live(s, sf)), "U0"))


_GRAPH = f"{TX[: TX.index(',' + chr(10) + 'live AS')]}, {TWO}, live AS (SELECT * FROM marked WHERE (same = 1 OR seq < 1000000000) AND review_status = 'confirmed' AND event_status = 'success' AND amount >= 50 AND channel = '柜台'), {SIDES}"


@query("grf_build", "SELECT account, label, incoming, outgoing, risk, risk_level, priority_score, priority_level FROM levels", _GRAPH)
def grf_build(spark, sf):
    made = scoring.build_graph(drafts(spark, sf), VICTIMS, least=50, channel_name="柜台")["nodes"]
    return made.select("account", "label", _dbl("incoming"), _dbl("outgoing"), "risk", "risk_level", "priority_score", "priority_level")


query("grf_build_totals", "SELECT count(*) AS transaction_count, CAST(coalesce(sum(amount), 0) AS DOUBLE) AS total_amount FROM live", _GRAPH)(lambda s, sf: scoring.build_graph(drafts(s, sf), VICTIMS, least=50, channel_name="柜台")["totals"])


_STATES = "SELECT 'node' AS kind, node AS id, {} AS state FROM (SELECT payer_account AS node FROM live UNION SELECT payee_account FROM live) UNION ALL SELECT DISTINCT 'edge', payer_account || '>' || payee_account, {} FROM live"
_EDGE = "payer_account = 'U0' AND payee_account = 'U1'"
query("lay_playback", _STATES.format("CASE node WHEN 'U0' THEN 'playing-source' WHEN 'U1' THEN 'playing-target' ELSE 'inactive' END", f"CASE WHEN {_EDGE} THEN 'playing' ELSE 'inactive' END"))(lambda s, sf: layout.focus_states(graph.edge_totals(live(s, sf)), edge="U2>U3", playing="U0>U1"))
query("lay_focus_edge", _STATES.format("CASE WHEN node IN ('U0', 'U1') THEN 'edge-endpoint' ELSE 'inactive' END", f"CASE WHEN {_EDGE} THEN 'selected' ELSE 'inactive' END"))(lambda s, sf: layout.focus_states(graph.edge_totals(live(s, sf)), node="U2", edge="U0>U1"))
query("lay_focus_edges", "SELECT DISTINCT payer_account || '>' || payee_account AS id, CASE 'U0' WHEN payee_account THEN 'incoming' WHEN payer_account THEN 'outgoing' ELSE 'inactive' END AS state FROM live")(
    lambda s, sf: layout.focus_states(graph.edge_totals(live(s, sf)), "U0").where("kind = 'edge'").select("id", "state")
)
query("sort_playback", "SELECT payer_account || '>' || payee_account AS id, row_number() OVER (ORDER BY min(transaction_time), min(seq)) AS place FROM live GROUP BY payer_account, payee_account")(
    lambda s, sf: running.places(graph.edge_totals(live(s, sf)), [F.asc("first_transaction_time"), F.asc("first_seq")]).select("id", "place")
)
query("agg_edge_transactions", "SELECT payer_account || '>' || payee_account AS id, seq, transaction_id FROM live")(lambda s, sf: graph.edge_transactions(live(s, sf)))
query("agg_appearances", "SELECT serial_number, count(*) AS n FROM two GROUP BY 1 HAVING count(*) > 1", f"{TX}, {TWO}")(lambda s, sf: repository.appearances(adapter.two_sources(s, sf)))
query("agg_material_counts", "SELECT 0::BIGINT AS active, count(*) FILTER (WHERE event_id % 3 > 0 AND event_id % 2 = 0) AS failed, count(*) FILTER (WHERE event_id % 3 > 0 AND event_id % 2 > 0) AS partial FROM events", "")(
    lambda s, sf: repository.material_counts(s.read.parquet(f"{sf}/events.parquet").select(reconcile.material_status(F.col("event_id") % 3, F.col("event_id") % 2, F.col("event_id") % 5 == 0).alias("status")))
)
query("set_first_seen", "SELECT region, row_number() OVER (ORDER BY min(seq)) AS place FROM tx GROUP BY region")(
    lambda s, sf: running.places(adapter.transactions(s, sf).groupBy("region").agg(F.min("seq").alias("first")), [F.asc("first")]).select("region", "place")
)
query("jon_material_label", "SELECT transaction_id, CASE source_file_id WHEN 'A' THEN 'a.csv' END AS file_name FROM two", f"{TX}, {TWO}")(
    lambda s, sf: repository.labelled(adapter.two_sources(s, sf), s.createDataFrame([("A", "a.csv"), ("C", "c.csv")], "material_id string, file_name string")).select("transaction_id", "file_name")
)


@query("jon_evidence", "SELECT transaction_id, CASE WHEN seq % 4 < 2 THEN -1 ELSE CAST(seq % 100 AS INT) END AS row_number FROM tx")
def jon_evidence(spark, sf):
    """A fourth of the records have no chunk, another fourth two rows with their serial: -1."""
    t = adapter.transactions(spark, sf).withColumn("chunk_id", F.concat(F.lit("C"), F.col("seq").cast("string")))
    row = lambda text, n: F.struct(text.alias("text"), n.cast("int").alias("row_number"))
    own = row(F.concat(F.lit("| "), F.col("serial_number"), F.lit(" | 1.00")), F.col("seq") % 100)
    other = row(F.when(F.col("seq") % 4 == 1, F.col("serial_number")).otherwise("none"), F.lit(7))
    return reconcile.evidence_rows(t, t.where("seq % 4 > 0").select("chunk_id", F.array(own, other).alias("row_evidence"))).fillna(-1, "row_number")


@query("prj_endpoints", """SELECT transaction_id, CASE seq % 4 WHEN 1 THEN 'MERCHANT:M7' WHEN 2 THEN 'ATM:T9' END AS payee_endpoint_id, CASE seq % 4 WHEN 1 THEN 'merchant' WHEN 2 THEN 'atm' ELSE 'bank_account' END AS payee_entity_type,
CASE seq % 4 WHEN 3 THEN 'ATM:T9' END AS payer_endpoint_id, CASE seq % 4 WHEN 3 THEN 'atm' ELSE 'bank_account' END AS payer_entity_type FROM tx""")
def prj_endpoints(spark, sf):
    kind = F.element_at(F.array(*map(F.lit, ("bank_transfer", "card_payment", "cash_withdrawal", "cash_deposit"))), (F.col("seq") % 4 + 1).cast("int"))
    t = adapter.transactions(spark, sf).withColumns({"record_type": kind, "merchant_id": F.lit("M7"), "terminal_id": F.when(kind != "card_payment", "T9"), "payee_account": F.when(kind == "card_payment", "").otherwise(F.col("payee_account"))})
    return filters.synthetic_endpoints(t).select("transaction_id", "payee_endpoint_id", "payee_entity_type", "payer_endpoint_id", "payer_entity_type")


query("prj_blank_defaults", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_type ELSE '' END AS summary, CASE WHEN event_id % 3 = 0 THEN 'USD' ELSE 'CNY' END AS currency FROM events", "")(
    lambda s, sf: filters.blank_defaults(s.read.parquet(f"{sf}/events.parquet").select("event_id", F.when(F.col("event_id") % 2 == 0, F.col("event_type")).alias("summary"), F.when(F.col("event_id") % 3 == 0, "USD").alias("currency")), ["summary", "currency"])
)
query("prj_source_label", "SELECT event_id, concat_ws(' · ', event_type, CASE WHEN event_id % 2 = 0 THEN 'p' || event_id END, CASE WHEN event_id % 3 = 0 THEN 's' END, CASE WHEN event_id % 5 = 0 THEN 'r' || event_id END) AS label FROM events", "")(
    lambda s, sf: s.read.parquet(f"{sf}/events.parquet").select("event_id", filters.source_label(F.col("event_type"), F.when(F.col("event_id") % 2 == 0, F.col("event_id")), F.when(F.col("event_id") % 3 == 0, "s").otherwise(""), F.when(F.col("event_id") % 5 == 0, F.col("event_id"))).alias("label"))
)
query("snk_version_rows", "SELECT transaction_id, serial_number, CAST(amount AS VARCHAR) AS amount, review_status FROM marked WHERE same = 1 OR seq < 1000000000", f"{TX}, {TWO}")(
    lambda s, sf: repository.version_rows(drafts(s, sf)).select("transaction_id", "serial_number", "amount", "review_status")
)
query("src_truth", "SELECT 32::BIGINT AS nodes, 112::BIGINT AS edges, 120::BIGINT AS transactions, 2928760.0::DOUBLE AS total", "")(lambda s, sf: _fixture(generators.truth(s)))
query("src_distribution", "SELECT 135::BIGINT AS n_rows, 15::BIGINT AS n_groups, 120::BIGINT AS n_canonical, 0::BIGINT AS n_conflict_rows", "")(lambda s, sf: dedup.histogram(dedup.mark(generators.appearances(s))))
query("agg_format_metrics", "SELECT * FROM (VALUES ('.csv', 30::BIGINT, 30::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 1.0::DOUBLE), ('.xlsx', 35, 34, 0, 1, 0, 34 / 35), ('.pdf', 25, 25, 0, 0, 0, 1), ('.docx', 25, 24, 1, 0, 0, 24 / 25), ('.png', 10, 10, 0, 0, 0, 1), ('.jpg', 10, 10, 0, 0, 0, 1)) v(suffix, expected, correct, missing, mismatched, extra, accuracy)", "")(
    lambda s, sf: fixture_metrics(s)
)


def _fixture(tx: DataFrame) -> DataFrame:
    e = graph.edge_totals(tx)
    accounts = e.select(F.col("source").alias("node")).union(e.select("target")).distinct()
    return e.agg(F.count("*").alias("edges"), F.sum("count").alias("transactions"), F.sum("amount").cast("double").alias("total")).withColumn("nodes", accounts.agg(F.count("*")).scalar())


def fixture_metrics(spark: SparkSession) -> DataFrame:
    """Metrics by file format of the fixture's files, read with two faults: a record of the second file has another summary, the last file lacks one."""
    expected = generators.appearances(spark)
    actual = expected.where("seq != 9000").withColumn("summary", F.when(F.col("seq") == 1000, "x").otherwise(F.col("summary")))
    suffixes = generators.distribution(spark).select("source_file_id", "suffix").distinct()
    return reconcile.format_metrics(reconcile.compare(expected, actual).join(F.broadcast(suffixes), "source_file_id"), "suffix")


def entry(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.scored(live(spark, sf), VICTIMS).select("account", "label", _dbl("incoming"), _dbl("outgoing"), "risk", "risk_level", "priority_score", "priority_level")
