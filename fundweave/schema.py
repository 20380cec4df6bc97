"""The canonical transaction record and the fixed values of the rules."""

from __future__ import annotations

LOCATION = "struct<source_file_id:string,archive_member_path:string,page_number:int,sheet_name:string,table_number:int,paragraph_number:int,row_number:int,region:array<double>>"
MONEY = "decimal(18,2)"
RECORD_DDL = f"""transaction_id string, record_type string, transaction_time timestamp_ntz, serial_number string,
payer_account string, payer_name string, payer_institution string, payer_bank string,
payee_account string, payee_name string, payee_institution string, payee_bank string,
payer_entity_type string, payee_entity_type string, payer_endpoint_id string, payee_endpoint_id string,
debit_credit string, currency string, amount {MONEY}, balance_after {MONEY}, channel string, summary string, region string, transaction_type string,
source {LOCATION}, evidence_locations array<{LOCATION}>, parser_name string, model_id string, prompt_version string,
confidence map<string,double>, review_status string, review_note string, duplicate_group string, conflict_status string, event_status string,
order_id string, batch_id string, merchant_id string, merchant_name string, terminal_id string, authorization_code string, fee {MONEY},
related_transaction_id string, relation_type string, provenance string"""

#: Words, codes and limits that results depend on.
RISK_WORDS = ("涉诈", "博彩", "虚假", "资金拆分", "任务佣金", "跑分", "洗钱")
EXIT_WORDS = ("取现", "ATM", "商户", "支付", "数字资产", "境外")
RETURN_WORD = "回流"
NON_CANONICAL_RELATIONS = ("same_business_event", "corroborates")
LIVE_EVENTS = ("success", "returned")
RAPID_MINUTES, SPLIT_MINUTES, SPLIT_COUNT = 30, 60, 3
ALIASES = {
    "transaction_time": ("交易时间", "交易日期", "记账时间", "发生时间", "完成时间", "支付时间", "时间"),
    "serial_number": ("交易流水号", "流水号", "银行流水号", "交易单号", "订单号", "商户订单号"),
    "payer_account": ("付款账号", "付款账户", "转出账号", "转出账户", "付款方账号"),
    "payer_name": ("付款户名", "付款人", "转出户名", "付款方", "付款方户名"),
    "payer_institution": ("付款机构", "付款方机构", "转出机构", "付款平台"),
    "payer_bank": ("付款行", "付款银行", "转出银行", "付款方银行"),
    "payee_account": ("收款账号", "收款账户", "转入账号", "转入账户", "收款方账号"),
    "payee_name": ("收款户名", "收款人", "转入户名", "收款方", "收款方户名"),
    "payee_institution": ("收款机构", "收款方机构", "转入机构", "收款平台"),
    "payee_bank": ("收款行", "收款银行", "转入银行", "收款方银行"),
    "debit_credit": ("借贷标志", "借贷方向", "收支类型", "方向"),
    "currency": ("币种", "货币"),
    "amount": ("交易金额", "金额", "发生额", "支付金额"),
    "balance_after": ("交易后余额", "余额", "账户余额"),
    "channel": ("交易渠道", "渠道", "支付方式"),
    "summary": ("摘要", "交易摘要", "用途", "备注"),
    "region": ("地区", "交易地区", "发生地"),
    "transaction_type": ("交易类型", "业务类型"),
}
INCOME_HEADERS, EXPENSE_HEADERS = ("收入金额", "贷方金额"), ("支出金额", "借方金额")
REJECT_ACCOUNT, REJECT_TIME, REJECT_AMOUNT = "缺少付款账号或收款账号", "缺少或无法解析交易时间", "缺少或无法解析交易金额"
CRITICAL_FIELDS = ("transaction_time", "serial_number", "payer_account", "payer_name", "payee_account", "payee_name", "amount", "channel", "summary")
