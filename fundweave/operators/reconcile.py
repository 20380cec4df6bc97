"""Re-parsed sources against earlier drafts, evidence rows, seeds, materials and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.text import clean_account, clean_identifier


#: Records are ordered: other sources by seq, then the new rows by theirs, then leftovers.
ORDER = 10**15
#: Where a record stands in its source; a struct named source holds the same.
COORDINATES = ("source_file_id", "archive_member_path", "page_number", "sheet_name", "table_number", "paragraph_number", "row_number", "region")


def identity(columns: list[str]) -> Column:
    """All source coordinates with the serial, or with time, accounts and amount where there is none. Nulls count: a null coordinate is not a blank one, nor the next one's value."""
    kept = lambda *c: F.to_json(F.struct(*c), {"ignoreNullFields": "false"})
    where = ["source"] if "source" in columns else [c for c in COORDINATES if c in columns]
    serial = clean_identifier(F.col("serial_number"))
    time = F.date_format("transaction_time", "yyyy-MM-dd'T'HH:mm:ss").alias("t")
    rest = kept(time, "payer_account", "payee_account", F.col("amount").cast(S.MONEY).cast("string").alias("a"))
    return F.concat_ws("|", kept(*where), F.when(serial != "", serial).otherwise(rest))


def reconcile(drafts: DataFrame, new: DataFrame, source_file_id: str, replace_missing: bool) -> DataFrame:
    """Drafts after a source was parsed again, with `origin` (other, new, kept, updated, leftover) and a new seq.

    The k-th new row of an identity meets its k-th earlier row: that stays if it was confirmed, is in
    conflict or was confirmed by a person; else the new values come with the old id, status and note.
    Earlier rows that meet none stay only without replace_missing. Columns of new are those of drafts.
    """
    file = F.col("source.source_file_id" if "source" in drafts.columns else "source_file_id")
    is_source = file.eqNullSafe(F.lit(source_file_id))
    merged = merge(drafts.where(is_source), new)
    if replace_missing:
        merged = merged.where("origin != 'leftover'")
    return drafts.where(~is_source).withColumn("origin", F.lit("other")).unionByName(merged)


def merge(drafts: DataFrame, new: DataFrame) -> DataFrame:
    """reconcile() for all earlier records and all new rows of any number of sources, each with its own coordinates; leftovers stay."""
    nth = Window.partitionBy("__id").orderBy("seq")  # repeats of one identity inside one source
    number = lambda d: d.withColumn("__id", identity(d.columns)).withColumn("__k", F.row_number().over(nth))
    both = number(new).alias("n").join(number(drafts).alias("o"), ["__id", "__k"], "full")
    met, has_new = F.col("o.seq").isNotNull() & F.col("n.seq").isNotNull(), F.col("n.seq").isNotNull()
    human = F.coalesce(F.col("o.provenance"), F.lit("")) == "human_confirmed" if "provenance" in drafts.columns else F.lit(False)
    keep = met & (F.col("o.review_status").isin("confirmed", "conflict") | human)
    origin = F.when(keep, "kept").when(met, "updated").when(has_new, "new").otherwise("leftover")
    from_old = [c for c in ("transaction_id", "review_status", "review_note") if c in drafts.columns]
    value = {c: F.when(keep | ~has_new, F.col(f"o.{c}")).when(met, F.col(f"{'o' if c in from_old else 'n'}.{c}")).otherwise(F.col(f"n.{c}")) for c in drafts.columns if c != "seq"}
    return both.select(*(v.alias(c) for c, v in value.items()), origin.alias("origin"), F.when(has_new, F.col("n.seq") + ORDER).otherwise(F.col("o.seq") + 2 * ORDER).alias("seq"))


def evidence_rows(records: DataFrame, chunks: DataFrame) -> DataFrame:
    """(transaction_id, row_number): the row of the record's chunk whose cleaned text holds its cleaned serial, if exactly one does.

    records: transaction_id, chunk_id, serial_number. chunks: chunk_id, row_evidence.
    """
    serial = clean_identifier(F.col("serial_number"))
    hits = F.filter("row_evidence", lambda e: (serial != "") & F.contains(clean_identifier(e["text"]), serial))
    return records.join(chunks, "chunk_id", "left").select("transaction_id", F.when(F.size(hits) == 1, hits[0]["row_number"]).alias("row_number"))


def seed_reasons(seeds: DataFrame, victims: DataFrame, tx: DataFrame) -> DataFrame:
    """seeds with reason (null: accepted). seeds: victim_id, transaction_id. victims: victim_id, accounts."""
    v = victims.select("victim_id", F.transform("accounts", clean_account).alias("__accounts"))
    t = tx.select("transaction_id", F.col("review_status").alias("__status"), F.col("payer_account").alias("__payer"))
    reason = F.when(F.col("__accounts").isNull(), "所选受害人不存在").when(~F.col("__status").eqNullSafe(F.lit("confirmed")), "起点必须来自已确认流水")
    reason = reason.when(~F.array_contains("__accounts", F.col("__payer")), "起点流水的付款账号必须属于所选受害人")
    return seeds.join(v, "victim_id", "left").join(t, "transaction_id", "left").withColumn("reason", reason).drop("__accounts", "__status", "__payer")


def compare(expected: DataFrame, actual: DataFrame, fields: tuple[str, ...] = S.CRITICAL_FIELDS) -> DataFrame:
    """(key…, verdict): correct, mismatched, missing or extra, by full outer join on file and serial."""
    e, a = expected.alias("e"), actual.alias("a")
    both = e.join(a, (F.col("e.source_file_id") == F.col("a.source_file_id")) & (F.col("e.serial_number") == F.col("a.serial_number")), "full")
    same = F.lit(True)
    for f in fields:
        same = same & F.col(f"e.{f}").eqNullSafe(F.col(f"a.{f}"))
    verdict = F.when(F.col("a.serial_number").isNull(), "missing").when(F.col("e.serial_number").isNull(), "extra").when(same, "correct").otherwise("mismatched")
    return both.select(F.coalesce("e.source_file_id", "a.source_file_id").alias("source_file_id"), F.coalesce("e.serial_number", "a.serial_number").alias("serial_number"), verdict.alias("verdict"))


def format_metrics(verdicts: DataFrame, key: str = "source_file_id") -> DataFrame:
    n = lambda v: F.count_if(F.col("verdict") == v)
    expected = F.count_if(F.col("verdict") != "extra")
    return verdicts.groupBy(key).agg(
        expected.alias("expected"), n("correct").alias("correct"), n("missing").alias("missing"), n("mismatched").alias("mismatched"), n("extra").alias("extra"),
        F.when(expected == 0, 0.0).otherwise(n("correct") / expected).alias("accuracy"),
    )


def material_status(errors: Column, created: Column, used_model: Column) -> Column:
    return F.when((errors > 0) & (created > 0), "partial").when(errors > 0, "failed").when((created > 0) | used_model, "parsed").otherwise("extracted")


def first_by_content(materials: DataFrame, content: str = "content") -> DataFrame:
    """materials with sha256 and duplicate (an earlier one, by seq, has the same bytes)."""
    hashed = materials.withColumn("sha256", F.sha2(content, 256))
    first = hashed.groupBy("sha256").agg(F.min("seq").alias("__first"))
    return hashed.join(first, "sha256").withColumn("duplicate", F.col("seq") > F.col("__first")).drop("__first")


def update(drafts: DataFrame, transaction_id: str, changes: dict) -> DataFrame:
    """drafts with one row changed (None: no change); a row that ends confirmed becomes human_confirmed. Mark duplicates anew afterwards."""
    mine = F.col("transaction_id") == transaction_id
    out = drafts.withColumns({c: F.when(mine, F.lit(v).cast(drafts.schema[c].dataType)).otherwise(F.col(c)) for c, v in changes.items() if v is not None})
    if "provenance" in drafts.columns:
        out = out.withColumn("provenance", F.when(mine & (F.col("review_status") == "confirmed"), "human_confirmed").otherwise(F.col("provenance")))
    return out


def confirm_all(drafts: DataFrame) -> DataFrame:
    return drafts.withColumn("review_status", F.when(F.col("review_status") == "pending", "confirmed").otherwise(F.col("review_status")))
