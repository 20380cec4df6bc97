"""PII: regular expressions propose spans, checksums confirm them, nearby context words adjust the score.

Null text: no spans. A kind's matches are leftmost and do not overlap; a match that its validator
rejects is dropped and not tried again, but an IBAN is sought at every start and, from the longest on, at every
end of a group, as capital letters that follow it ("BIC") look like groups. Every pattern runs in time linear in the text, so very long
texts and long runs of digits or letters are harmless. Repeated rows are handled alike.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, table, text_of

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn")
SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_DIGITS = re.compile(r"[0-9]+")

#: Starting score of a proposed span; words (English, German, French, Spanish) that raise it and words that lower it when they stand within REACH characters.
START = {"email": 0.8, "ip": 0.7, "card": 0.7, "phone": 0.6, "iban": 0.8, "ssn": 0.3}
CONTEXT = {
    "email": "email e-mail mail contact write kontakt courriel écrire correo contacto escribir",
    "ip": "ip address host server login adresse serveur dirección servidor",
    "card": "card visa mastercard credit debit payment karte kreditkarte carte paiement tarjeta pago",
    "phone": "phone tel telephone mobile call fax telefon handy anrufen téléphone portable appeler teléfono móvil llamar",
    "iban": "iban bank account transfer konto überweisung banque compte virement banco cuenta transferencia",
    "ssn": "ssn social security insurance taxpayer sozialversicherung versicherungsnummer steuernummer sécurité sociale assuré seguro seguridad contribuyente",
}
AGAINST = "isbn invoice order version example sample tracking part rechnung bestellung beispiel artikel facture commande exemple factura pedido ejemplo"
_NEAR = {k: re.compile(r"(?i)\b(?:" + "|".join(map(re.escape, v.split())) + r")\b") for k, v in (CONTEXT | {"against": AGAINST}).items()}
REACH, RAISE, LOWERED, LEAST = 50, 0.3, 0.2, 0.5


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    s = iban.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        after = at + 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = after = m.end()
        at = text.find("@", after)


def _spans_of(pattern: re.Pattern, text: str, holds) -> Iterator[tuple[int, int]]:
    for m in pattern.finditer(text):
        if holds(m.group()):
            yield m.span()


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    m = _IBAN.search(text)
    while m:
        start, end = m.span()
        while end > start and not mod97(text[start:end]):
            end = text.rfind(" ", start, end)
        if end > start:
            yield start, end
        m = _IBAN.search(text, max(end, start + 4))


def _is_card(s: str) -> bool:
    d = "".join(_DIGITS.findall(s))
    return 14 <= len(d) <= 19 and luhn(d)


def find(text: str) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score), by start and then kind as listed."""
    found = [("email", *x) for x in _emails(text)]
    found += [("ip", *x) for x in _spans_of(_IP, text, lambda s: all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in s.split(".")))]
    found += [("card", *x) for x in _spans_of(_CARD, text, _is_card)]
    if "+" in text:
        found += [("phone", *x) for x in _spans_of(_PHONE, text, lambda s: 10 <= sum(map(len, _DIGITS.findall(s))) <= 15)]
    found += [("iban", *x) for x in _ibans(text)]
    found += [("ssn", *x) for x in _spans_of(_SSN, text, lambda s: True)]
    scored = []
    for kind, start, end in found:
        near, against = (bool(p.search(text, max(0, start - REACH), start) or p.search(text, end, end + REACH)) for p in (_NEAR[kind], _NEAR["against"]))
        score = min(1.0, round(START[kind] + RAISE * near - LOWERED * against, 6))
        if kind in BASE or score >= LEAST:
            scored.append((kind, start, end, score))
    return sorted(scored, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def redact(text: str, spans: list[tuple[str, int, int, float]]) -> str:
    """Each span, or run of overlapping spans, becomes <KIND> of its first span."""
    out, done = [], 0
    for kind, start, end, _ in spans:
        if start >= done:
            out += [text[done:start], f"<{kind.upper()}>"]
        done = max(done, end)
    return "".join(out) + text[done:]


def _scan(batches: Iterator[pa.RecordBatch], keep_text: bool) -> Iterator[pa.RecordBatch]:
    struct = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])
    for batch in batches:
        texts, spans = [], []
        for value in batch.column(batch.schema.get_field_index("__text")):
            text = value.as_py() or ""
            got = find(text)
            spans.append([dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in got])
            if keep_text:
                texts.append(redact(text, got) if got else text)
        columns = [c for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != "__text"]
        names = [n for n in batch.schema.names if n != "__text"]
        columns.append(pa.array(spans, pa.list_(struct)))
        names.append("__spans")
        if keep_text:
            columns.append(pa.array(texts, pa.string()))
            names.append("__redacted")
        yield pa.RecordBatch.from_arrays(columns, names)


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans) for every row."""
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    got = docs.select(F.col(id_col).alias("__id"), text_of(text_col).alias("__text")).mapInArrow(lambda b: _scan(b, False), f"__id {kind}, __spans {SPANS}")
    return got.select(F.col("__id").alias(id_col), F.col("__spans").alias("spans"))


def redact_documents(docs: DataFrame) -> DataFrame:
    """All rows and columns of docs, with personal data replaced in text and n_chars counted anew. A null text stays null."""
    ship(docs.sparkSession)
    rest = [c for c in docs.columns if c not in ("text", "n_chars")]
    kinds = ", ".join(f"`c{k}` {docs.schema[c].dataType.simpleString()}" for k, c in enumerate(rest))
    slim = docs.select(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(rest)), F.col("text").isNull().alias("__null"), text_of().alias("__text"))
    got = slim.mapInArrow(lambda b: _scan(b, True), ", ".join(x for x in (kinds, "__null boolean", f"__spans {SPANS}", "__redacted string") if x))
    text = F.when(~F.col("__null"), F.col("__redacted"))
    made = {c: F.col(f"c{k}") for k, c in enumerate(rest)} | {"text": text}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType)
    return got.select(*(made[c].alias(c) for c in docs.columns))


def op2_pii(spark, sf_dir: str) -> DataFrame:
    of_kind = lambda kind: F.filter("spans", lambda s: s["kind"] == kind)
    listed = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["kind"].isin(*BASE))
    return find_spans(table(spark, sf_dir, "documents")).select(
        "doc_id",
        *(F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in BASE),
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(spans).alias("spans"),
        F.aggregate(spans, F.lit(0.0), lambda a, s: F.greatest(a, s["score"])).alias("top_score"),
    )
