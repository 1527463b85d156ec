"""Personal data: regular expressions propose, checksums confirm, context words adjust the score.

Definitions:
* a null text is an empty text and has no spans; every input row gives one output row, repeated rows included;
* positions are code points, the end is exclusive; every text is read whole and in time linear in its length;
* spans of the four basic kinds are kept whatever their score, further kinds only from ``threshold`` up;
* only the id and text columns are read, so further columns, whatever their names, play no part;
* an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASIC = KINDS[:4]

# Lengths of account numbers by country (ISO 13616).
IBAN_LENGTH = {
    "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27,
    "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27,
    "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TR": 26,
}

# Words near a span that speak for its kind, in the languages of the texts.
CONTEXT = {
    "email": ("mail", "email", "e-mail", "contact", "write", "schreiben", "kontakt", "courriel", "correo", "contacto"),
    "ip": ("ip", "host", "server", "address", "adresse", "serveur", "servidor"),
    "card": ("card", "visa", "mastercard", "credit", "karte", "kreditkarte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "anrufen", "appeler", "llamar", "teléfono", "téléphone"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social", "security"),
}
#: Words that speak against a number being personal.
AGAINST = ("version", "order", "invoice", "isbn", "serial", "bestellung", "rechnung", "facture", "factura", "pedido")

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?= ?[A-Z0-9])")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
DIGIT = re.compile(r"[0-9]")
NOT_DIGIT = str.maketrans("", "", " -().+")
WORD = re.compile(r"[^\W\d_][\w-]*")

SPAN = "array<struct<kind:string,start:long,end:long,score:double,base:boolean>>"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i & 1:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def mod97(account: str) -> bool:
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each @ outwards so that long runs of letters cost one pass."""
    free, at = 0, text.find("@")
    while at >= 0:
        before = text[free:at]
        start = free + len(before.rstrip(LOCAL))
        m = DOMAIN.match(text, at + 1) if start < at else None
        free = m.end() if m else at + 1
        if m:
            yield start, free
        at = text.find("@", free)


def octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def propose(text: str) -> Iterator[tuple[str, int, int, float]]:
    """(kind, start, end, score before context) of every proposal that its validator confirms."""
    for s, e in emails(text):
        yield "email", s, e, 0.7
    if not DIGIT.search(text):
        return
    for m in IP.finditer(text):
        if all(octet(p) for p in m.group().split(".")):
            yield "ip", m.start(), m.end(), 0.6
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m.group().translate(NOT_DIGIT)
            if 16 <= len(digits) <= 19 and luhn(digits):
                yield "card", m.start(), m.end(), 0.7
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= len(m.group().translate(NOT_DIGIT)) <= 15:
                yield "phone", m.start(), m.end(), 0.6
    for m in IBAN.finditer(text):
        end, need = account_end(text, m.start(), IBAN_LENGTH.get(m.group()[:2], 0))
        if need and mod97(text[m.start():end].replace(" ", "")):
            yield "iban", m.start(), end, 0.8
    for m in SSN.finditer(text):
        a, b, c = m.group().split("-")
        if a not in ("000", "666") and a < "900" and b != "00" and c != "0000":
            yield "ssn", m.start(), m.end(), 0.35


def account_end(text: str, start: int, length: int) -> tuple[int, bool]:
    """End of an account number of ``length`` characters, single blanks between them allowed; False if there is none."""
    at, seen = start, 0
    while seen < length and at < len(text):
        c = text[at]
        if c == " " and text[at - 1] != " " and seen:
            at += 1
            continue
        if not (c.isascii() and (c.isupper() or c.isdigit())):
            return at, False
        seen, at = seen + 1, at + 1
    whole = length > 0 and seen == length and not (at < len(text) and text[at].isascii() and text[at].isalnum())
    return at, whole


def adjusted(text: str, kind: str, start: int, end: int, score: float, reach: int) -> float:
    """Raise or lower a score by the words within ``reach`` characters."""
    near = {w.lower() for w in WORD.findall(text[max(0, start - reach):start] + " " + text[end:end + reach])}
    if not near.isdisjoint(CONTEXT[kind]):
        score += 0.25
    if not near.isdisjoint(AGAINST):
        score -= 0.25
    return round(min(1.0, max(0.0, score)), 2)


def spans_of(text: str, threshold: float, reach: int) -> list[dict]:
    out = []
    for kind, start, end, score in propose(text):
        score, base = adjusted(text, kind, start, end, score, reach), kind in BASIC
        if base or score >= threshold:
            out.append({"kind": kind, "start": start, "end": end, "score": score, "base": base})
    return sorted(out, key=lambda s: (KINDS.index(s["kind"]), s["start"]))


def find_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.5, reach: int = 40) -> DataFrame:
    """``(key, spans)`` for every row of ``docs``; one pass, no shuffle."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("base", pa.bool_())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [spans_of(t, threshold, reach) if t else [] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], names=["key", "spans"])

    source = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = f"key {source.schema['key'].dataType.simpleString()}, spans {SPAN}"
    return source.mapInArrow(scan, schema).withColumnRenamed("key", key)


def joined(spans):
    """``kind:start:end`` of an array of spans, comma-joined."""
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def digest_columns(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts by basic kind, digest of the basic spans, and all spans as text."""
    base = F.filter("spans", lambda s: s["base"])
    count = lambda k: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == k))).cast("long")
    return found.select(
        key,
        *[count(k).alias(f"n_{k}") for k in BASIC],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0)).alias("top_score"),
    )
