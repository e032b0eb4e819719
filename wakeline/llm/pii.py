"""Personal data: patterns propose spans, checksums confirm them, nearby context words adjust the score.

Base kinds (email, ip, card, phone) follow fixed rules; iban (mod-97) and ssn (needs a context word) are added.
Null and empty texts have no spans. Every document gives one row, repeated ids too. Offsets count code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.llm.common import table

# The kinds in the order of the contract, then those that this operator adds.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
CONTEXT = {
    "email": ("mail", "email", "contact", "write", "address"),
    "ip": ("ip", "host", "server", "address", "login"),
    "card": ("card", "visa", "mastercard", "credit", "payment", "pay"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "contact"),
    "iban": ("iban", "bank", "account", "transfer"),
    "ssn": ("ssn", "social", "security"),
}
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.9, "ssn": 0.3}
CONTEXT_CHARS = 40
SPANS = "array<struct<kind:string,start:int,end:int,value:string,score:double>>"

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])(?=([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}))")
_END = re.compile(r"[A-Z0-9](?![A-Za-z0-9])")
#: IBAN length of each country.
_IBAN_LENGTHS = {k[:2]: int(k[2:]) for k in (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 "
    "KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 SC31 SD18 SE24 SI19 SK24 SM27 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20"
).split()}
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_WORD = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Each @ is met once: the local part reaches back to the last match at most, so long runs stay linear."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", done)


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """From each start the ends at word limits are tried, that of the country's length first, then the longest, until mod-97 holds."""
    done = 0
    for m in _IBAN.finditer(text):
        start, most = m.span(1)
        if start < done:
            continue
        ends = [(e.end(), text[start : e.end()].replace(" ", "")) for e in _END.finditer(text, start, most + 1) if e.end() <= most]
        own = _IBAN_LENGTHS.get(text[start : start + 2])
        for end, value in sorted(ends, key=lambda e: (len(e[1]) != own, -e[0])):
            if len(value) >= 15 and mod97(value):
                yield start, end
                done = end
                break


def _digits(s: str) -> str:
    return re.sub(r"[^0-9]", "", s)


def _score(kind: str, text: str, start: int, end: int) -> float:
    near = {w.lower() for w in _WORD.findall(text[max(0, start - CONTEXT_CHARS) : start] + " " + text[end : end + CONTEXT_CHARS])}
    return round(min(1.0, PRIOR[kind] + (0.3 if near.intersection(CONTEXT[kind]) else 0.0)), 2)


def find(text: str | None, min_score: float = 0.5) -> list[tuple[str, int, int, str, float]]:
    """All spans of a text by start, then kind. min_score holds for the added kinds only; base spans always stay."""
    if not text:
        return []
    found = [("email", *s) for s in _emails(text)]
    if re.search("[0-9]", text):
        found += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split("."))]
        found += [("card", *m.span()) for m in _CARD.finditer(text) if 14 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
        found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
        found += [("iban", *s) for s in _ibans(text)]
        found += [("ssn", *m.span()) for m in _SSN.finditer(text)]
    scored = [(k, s, e, text[s:e], _score(k, text, s, e)) for k, s, e in found]
    return sorted((x for x in scored if x[0] in KINDS[:4] or x[4] >= min_score), key=lambda x: (x[1], KINDS.index(x[0])))


def redacted(text: str | None) -> str | None:
    """Every span becomes <KIND>; of overlapping ones the union is replaced under the first one's kind."""
    spans = find(text)
    if not spans:
        return text
    out, at, i = [], 0, 0
    while i < len(spans):
        kind, start, end = spans[i][:3]
        while i + 1 < len(spans) and spans[i + 1][1] < end:
            i += 1
            end = max(end, spans[i][2])
        out += [text[at:start], f"<{kind.upper()}>"]
        at, i = end, i + 1
    return "".join(out) + text[at:]


def detect(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id and `spans`: kind, start, end, value and score of every span."""

    @F.pandas_udf(SPANS)
    def spans_of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [dict(zip(("kind", "start", "end", "value", "score"), x, strict=True)) for x in find(t)])

    return docs.select(F.col(id_col).alias("doc_id"), spans_of(F.col(text)).alias("spans"))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """The same rows and columns, personal data replaced by typed placeholders."""

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        return texts.map(redacted, na_action="ignore")

    return docs.withColumn(text, clean(F.col(text)))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS[:4]))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of_kind = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [of_kind(kind) for kind in KINDS]
    return found.select("doc_id", *counts[:4], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), *counts[4:], F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0)).alias("max_score"))
