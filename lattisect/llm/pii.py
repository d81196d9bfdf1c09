"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

Spark functions only. Every pattern is written so that a failed attempt is not repeated inside the
same run of characters (possessive repeats; a look-behind, or the end of the last match, before the
first character), so one scan is linear in the text even where a whole text is one long run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let
from .spans import as_text, count_kind, in_order, spans

#: Kinds in the order that breaks ties of position; the first four always stay once they are valid.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn")

#: Countries of account numbers by the characters of a number, spaces left out.
IBAN_LENGTHS = {
    15: "NO",
    16: "BE",
    18: "DK FI FK FO GL NL SD",
    19: "MK SI",
    20: "AT BA EE KZ LT LU MN XK",
    21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST",
    26: "IS TR",
    27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA",
    30: "JO KW MU YE",
    31: "MT SC",
    32: "LC",
    33: "RU",
}
#: A number of its country's length, so that it ends there whatever words follow.
IBAN = "|".join(rf"(?:{codes.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, codes in IBAN_LENGTHS.items())

PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": rf"(?<![A-Za-z0-9])(?:{IBAN})(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}

#: A score starts at PRIOR, gains CONTEXT if one of the words stands within WINDOW code points before the span.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.9, "phone": 0.6, "iban": 0.9, "ssn": 0.3}
CONTEXT = 0.35
WINDOW = 40
WORDS = {
    "email": "mail|contact|write",
    "ip": "address|host|server|login",
    "card": "card|visa|credit|payment",
    "phone": "phone|call|tel|mobile|fax",
    "iban": "iban|account|bank|konto",
    "ssn": "ssn|social|security",
}
#: Spans of added kinds below this are dropped.
LEAST = 0.5


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    value = F.transform(
        F.split(F.reverse(digits), ""),
        lambda d, i: let(d.cast("int") * (1 + i % 2), lambda v: F.when(v > 9, v - 9).otherwise(v)),
    )
    return F.aggregate(value, F.lit(0), lambda a, v: a + F.coalesce(v, F.lit(0))) % 10 == 0


def _mod97(found: Column) -> Column:
    """Whether an account number's check digits hold: the rearranged number leaves 1 modulo 97."""
    plain = F.regexp_replace(found, r"\x20", "")
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))
    value = F.transform(F.split(turned, ""), lambda c: F.conv(c, 36, 10).cast("int"))
    return F.aggregate(value, F.lit(0), lambda a, v: (F.when(v > 9, a * 100).otherwise(a * 10) + v) % 97) == 1


def _valid(kind: str):
    if kind == "ip":
        part = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
        return lambda m: m["found"].rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return lambda m: let(_digits(m["found"]), lambda d: F.when(F.length(d).between(12, 19), _luhn(d)).otherwise(False))
    if kind == "phone":
        return lambda m: F.length(_digits(m["found"])).between(9, 15)
    if kind == "iban":
        return lambda m: _mod97(m["found"])
    return None


def _score(text: Column, kind: str):
    def of(m: Column) -> Column:
        first = F.greatest(m["start"] - WINDOW, F.lit(0))
        before = F.substring(text, (first + 1).cast("int"), (m["start"] - first).cast("int"))
        return F.least(F.lit(PRIOR[kind]) + F.when(before.rlike(f"(?i){WORDS[kind]}"), CONTEXT).otherwise(0.0), F.lit(1.0))

    return of


def _guard(text: Column, kind: str) -> Column:
    """A cheap test that no text with a match of this kind fails."""
    if kind == "email":
        return text.contains("@")
    if kind == "phone":
        return text.contains("+")
    if kind == "iban":
        return text.rlike(r"[A-Z]{2}[0-9]{2}")
    return text.rlike({"ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){11}", "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}"}[kind])


def find(text: Column, kinds: tuple[str, ...] = KINDS) -> Column:
    """Scored spans of personal data in a text, in order. The four base kinds stay whatever their score."""
    parts = []
    for kind in kinds:
        found = spans(text, kind, KINDS.index(kind), PATTERNS[kind], _valid(kind), _score(text, kind), _guard(text, kind))
        parts.append(found if kind in BASE else F.filter(found, lambda s: s["score"] >= LEAST))
    return in_order(parts)


def personal_data(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", out: str = "found") -> DataFrame:
    """``id_col`` and ``out``, the array of scored spans, for every row.

    A null or empty text has no spans. Rows are judged on their own: repeated rows and null ids
    come out as they came in. Other columns of ``df`` are left out, whatever their names.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.select(F.col(id_col), text.alias("__text")).select(F.col(id_col), find(F.col("__text")).alias(out))


def digest(found: DataFrame, id_col: str = "doc_id", out: str = "found") -> DataFrame:
    """Counts and digests of what ``personal_data`` returns."""
    base = lambda s: s["kind"].isin(*BASE)
    return found.select(
        F.col(id_col),
        *[count_kind(F.col(out), k).alias(f"n_{k}") for k in BASE],
        F.sha2(as_text(F.filter(out, base)), 256).alias("base_sha256"),
        as_text(F.col(out)).alias("spans"),
    )
