"""Personal data: patterns propose spans, checksums confirm them, nearby context words move the score.

A span's score starts from its kind's prior, rises by ``CONFIRMED`` where a checksum holds (Luhn for cards, mod-97 for
IBANs) or a secret's own marks do (a known prefix, or letters and digits as mixed as drawn ones), and by ``CONTEXT``
where a context word of its kind stands within ``NEAR`` characters before it. The four base kinds are exact by their
definition and always stay; the further kinds stay from ``ACCEPT`` on. They overlap neither base spans nor each other: of
those that would, the one with the better score stays, then the first, then the longest.

Cases: null text counts as empty and gives no spans; repeated rows give repeated results; every pattern runs in time
linear in the text, whatever it holds, so very long texts are safe; an empty table gives an empty result. Only the key
and the text are read, so further columns, of whatever name, do not matter.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import free_name, map_arrow, table, texts_of

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn", "phone_local", "secret")
PRIOR = {"email": 0.8, "ip": 0.6, "card": 0.4, "phone": 0.7, "iban": 0.3, "ssn": 0.35, "phone_local": 0.35, "secret": 0.05}
CONFIRMED, CONTEXT, ACCEPT, NEAR = 0.5, 0.3, 0.6, 40
#: What a known prefix of a secret counts for, as a share of ``CONFIRMED``: it needs no context word.
KNOWN = 1.2
CONTEXT_WORDS = {
    "email": ("email", "e-mail", "mail", "contact"),
    "ip": ("ip", "address", "host", "server"),
    "card": ("card", "visa", "mastercard", "credit", "karte", "tarjeta", "carte"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social security"),
    "phone_local": ("phone", "tel", "call", "mobile", "fax"),
    "secret": ("token", "secret", "password", "passwd", "api_key", "api key", "apikey", "private key", "bearer", "credential"),
}
#: Lengths of IBANs by country, all those of the public registry.
IBAN_LENGTH = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29,
    "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DJ": 27, "DK": 18, "DO": 28, "EE": 20, "EG": 29,
    "ES": 24, "FI": 18, "FK": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28,
    "HN": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20,
    "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19,
    "MN": 20, "MR": 27, "MT": 31, "MU": 30, "NI": 28, "NL": 18, "NO": 15, "OM": 23, "PK": 24, "PL": 28, "PS": 29,
    "PT": 25, "QA": 29, "RO": 24, "RS": 22, "RU": 33, "SA": 24, "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24,
    "SM": 27, "SO": 23, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
    "YE": 30,
}

LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
DOTTED = re.compile(r"[0-9][0-9.]*+")
QUAD = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
PHONE_LOCAL = re.compile(r"(?<![0-9+-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])")
#: Long runs of key characters; and what keys of well-known services begin with.
SECRET = re.compile(r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/-]{16,}+={0,2}")
PREFIX = re.compile(r"AKIA[0-9A-Z]{16}$|gh[pousr]_[A-Za-z0-9]{36}$|xox[abprs]-[A-Za-z0-9-]{10,}$|sk-[A-Za-z0-9_-]{20,}$|eyJ[A-Za-z0-9_-]{10,}$")
SCHEMA = "spans array<struct<kind: string, start: bigint, end: bigint, score: double>>"


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(x), 10)) for x in digits[-2::-2])) % 10 == 0


def mod97(iban: str) -> bool:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def emails(text: str):
    """Each @ with the longest local part before it and a domain after it: the pattern's leftmost matches, found in linear time."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL_CHARS:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def ips(text: str):
    for run in DOTTED.finditer(text):
        if run.group().count(".") >= 3:
            for m in QUAD.finditer(run.group()):
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                    yield run.start() + m.start(), run.start() + m.end()


def cards(text: str):
    for m in DIGITS.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def phones(text: str):
    for m in PHONE.finditer(text):
        if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
            yield m.span()


def further(text: str):
    """Spans of the kinds beyond the base ones, with what confirms them: (kind, start, end, confirmed)."""
    for m in IBAN.finditer(text):
        whole = m.group()
        length = IBAN_LENGTH.get(whole[:2], 0)
        seen = end = 0
        for end, c in enumerate(whole, 1):
            seen += c != " "
            if seen == length:
                break
        if length and seen == length and (end == len(whole) or whole[end] == " ") and mod97(whole[:end].replace(" ", "")):
            yield "iban", m.start(), m.start() + end, True
    for kind, pattern in (("ssn", SSN), ("phone_local", PHONE_LOCAL)):
        for m in pattern.finditer(text):
            yield kind, *m.span(), False


def drawn(run: str) -> bool:
    """Whether a run looks drawn at random: letters and digits that change often, and no character in too many places."""
    digits = sum(c.isdigit() for c in run)
    letters = sum(c.isalpha() for c in run)
    if digits < 3 or letters < 3 or len(set(run)) < 8:
        return False
    changes = sum(a.isdigit() != b.isdigit() for a, b in zip(run, run[1:], strict=False))
    return changes * 8 >= len(run) and max(map(run.count, set(run))) * 3 <= len(run)


def secrets(text: str):
    for m in SECRET.finditer(text):
        run = m.group()
        yield "secret", *m.span(), KNOWN if PREFIX.match(run) else drawn(run)


def spans(text: str) -> list[tuple[str, int, int, float]]:
    """All spans of a text as (kind, start, end, score), by start, then kind in the order of KINDS."""

    def score(kind: str, start: int, confirmed: float) -> float:
        before = text[max(0, start - NEAR) : start].lower()
        return min(1.0, PRIOR[kind] + CONFIRMED * confirmed + CONTEXT * any(w in before for w in CONTEXT_WORDS[kind]))

    found = [(k, s, e, score(k, s, k == "card")) for k, f in zip(BASE, (emails, ips, cards, phones), strict=True) for s, e in f(text)]
    more = [(k, s, e, score(k, s, ok)) for k, s, e, ok in (*further(text), *secrets(text))]
    taken = merged((s, e) for _, s, e, _ in found)
    for x in sorted((x for x in more if x[3] >= ACCEPT), key=lambda x: (-x[3], x[1], -x[2], KINDS.index(x[0]))):
        if free(taken, x[1], x[2]):
            bisect.insort(taken, x[1:3])
            found.append(x)
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def merged(found: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans without overlaps that cover what these cover."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(found):
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def free(taken: list[tuple[int, int]], start: int, end: int) -> bool:
    """Whether none of the sorted spans, which do not overlap each other, overlaps this one."""
    at = bisect.bisect_left(taken, (start, end))
    return not (at and taken[at - 1][1] > start) and not (at < len(taken) and taken[at][0] < end)


def joined(found: list[tuple[str, int, int, float]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e, _ in found)


def redact(text: str, found: list[tuple[str, int, int, float]]) -> str:
    """The text with each span, or run of overlapping spans, replaced by its first kind in brackets."""
    out, at = [], 0
    for kind, start, end, _ in found:
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def _mapped(df: DataFrame, columns: list[str], f: Callable[[str], tuple], schema: str) -> DataFrame:
    names = [x.strip().split(" ", 1)[0] for x in schema.split(";")]
    kept = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in df.select(*columns).schema)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [f(x) for x in texts_of(batch.column(len(columns)))]
        return pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], *(pa.array(x) for x in zip(*made, strict=True))], names=[*columns, *names])

    return map_arrow(df.select(*columns, df["text"].alias(free_name(columns, "_text"))), run, f"{kept}, {schema.replace(';', ',')}")


def detect(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key``, the whole text's spans as an array of (kind, start, end, score), and the redacted text."""

    def run(text: str):
        found = spans(text)
        return [dict(zip(("kind", "start", "end", "score"), x, strict=True)) for x in found], redact(text, found)

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        made = [run(x) for x in texts_of(b.column(1))]
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
        return pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in made], kind), pa.array([x for _, x in made], pa.string())], names=[key, "spans", "redacted"])

    return map_arrow(df.select(key, "text"), batch, f"`{key}` {df.schema[key].dataType.simpleString()}, {SCHEMA}, redacted string")


def redacted(df: DataFrame) -> DataFrame:
    """``df`` with its texts redacted and ``n_chars`` to match; all rows stay, a null text stays null."""
    from pyspark.sql import functions as F

    names = df.columns
    rest = [c for c in names if c not in ("text", "n_chars")]
    made = free_name(names, "_redacted")
    out = _mapped(df, [*rest, "text"], lambda t: (redact(t, spans(t)),), f"{made} string")
    out = out.withColumn("text", F.when(F.col("text").isNotNull(), F.col(made)))
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.length("text").cast(df.schema["n_chars"].dataType))
    return out.select(*names)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of the spans of every document, and their number."""

    def digest(text: str):
        found = spans(text)
        base = [x for x in found if x[0] in BASE]
        counts = [sum(x[0] == k for x in base) for k in BASE]
        return (*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(found), len(found))

    return _mapped(table(spark, sf_dir, "documents"), ["doc_id"], digest, "n_email bigint; n_ip bigint; n_card bigint; n_phone bigint; base_sha256 string; spans string; n_spans bigint")
