"""Personal data with offset-preserving deobfuscation.

Base spans follow four fixed patterns on the text itself. Then transducers rewrite the text:
homoglyphs, full-width forms and foreign digits become ASCII, invisible characters vanish, spelled
digits become digits, at/dot disguises become '@' and '.'. Every character of the rewritten text
remembers the source characters it came from, the same patterns run on it, and a hit that needed a
rewritten character is mapped back to a span of the source. Base spans always stay; a rewritten
hit is added unless it overlaps a base span of its kind.

All matching is linear in the text's length. Defined cases: null counts as empty; repeated rows
give repeated results; extra columns don't matter.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("email", "ip", "card", "phone")

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGIT = re.compile(r"[0-9]")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

# Characters that look like an ASCII one.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w", "ɡ": "g",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "У": "Y", "І": "I", "Ј": "J", "Ѕ": "S",
    "α": "a", "ο": "o", "ν": "v", "ρ": "p", "τ": "t", "υ": "u", "κ": "k", "ι": "i", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "。": ".", "․": ".", "﹒": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "﹣": "-", "﹢": "+", "﹫": "@", " ": " ", " ": " ", " ": " ",
}
INVISIBLE = "­​‌‍⁠﻿"
DIGIT_WORDS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
TOP_LEVEL = "com org net edu gov io info biz dev app ai co uk eu de fr es ch ca"


def _look_alikes() -> dict[str, str]:
    table = dict(HOMOGLYPHS)
    table.update({chr(0xFEE0 + c): chr(c) for c in range(0x21, 0x7F)})  # full-width forms
    for zero in (0x0660, 0x06F0, 0x0966, 0x09E6, 0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6):  # digits of other scripts and styles
        table.update({chr(zero + k): str(k) for k in range(10)})
    table.update({c: "" for c in INVISIBLE})
    return table


_TABLE = _look_alikes()
_ODD = "[" + "".join(map(re.escape, _TABLE)) + "]"
_AT = r"\s*[\[({<]\s*at\s*[\])}>]\s*"
_DOT = r"\s*[\[({<]\s*(?:dot|punkt|punto|point)\s*[\])}>]\s*"
_HOST = r"[A-Za-z0-9-]{1,63}"
#: A bare ' at ' counts only before a host spelled with ' dot ' and a known ending.
_BARE_AT = rf"(?<=[A-Za-z0-9])\s(?:at|AT)\s(?=(?:{_HOST}\s(?:dot|DOT)\s){{1,4}}(?:{TOP_LEVEL.replace(' ', '|')})\b)"
_BARE_DOT = rf"(?<=[A-Za-z0-9])\s(?:dot|DOT)\s(?=(?:{_HOST}\s(?:dot|DOT)\s){{0,4}}(?:{TOP_LEVEL.replace(' ', '|')})\b|[0-9])"
_WORD = rf"\b(?:{'|'.join(DIGIT_WORDS)})\b"
_PLUS = rf"\bplus\s+(?=[0-9]|(?:{'|'.join(DIGIT_WORDS)})\b)"
_REWRITE = re.compile(rf"(?P<odd>{_ODD})|(?P<at>{_AT}|{_BARE_AT})|(?P<dot>{_DOT}|{_BARE_DOT})|(?P<word>{_WORD})|(?P<plus>{_PLUS})", re.I)
_BRACKETED = re.compile(r"[\[({<]\s*(?:at|dot|punkt|punto|point)\s*[\])}>]", re.I)
_LOOKS_ODD = frozenset(_TABLE)
#: Each spelled rewriting but a bracketed one has one of these; a bare at needs a dot.
_SPELLED = (*DIGIT_WORDS, "plus", "dot")


def _folded(text: str) -> str:
    """Lower case, with the three letters that patterns without case also take for s and i."""
    return (text if text.isascii() else text.replace("\u017f", "s").replace("\u0131", "i").replace("\u0130", "i")).lower()


def disguised(text: str) -> bool:
    """False only if no alternative of _REWRITE occurs in the text; quick on plain texts."""
    if not text.isascii() and not _LOOKS_ODD.isdisjoint(text):
        return True
    low = _folded(text)
    if not any(map(low.__contains__, _SPELLED)) and not _BRACKETED.search(text):
        return False
    return _REWRITE.search(text) is not None


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def detect(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the four patterns, leftmost and non-overlapping in each kind, in order."""
    found, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (domain := _DOMAIN.match(text, at + 1)):
            last = domain.end()
            found.append((start, 0, last))
        at = text.find("@", at + 1)
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m.group().split(".")):
                found.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
        for m in _PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


def rewrite(text: str) -> tuple[str, list[int], list[int], list[bool]] | None:
    """The normalised text and, for each of its characters, the source span and whether it was rewritten."""
    if not disguised(text):
        return None
    out, starts, ends, changed, last = [], [], [], [], 0

    def copy(a: int, b: int) -> None:
        out.append(text[a:b])
        starts.extend(range(a, b))
        ends.extend(range(a + 1, b + 1))
        changed.extend([False] * (b - a))

    for m in _REWRITE.finditer(text):
        copy(last, m.start())
        last = m.end()
        kind, value = m.lastgroup, m.group()
        new = {"at": "@", "dot": ".", "plus": "+"}.get(kind) if kind in ("at", "dot", "plus") else DIGIT_WORDS[_folded(value)] if kind == "word" else _TABLE.get(value, value)
        if new:
            out.append(new)
            starts.append(m.start())
            ends.append(m.end())
            changed.append(True)
        elif ends:
            changed[-1] = True  # the vanished character hides in what comes before it
    copy(last, len(text))
    return "".join(out), starts, ends, changed


def added(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans of the source that only the normalised text shows."""
    view = rewrite(text)
    if not view:
        return []
    normal, starts, ends, changed = view
    more = []
    for start, kind, end in detect(normal):
        a, b = starts[start], ends[end - 1]
        if any(changed[start:end]) and not any(k == kind and s < b and a < e for s, k, e in base):
            more.append((a, kind, b))
    return more


def named(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


SCHEMA = T.StructType([T.StructField(f"n_{k}", T.LongType()) for k in KINDS] + [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])


@F.pandas_udf(SCHEMA)
def pii_udf(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for text in texts:
        text = text or ""
        base = detect(text)
        counts = [sum(k == kind for _, k, _ in base) for kind in range(len(KINDS))] if base else [0] * len(KINDS)
        rows.append((*counts, hashlib.sha256(named(base).encode()).hexdigest(), named(sorted({*base, *added(text, base)}))))
    return pd.DataFrame(rows, columns=SCHEMA.names)


def masked(text: str | None) -> str | None:
    """The text with every span replaced by its kind; overlapping spans are replaced together."""
    if not text:
        return text
    base = detect(text)
    out, last = [], 0
    for start, kind, end in sorted({*base, *added(text, base)}):
        if start >= last:
            out += [text[last:start], f"[{KINDS[kind].upper()}]"]
        last = max(last, end)
    return "".join(out) + text[last:]


@F.pandas_udf(T.StringType())
def mask_udf(texts: pd.Series) -> pd.Series:
    return texts.map(masked)


def op3_pii_spans(spark, sf_dir: str) -> DataFrame:
    """The contract's columns for every document; the counts are those of base spans."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return docs.select("doc_id", pii_udf("text").alias("r")).select("doc_id", "r.*")


def without_pii(docs: DataFrame) -> DataFrame:
    """The pipeline's form: spans are masked in text; n_chars, where there is one, follows."""
    out = docs.withColumn("text", mask_udf("text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)
