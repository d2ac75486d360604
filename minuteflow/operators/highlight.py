"""Snippets around the first match of a query."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from minuteflow.functions.text import ASCII_TERM

LONG, BEFORE, AFTER, SNIPPETS = 80, 20, 30, 8


def _pattern(term: str) -> str:
    quoted = re.escape(term)
    return f"(?i)(?<![a-z0-9]){quoted}(?![a-z0-9])" if re.fullmatch(ASCII_TERM[1:-1], term.lower()) else f"(?i){quoted}"


def highlight(text: Column, term: str) -> Column:
    """The first match in <mark>; the text itself if there is none."""
    return F.regexp_replace(text, f"(?s)^(.*?)({_pattern(term)})", "$1<mark>$2</mark>") if term else text


def snippet(text: Column, terms: list[str]) -> Column:
    """A marked snippet for the first term that matches, or null; short texts are kept whole."""

    def around(term: str) -> Column:
        start = F.regexp_instr(text, F.lit(_pattern(term))) - 1
        low, high = F.greatest(start - BEFORE, F.lit(0)), start + len(term) + AFTER
        part = highlight(F.substring(text, low + 1, high - low), term)
        cut = F.concat(F.when(low > 0, "...").otherwise(""), part, F.when(high < F.length(text), "...").otherwise(""))
        return F.when(start >= 0, F.when(F.length(text) <= LONG, highlight(text, term)).otherwise(cut))

    return F.coalesce(*[around(t) for t in terms if t]) if any(terms) else F.lit(None).cast("string")


def holds_term(text: Column, term: str) -> Column:
    """Whether a text holds a term; a blank term or a null text doesn't."""
    return F.coalesce(F.regexp_like(text, F.lit(_pattern(term))), F.lit(False)) if (term or "").strip() else F.lit(False)


def snippets(rows: DataFrame, key: str, fields: tuple[str, ...], query: str, more: tuple[str, ...] = ()) -> DataFrame:
    """(key, snippets): up to 8 distinct (field, snippet) of each row, direct hits first, then by field."""
    terms = [query, *more]
    entries = []
    for f in fields:
        direct = F.regexp_like(F.col(f), F.lit(_pattern(query))) if query else F.lit(False)
        entries.append(F.struct((~F.coalesce(direct, F.lit(False))).alias("expanded"), F.lit(f).alias("field"), snippet(F.col(f), terms).alias("snippet")))
    found = F.filter(F.array(*entries), lambda x: x["snippet"].isNotNull())
    exploded = rows.select(key, F.explode(found).alias("x")).groupBy(key).agg(F.collect_set("x").alias("xs"))
    return exploded.select(key, F.slice(F.transform(F.array_sort("xs"), lambda x: F.struct(x["field"].alias("field"), x["snippet"].alias("snippet"))), 1, SNIPPETS).alias("snippets"))


def any_field(rows: DataFrame, fields: tuple[str, ...], terms: list[str]) -> DataFrame:
    """Rows in which some field holds some term."""
    tests = [F.coalesce(F.regexp_like(F.col(f), F.lit(_pattern(t))), F.lit(False)) for f in fields for t in terms]
    return rows.where(reduce(lambda a, b: a | b, tests, F.lit(False)))
