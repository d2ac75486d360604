"""Column helpers for text: Unicode white space, placeholders, CJK repair and term matching.

A null is never a match, and every helper keeps nulls unless it says otherwise.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# What stands for "no value" in a field.
PLACEHOLDERS = ("", "-", "--", "na", "n/a", "none", "null")
DASHES = "—–－"
#: The characters that (?U)\s matches.
WHITE_SPACE = "\t\n\v\f\r \u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
CJK = r"㐀-鿿"
#: The printable ASCII characters that (?U)\w doesn't match, but the blank.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^`{|}~"
ASCII_TERM = r"^[a-z0-9 ._/-]+$"
PHRASE = r"[a-z0-9][a-z0-9._/-]*(?: [a-z0-9][a-z0-9._/-]*){0,5}"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once: Spark repeats shared expressions inside lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(c: Column) -> Column:
    """Trim Unicode white space."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def squash(c: Column) -> Column:
    """Runs of white space become one blank; outer ones go."""
    # Printable ASCII with single blanks only is squashed already; the test is cheaper than the replacement.
    return F.trim(F.when(c.rlike(r"[^\x20-\x7e]|  "), F.regexp_replace(c, r"(?U)\s+", " ")).otherwise(c))


def normalize_placeholder(c: Column) -> Column:
    """Lower case, dashes folded, no white space; null becomes ''."""
    return F.translate(F.lower(F.coalesce(c, F.lit(""))), DASHES + WHITE_SPACE, "---")


def is_meaningful(c: Column) -> Column:
    """True unless null or a placeholder."""
    return ~normalize_placeholder(c).isin(*PLACEHOLDERS)


def nullable(c: Column) -> Column:
    """Placeholders become null."""
    return F.when(is_meaningful(c), strip(c))


def has_owner(c: Column) -> Column:
    """Like is_meaningful, without folding of dashes or inner white space."""
    return ~F.lower(strip(F.coalesce(c, F.lit("")))).isin(*PLACEHOLDERS)


def repair_cjk(c: Column) -> Column:
    """Blanks between CJK characters go."""
    return F.regexp_replace(c, rf"(?U)(?<=[{CJK}])\s+(?=[{CJK}])", "")


def contains_any(c: Column, terms: tuple[str, ...]) -> Column:
    """Case-insensitive substring test for any term; null is false."""
    return contains_lower(F.lower(F.coalesce(c, F.lit(""))), terms)


def contains_lower(low: Column, terms: tuple[str, ...]) -> Column:
    """contains_any of a text that is in lower case and not null."""
    return reduce(lambda a, b: a | b, (low.contains(t.lower()) for t in terms), F.lit(False))


def query_phrases(query: str) -> list[str]:
    """ASCII phrases of a query, longest first, without the query itself."""
    low = (query or "").strip().lower()
    found = {m.strip() for m in re.findall(PHRASE, low)}
    return sorted((p for p in found if len(p) >= 2 and p != low), key=lambda p: (-len(p), p))


def term_matches(c: Column, term: str) -> Column:
    """An ASCII term needs no letter or digit on either side; any other term is a plain substring."""
    low = F.lower(c)
    if re.fullmatch(ASCII_TERM[1:-1], term):
        return low.rlike(rf"(?<![a-z0-9]){re.escape(term)}(?![a-z0-9])")
    return low.contains(term)


def matches_query(c: Column, query: str) -> Column:
    """The whole query matches, or else any of its ASCII phrases; a blank query and a null never match."""
    low = (query or "").strip().lower()
    if not low:
        return F.lit(False)
    found = reduce(lambda a, b: a | b, (term_matches(c, t) for t in [low, *query_phrases(low)]))
    return F.coalesce(found, F.lit(False))


def any_matches(array: Column, query: str) -> Column:
    """Some element matches the query."""
    return F.coalesce(F.exists(array, lambda x: matches_query(x, query)), F.lit(False))


def first_integer(c: Column, otherwise: int = 9999) -> Column:
    """The first run of digits as a number, for natural sorting."""
    return F.coalesce(F.nullif(F.regexp_extract(c, r"\d+", 0), F.lit("")).try_cast("int"), F.lit(otherwise))


def short_identifier(c: Column) -> Column:
    """The last 8 characters of identifiers longer than 10."""
    return F.when(F.length(c) > 10, F.substring(c, -8, 8)).otherwise(c)


def truncate(c: Column, limit: int) -> Column:
    """At most limit - 1 characters and an ellipsis."""
    clean = squash(c)
    return F.when(F.length(clean) <= limit, clean).otherwise(F.concat(F.substring(clean, 1, limit - 1), F.lit("...")))


def normalize_signature(c: Column) -> Column:
    """Lower case, single blanks, word characters only."""
    low = F.lower(strip(c))
    general = F.regexp_replace(F.regexp_replace(low, r"(?U)\s+", " "), rf"(?U)[^\w{CJK} ]+", "")
    # Of printable ASCII with single blanks, only punctuation goes.
    return F.when(low.rlike(r"[^\x20-\x7e]|  "), general).otherwise(F.translate(low, PUNCTUATION, ""))


def normalize_match(c: Column) -> Column:
    """Upper case without white space."""
    return F.upper(F.regexp_replace(c, r"(?U)\s+", ""))


def tokens(c: Column) -> Column:
    """Lower-case distinct ASCII tokens and CJK runs."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"[A-Za-z0-9][A-Za-z0-9._/-]*|[一-鿿]{2,}"), F.lit(0)), F.lower))


def normalize_feedback_query(c: Column) -> Column:
    return F.lower(squash(F.coalesce(c, F.lit(""))))


def similar_queries(left: Column, right: Column) -> Column:
    """Equal, one inside the other, or token overlap of at least half the longer one."""
    a, b = normalize_feedback_query(left), normalize_feedback_query(right)
    ta, tb = (F.array_distinct(F.split(x, " ")) for x in (a, b))
    overlap = F.size(F.array_intersect(ta, tb)) / F.greatest(F.size(ta), F.size(tb))
    return (a != "") & (b != "") & ((a == b) | a.contains(b) | b.contains(a) | (overlap >= 0.5))


def slug(c: Column, size: int = 48) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "_"), r"^_+|_+$", ""), 1, size)


def case_id(question: Column, index: Column) -> Column:
    """seed_NNN_slug of a question."""
    return F.concat(F.format_string("seed_%03d_", index), F.coalesce(F.nullif(slug(question), F.lit("")), F.lit("question")))


def uuid5_url(name: Column) -> Column:
    """The version-5 UUID of a name in the URL namespace."""
    digest = F.sha1(F.concat(F.unhex(F.lit("6ba7b8119dad11d180b400c04fd430c8")), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12))
