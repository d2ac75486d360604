"""Main-text extraction from HTML by line-block distribution.

Markup is stripped into lines, one for each block element, in page order. A line counts the
characters of its text outside links (a heading all of them); menus, headers, footers, sidebars,
notices, adverts, forms, hidden parts and reader comments, and on pages that mark an article or
main element all that stands outside it, are one empty line each, however many blocks they hold.
The lengths are summed over sliding windows of WINDOW lines. A window whose sum is 0 is a dive:
its lines are a list of links. What stands between two dives is a stretch; it is text if one of
its windows surges, that is, sums to SURGE or more, and so is a dive between two surging stretches
that is no longer than both. On a page without any surge all stretches are text, so short pages keep
theirs, and a page without any stretch keeps its lines. A page that marks its article or main element
has its stretch marked: all of it is text, its own lists of links and short last lines included.

Parsing is linear in the page's length. Defined cases: null and empty pages, and pages without
text, give an empty text; broken and unclosed markup is read as far as it goes; an inline element
never parts its block; repeated rows give repeated results; extra columns don't matter, but text
and n_chars are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import defaultdict
from html import unescape
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Element names by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
BOILERPLATE = frozenset("nav header footer aside form button select dialog menu noscript template svg math canvas object audio video head fieldset datalist".split())
SIBLINGS = frozenset("li dt dd tr td th option".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_MARKED = re.compile(
    r"(?:ad|ads|adbox|adsense|advert\w*|sponsor\w*|promo\w*|banner\w*|nav\w*|menu\w*|breadcrumb\w*|sidebar\w*|aside|footer\w*|header\w*|masthead|cookie\w*|consent\w*|gdpr|notice\w*|alert\w*"
    r"|popup\w*|modal\w*|overlay|newsletter\w*|subscri\w*|social\w*|share\w*|sharing|related\w*|recommend\w*|comment\w*|disqus\w*|repl(?:y|ies)|respond|widget\w*|toolbar|pagination|pager|login|signin|signup|search\w*|skip\w*|copyright)"
    r"(?:[-_]\w+)*",
    re.I,
)
_COMMENTS = re.compile(r"(?:comment\w*|repl(?:y|ies)|disqus\w*)(?:[-_]\w+)*", re.I)
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_NAME = re.compile(r"(/?)([A-Za-z][^\s/>]*)")
_REST = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_CLOSERS = {name: re.compile(f"</{name}", re.I) for name in RAW}


_NO_WORD = re.compile(r"\W+")

#: Lines in a window, and the characters outside links from which a window surges.
WINDOW, SURGE = 3, 80


def _attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(source)} if source.strip(" /") else {}


def _excluded(name: str, attributes: dict[str, str]) -> bool:
    if name in BOILERPLATE:
        return True
    if not attributes:
        return False
    if "hidden" in attributes or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attributes.get("style", ""), re.I):
        return True
    if attributes.get("role", "").lower() in _ROLES:
        return True
    marks = f"{attributes.get('class', '')} {attributes.get('id', '')}".split()
    rule = _COMMENTS if name in ("article", "main", "body", "html") else _MARKED
    return any(rule.fullmatch(mark) for mark in marks)


def _main(name: str, attributes: dict[str, str]) -> bool:
    return name in ("article", "main") or attributes.get("role", "").lower() in ("main", "article") or attributes.get("itemprop") == "articleBody"


def lines_of(html: str) -> list[tuple[str, int, bool]]:
    """(text, length, inside the marked main element) for each block, in page order; an excluded part is ("", 0, ...)."""
    lines: list[tuple[str, int, bool]] = []
    #: Pieces of the block's text, and those of them that stand outside links.
    parts: list[str] = []
    plain: list[str] = []
    #: Open elements: name, excluded, main, a header inside the main element, the place of the nearest block.
    stack: list[tuple[str, bool, bool, bool, int]] = []
    #: Where each element is open in the stack.
    places: defaultdict[str, list[int]] = defaultdict(list)
    state = {"out": 0, "main": 0, "lead": 0, "heading": 0, "link": 0, "skipped": 0}

    def add(text: str) -> None:
        # A heading in the article's own header belongs to the article.
        if state["out"] > 0 and not (state["heading"] and state["out"] == state["lead"]):
            state["skipped"] = 1
            return
        parts.append(text)
        if not state["link"] or state["heading"]:
            plain.append(text)

    def flush() -> None:
        text = " ".join(unescape("".join(parts)).split()) if parts else ""
        if text:
            length = len(text) if len(plain) == len(parts) else len(_NO_WORD.sub("", unescape("".join(plain))))
            lines.append((text, length, state["main"] > 0))
        elif state["skipped"]:
            lines.append(("", 0, state["main"] > 0))
        parts.clear()
        plain.clear()
        state["skipped"] = 0

    def push(name: str, attributes: dict[str, str]) -> None:
        plainly = not attributes and name not in BLOCK
        out, main = (name in BOILERPLATE, False) if plainly else (_excluded(name, attributes), _main(name, attributes))
        lead = out and name == "header" and state["main"] > 0
        stack.append((name, out, main, lead, len(stack) if name in BLOCK else stack[-1][4] if stack else -1))
        places[name].append(len(stack) - 1)
        state["out"] += out
        state["main"] += main
        state["lead"] += lead
        state["heading"] += name in HEADINGS

    def pop() -> str:
        name, out, main, lead, _ = stack.pop()
        places[name].pop()
        state["out"] -= out
        state["main"] -= main
        state["lead"] -= lead
        state["heading"] -= name in HEADINGS
        if len(stack) < state["link"] - 1:
            state["link"] = 0
        return name

    at, size = 0, len(html)
    while at < size:
        sign = html.find("<", at)
        if sign < 0:
            add(html[at:])
            break
        if sign > at:
            add(html[at:sign])
        if html.startswith("<!--", sign):
            end = html.find("-->", sign + 4)
            at = size if end < 0 else end + 3
            continue
        if html.startswith(("<!", "<?"), sign):
            end = html.find(">", sign)
            at = size if end < 0 else end + 1
            continue
        tag = _NAME.match(html, sign + 1)
        if not tag:
            add("<")
            at = sign + 1
            continue
        rest = _REST.match(html, tag.end())
        end = rest.end() if rest else html.find(">", tag.end()) + 1 or size
        name, closing = tag[2].lower(), bool(tag[1])
        at = end
        if name in BLOCK:
            flush()
        if closing:
            if name == "a":
                state["link"] = 0
            # An inline element ends within its block only.
            if places[name] and (name in BLOCK or places[name][-1] > stack[-1][4]):
                while pop() != name:
                    pass
            continue
        if name in RAW:
            close = _CLOSERS[name].search(html, end)
            at = size if not close else html.find(">", close.end()) + 1 or size
            continue
        if name == "br":
            add(" ")
        if name in VOID:
            continue
        source = html[tag.end() : end - 1]
        if source.endswith("/") and name not in BLOCK:
            continue
        if name == "a":
            state["link"] = len(stack) + 1
        attributes = _attributes(source)
        block = stack[-1][4] if stack else -1
        if name in BLOCK and block >= 0 and (stack[block][0] == "p" or (name in SIBLINGS and stack[block][0] == name)):
            while len(stack) > block:
                pop()
        push(name, attributes)
    flush()
    return lines


def block_lines(html: str | None) -> tuple[list[tuple[str, int]], bool]:
    """(text, length) of each line, and whether the page marks its main element; what is excluded or outside that is one empty line for each unbroken stretch."""
    lines = lines_of(html or "")
    marked = any(inside and text for text, _, inside in lines)
    out: list[tuple[str, int]] = []
    for text, length, inside in lines:
        if text and (inside or not marked):
            out.append((text, length))
        elif not out or out[-1][0]:
            out.append(("", 0))
    return out, marked


def located(lengths: list[int], sizes: list[int] | None = None, window: int = WINDOW, surge: int = SURGE) -> list[bool]:
    """For each line, whether it lies in a stretch that surges between two dives, or in a dive that two of these outweigh.

    lengths count characters outside links, sizes all; without sizes no dive is kept.
    """
    n = len(lengths)
    width = min(window, n)
    running = [0, *accumulate(lengths)]
    sums = [running[k + width] - running[k] for k in range(n - width + 1)] if n else []
    dived, reach = [False] * n, 0
    for k, value in enumerate(sums):
        if value == 0:
            for j in range(max(k, reach), k + width):
                dived[j] = True
            reach = k + width
    stretches, start = [], 0
    for k in range(n + 1):
        if k == n or dived[k]:
            if k > start:
                stretches.append((start, k))
            start = k + 1
    surges = [max(sums[max(0, a - width + 1) : b], default=0) >= surge for a, b in stretches]
    keep, any_surges = [not stretches] * n, any(surges)
    for (a, b), good in zip(stretches, surges):
        if good or not any_surges:
            keep[a:b] = [True] * (b - a)
    for (a, b), (c, d), left, right in zip(stretches, stretches[1:], surges, surges[1:]):
        if sizes and left and right and sum(sizes[b:c]) <= sum(sizes[a:b]) + sum(sizes[c:d]):
            keep[b:c] = [True] * (c - b)
    return keep


def main_text(html: str | None) -> str:
    """The lines of the text, joined by newlines."""
    lines, marked = block_lines(html)
    keep = [True] * len(lines) if marked else located([length for _, length in lines], [len(text) for text, _ in lines])
    return "\n".join(text for (text, _), good in zip(lines, keep) if good and text)


@F.pandas_udf(T.StringType())
def main_text_udf(pages: pd.Series) -> pd.Series:
    return pages.map(main_text)


def extract(pages: DataFrame) -> DataFrame:
    """pages (html) with text and n_chars."""
    return pages.withColumn("text", main_text_udf(F.coalesce("html", F.lit("")))).withColumn("n_chars", F.length("text").cast("bigint"))


def op1_html_main_text(spark, sf_dir: str) -> DataFrame:
    """The contract's columns for every page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", "n_chars")
