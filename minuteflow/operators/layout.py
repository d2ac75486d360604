"""Rows of a form's table from the word boxes of its pages, as one ordered fold over each document's pages.

A page's header words end its header; numbers in the first column below it, each one more than the
last (over pages too), anchor its rows; a row reaches half way to its neighbours. All of it is
column expressions over a payload's own arrays: no shuffle, and no document is a group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from minuteflow.functions.text import let, repair_cjk, squash, strip
from minuteflow.functions.text import is_meaningful as meaningful

# Words of the table's header, distances in points, and where each column of the table begins.
FULL_WIDTH = "０１２３４５６７８９"
HEADER_WORDS = ("項次", "負責人", "預計", "日期", "實際", "完成日", "追蹤", "結果")
NUMBER = "^[0-9０-９]{1,2}[.]?$"
NUMBERS_END, HEADER_GAP, FOOT, ANCHOR_GAP, LINE_TOLERANCE = 85.0, 6.0, 12.0, 22.0, 3.0
BANDS = (80.0, 375.0, 430.0, 475.0, 525.0)
CELLS = ("content", "owner", "planned_date", "actual_completed_date", "tracking_result")

_PLACED = "array<struct<line:int,x0:double,at:int,text:string>>"
_ANCHORS = "array<struct<number:int,y0:double>>"
_ROW = "struct<page_number:int,number:int,cells:array<string>,raw_row_text:string>"


def digits(c: Column) -> Column:
    return F.translate(c, FULL_WIDTH, "0123456789")


def header_bottom(words: Column) -> Column:
    """Where a page's header ends, or null if it has none."""
    bare = lambda w: digits(F.regexp_replace(w["text"], r"(?U)\s+", ""))
    return F.array_max(F.transform(F.filter(words, lambda w: bare(w).isin(*HEADER_WORDS)), lambda w: w["y1"])) + HEADER_GAP


def anchors(words: Column, bottom: Column, expected: Column) -> Column:
    """(number, y0) of a page's rows from the top: the first number, or the expected one, and each that is one more.

    A number less than ANCHOR_GAP below the row before it is none. Equal heights keep the words' order.
    """
    numbered = F.transform(words, lambda w, i: F.struct(w["y0"].alias("y0"), i.alias("at"), w["x0"].alias("x0"), w["text"].alias("text")))
    found = F.sort_array(F.filter(numbered, lambda w: (w["x0"] <= NUMBERS_END) & (w["y0"] > bottom) & w["text"].rlike(NUMBER)))

    def step(state: Column, w: Column) -> Column:
        number = F.rtrim(digits(w["text"]), F.lit(".")).cast("int")
        wanted = F.coalesce(state["next"] == number, F.lit(True))
        far = F.coalesce(w["y0"] - F.try_element_at(state["rows"], F.lit(-1))["y0"] >= ANCHOR_GAP, F.lit(True))
        more = F.concat(state["rows"], F.array(F.struct(number.alias("number"), w["y0"].alias("y0"))))
        return F.when(wanted & far, F.struct(more.alias("rows"), (number + 1).alias("next"))).otherwise(state)

    start = F.struct(F.array().cast(_ANCHORS).alias("rows"), expected.alias("next"))
    return F.aggregate(found, start, step, lambda s: s["rows"])


def joined(words: Column) -> Column:
    """The words' text line by line: a line is all words at most LINE_TOLERANCE below its first; null if there is none."""
    ordered = F.sort_array(F.transform(words, lambda w, i: F.struct(F.bround(w["y0"], 1).alias("y"), w["x0"].alias("x0"), i.alias("at"), w["text"].alias("text"))))

    def step(state: Column, w: Column) -> Column:
        same = F.coalesce(F.abs(w["y"] - state["y"]) <= LINE_TOLERANCE, F.lit(False))
        line = F.when(same, state["line"]).otherwise(state["line"] + 1)
        placed = F.array(F.struct(line.alias("line"), w["x0"].alias("x0"), F.size(state["placed"]).alias("at"), w["text"].alias("text")))
        return F.struct(F.concat(state["placed"], placed).alias("placed"), line.alias("line"), F.when(same, state["y"]).otherwise(w["y"]).alias("y"))

    start = F.struct(F.array().cast(_PLACED).alias("placed"), F.lit(0).alias("line"), F.lit(None).cast("double").alias("y"))
    text = F.aggregate(ordered, start, step, lambda s: F.array_join(F.transform(F.sort_array(s["placed"]), lambda p: p["text"]), " "))
    # squash() names its text three times and nullif() twice, and inside a lambda each name is a computation.
    return let(text, lambda whole: let(repair_cjk(squash(whole)), lambda t: F.when(t != "", t)))


def page_rows(page: Column, expected: Column) -> Column:
    """The rows of one page that hold anything, as an array of _ROW; empty without a header or anchors."""

    def cell(words: Column, k: int) -> Column:
        inside = F.filter(words, lambda w: (w["x0"] >= BANDS[k]) & (w["x0"] < (BANDS[k + 1] if k + 1 < len(BANDS) else float("inf"))))
        return joined(inside)

    def of(words: Column, bottom: Column, tops: Column) -> Column:
        def row(anchor: Column, k: Column) -> Column:
            half = lambda other: (F.get(tops, other)["y0"] + anchor["y0"]) / 2
            low = F.when(k > 0, half(k - 1)).otherwise(bottom)
            high = F.when(k + 1 < F.size(tops), half(k + 1)).otherwise(page["height"] - FOOT)
            inside = let(F.struct(low.alias("low"), high.alias("high")), lambda span: F.filter(words, lambda w: (w["y0"] >= span["low"]) & (w["y0"] < span["high"])))
            return let(inside, lambda ws: F.struct(page["page_number"].alias("page_number"), anchor["number"].alias("number"), F.array(*[cell(ws, i) for i in range(len(CELLS))]).alias("cells"), joined(ws).alias("raw_row_text")))

        return F.filter(F.transform(tops, row), lambda r: filled([F.get(r["cells"], F.lit(i)) for i in range(len(CELLS))]))

    def below(words: Column) -> Column:
        return let(header_bottom(words), lambda b: F.when(b.isNotNull(), let(anchors(words, b, expected), lambda tops: of(words, b, tops))))

    # Words are trimmed here, once; all that reads them below takes trimmed words.
    trimmed = F.transform(page["words"], lambda w: F.struct(w["x0"].alias("x0"), w["y0"].alias("y0"), w["y1"].alias("y1"), strip(w["text"]).alias("text")))
    shown = F.filter(trimmed, lambda w: w["text"] != "")
    return F.coalesce(let(shown, below), F.array().cast(f"array<{_ROW}>"))


def filled(cells: list[Column]) -> Column:
    """Whether a row says anything: its content, or another cell that is no placeholder."""
    return reduce(lambda a, c: a | F.coalesce(meaningful(c), F.lit(False)), cells[1:], F.coalesce(strip(cells[0]) != "", F.lit(False)))


def document_rows(pages: Column) -> Column:
    """All rows of a document's pages, in their order, numbers carried from page to page."""

    def step(state: Column, page: Column) -> Column:
        def add(rows: Column) -> Column:
            return F.struct(F.concat(state["rows"], rows).alias("rows"), F.coalesce(F.try_element_at(rows, F.lit(-1))["number"] + 1, state["next"]).alias("next"))

        return let(page_rows(page, state["next"]), add)

    start = F.struct(F.array().cast(f"array<{_ROW}>").alias("rows"), F.lit(None).cast("int").alias("next"))
    return F.aggregate(F.coalesce(pages, F.array()), start, step, lambda s: s["rows"])
