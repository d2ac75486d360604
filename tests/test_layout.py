"""The layout of word boxes against a naive reading of the same pages."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from minuteflow.operators import layout, parse
from minuteflow.schemas import PAGES

HEADER = [(40.0, 60.0, 60.0, 70.0, "項次"), (380.0, 61.0, 400.0, 72.0, "負 責 人"), (90.0, 60.0, 100.0, 300.0, "no header")]


def page(number, words, height=800.0):
    return {"page_number": number, "text": "", "words": [dict(zip(("x0", "y0", "x1", "y1", "text"), w)) for w in words], "tables": [], "width": 600.0, "height": height}


def payload(document_id, pages):
    return {"document_id": document_id, "page_count": len(pages or []), "word_count": 1, "raw_text": "時間: 2018年4月3日", "pages": pages}


def number_at(x, y, text):
    return (float(x), float(y), float(x) + 5, float(y) + 8, text)


def lines_of(words):
    """Words by height then place; a word more than 3 below the first of a line begins another."""
    lines = []
    for w in sorted(words, key=lambda w: (round(w[1], 1), w[0])):
        if lines and abs(round(w[1], 1) - round(lines[-1][0][1], 1)) <= 3:
            lines[-1].append(w)
        else:
            lines.append([w])
    return " ".join(" ".join(w[4].strip() for w in sorted(line, key=lambda w: w[0])) for line in lines)


def read(pages):
    """(page, number, cells) by plain loops."""
    rows, wanted = [], None
    for number, words, height in pages:
        words = [w for w in words if w[4].strip()]
        ends = [w[3] for w in words if w[4].replace(" ", "") in layout.HEADER_WORDS]
        if not ends:
            continue
        top, found, following = max(ends) + 6, [], wanted
        for w in sorted((w for w in words if w[0] <= 85 and w[1] > max(ends) + 6), key=lambda w: w[1]):
            text = w[4].strip()
            if not (text.rstrip(".").isdigit() and len(text.rstrip(".")) <= 2 and text.count(".") <= 1):
                continue
            n = int(text.rstrip("."))
            if (following is None or n == following) and (not found or w[1] - found[-1][1] >= 22):
                found.append((n, w[1]))
                following = n + 1
        heights = [y for _, y in found]
        edges = [top, *[(a + b) / 2 for a, b in zip(heights, heights[1:])], height - 12]
        bands = [80, 375, 430, 475, 525, 10**9]
        for k, (n, _) in enumerate(found):
            inside = [w for w in words if edges[k] <= w[1] < edges[k + 1]]
            cells = [lines_of([w for w in inside if a <= w[0] < b]) or None for a, b in zip(bands, bands[1:])]
            if cells[0] or any(c not in (None, "-", "--") for c in cells[1:]):
                rows.append((number, n, cells))
                wanted = n + 1
    return rows


def of_spark(spark, payloads):
    frame = spark.createDataFrame(payloads, PAGES)
    rows = frame.select("document_id", F.posexplode(layout.document_rows(F.col("pages"))).alias("at", "r")).orderBy("document_id", "at").collect()
    out = {p["document_id"]: [] for p in payloads}
    for r in rows:
        out[r["document_id"]].append((r["r"]["page_number"], r["r"]["number"], list(r["r"]["cells"])))
    return out


def test_random_pages_equal_naive_reading(spark):
    draw, documents = random.Random(3), {}
    for d in range(150):
        pages, n = [], draw.choice([1, 1, 4, 97])
        for p in range(draw.randint(1, 4)):
            words, y = (HEADER[:2] if draw.random() < 0.8 else []), draw.uniform(70, 110)
            words = list(words)
            for _ in range(draw.randint(0, 5)):
                words.append(number_at(draw.choice([40, 85, 86]), y, draw.choice([f"{n}", f"{n}.", f" {n:02d} ", f"{n + 1}", "x", "123"])))
                n += draw.random() < 0.9
                for _ in range(draw.randint(0, 7)):
                    words.append(number_at(draw.choice([60, 79.9, 80, 100, 200, 374.9, 375, 430, 475, 525, 560]), y + draw.choice([-4, -1, 0, 0.04, 2.96, 3, 3.1, 11, 18]), draw.choice(["a", "bc", "--", " ", "7", "ß"])))
                y += draw.choice([10, 21.9, 22, 30, 45])
            draw.shuffle(words)
            pages.append((p + 1, words, draw.choice([800.0, 800.0, 150.0])))
        documents[f"d{d:03d}"] = pages
    got = of_spark(spark, [payload(d, [page(*p) for p in pages]) for d, pages in documents.items()])
    expected = {d: read(pages) for d, pages in documents.items()}
    assert sum(map(len, expected.values())) > 60
    assert got == expected


def test_numbers_carry_over_pages_and_start_anywhere(spark):
    first = [*HEADER[:2], number_at(40, 100, "７."), number_at(90, 100, "seven"), number_at(40, 130, "9"), number_at(90, 125, "more"), number_at(40, 160, "8"), number_at(90, 160, "eight")]
    bare = [number_at(40, 100, "9"), number_at(90, 100, "no header here")]
    second = [*HEADER[:2], number_at(40, 100, "1"), number_at(40, 130, "9"), number_at(90, 130, "nine")]
    got = of_spark(spark, [payload("d", [page(1, first), page(2, bare), page(3, second)])])["d"]
    assert [(p, n, c[0]) for p, n, c in got] == [(1, 7, "seven more"), (1, 8, "eight"), (3, 9, "nine")]


@pytest.mark.parametrize("pages", [None, [], [page(1, [])], [{**page(1, []), "words": None}], [page(1, HEADER)]])
def test_pages_without_rows(spark, pages):
    assert of_spark(spark, [payload("d", pages)])["d"] == []


def test_placeholders_are_no_items(spark):
    words = [*HEADER[:2], number_at(40, 100, "1"), number_at(380, 100, "--"), number_at(40, 140, "2"), number_at(90, 140, "--"), number_at(40, 180, "3"), number_at(480, 180, "due 4/20")]
    frame = spark.createDataFrame([payload("d", [page(1, words)])], PAGES)
    rows = [(r["item_no"], r["content"], r["actual_completed_date"]) for r in parse.items(frame, parse.meetings(frame)).collect()]
    # A row that only holds placeholders is no item, but its number anchors the next one; content is kept as it stands.
    assert sorted(rows) == [("02", "--", None), ("03", None, "2018-04-20")]


def test_tables_keep_numbers_and_other_cells(spark):
    cells = [["１２.", "a\nb", "Ann", None, None, None, "extra"], ["007", "", "-", "", "", ""], ["x", "head"], ["3"], ["104", "long", None, None, None, None]]
    one = {**page(1, []), "tables": [{"bbox": [], "rows": cells}]}
    frame = spark.createDataFrame([payload("d", [one])], PAGES)
    rows = {r["item_no"]: (r["content"], r["owner"], r["raw_row_text"]) for r in parse.items(frame, parse.meetings(frame)).collect()}
    assert rows == {"12": ("a b", "Ann", "１２. a b Ann extra"), "104": ("long", None, "104 long")}


def test_no_shuffle_for_the_layout(spark):
    frame = spark.createDataFrame([payload("d", [page(1, HEADER)])], PAGES)
    plan = frame.select(layout.document_rows(F.col("pages")))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_each_text_is_joined_once(spark):
    """One fold over pages, one over anchors, and one for each of five cells and the raw text: none stands in the plan twice."""
    pages = spark.createDataFrame([payload("d", None)], PAGES).select(F.explode_outer(layout.document_rows(F.col("pages"))).alias("r"))
    assert pages._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") == 8
