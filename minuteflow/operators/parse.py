"""Page payloads to meeting and item rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from minuteflow.functions.status import with_status
from minuteflow.functions.text import is_meaningful, nullable, repair_cjk, squash, strip
from minuteflow.operators import layout
from minuteflow.operators.layout import CELLS

# Labels of the form, its title and the columns of its table.
TITLE = "會議記錄單"
LABELS = {
    "form_no": r"(Q-[A-Z0-9\/-]+)",
    "ref_no": r"Ref\s*:\s*([A-Z0-9-]+)",
    "location": r"地\s*點\s*:\s*(.+?)\s*主\s*席\s*:",
    "chairperson": r"主\s*席\s*:\s*(.+?)\s*記\s*錄\s*:",
    "recorder": r"記\s*錄\s*:\s*(.+?)\s*會\s*議\s*名\s*稱\s*:",
    "meeting_name": r"會\s*議\s*名\s*稱\s*:\s*(.+?)\s*權\s*責\s*單\s*位\s*:",
    "responsible_unit": r"權\s*責\s*單\s*位\s*:\s*(.+?)\s*出\s*席\s*人\s*員\s*:",
}
ATTENDEES = r"(?s)出\s*席\s*人\s*員\s*:\s*(.+?)\s*項\s*次"
DATE = r"時\s*間\s*:\s*(\d{4})\s*年\s*(\d{1,2})\s*月\s*(\d{1,2})\s*日"
TIMES = r"(\d{1,2})\s*時\s*(\d{1,2})\s*分\s*~\s*(\d{1,2})\s*時\s*(\d{1,2})\s*分"


def folded(c: Column) -> Column:
    return F.translate(c, layout.FULL_WIDTH + "：", "0123456789:")


def needs_ocr() -> Column:
    """Too few words or characters, or no form title."""
    dense = F.regexp_replace(folded(F.coalesce("raw_text", F.lit(""))), r"(?U)\s+", "")
    return (F.coalesce("word_count", F.lit(0)) < 40) | (F.length(dense) < 80) | ~dense.contains(TITLE)


def normalized_date(value: Column, meeting_date: Column) -> Column:
    """A date with year, or month and day with the meeting's year, wherever they stand; any other text stays, placeholders are null."""

    def of(text: Column) -> Column:
        def iso(pattern: str, year: Column | None = None) -> Column:
            groups = [F.regexp_extract(text, pattern, g) for g in ((1, 2) if year is not None else (1, 2, 3))]
            y, m, d = (year, *groups) if year is not None else groups
            return F.when((m != "") & (y != ""), F.concat_ws("-", F.lpad(y, 4, "0"), F.lpad(m, 2, "0"), F.lpad(d, 2, "0")))

        year = F.substring(F.coalesce(meeting_date, F.lit("")), 1, 4)
        found = F.coalesce(iso(r"(\d{4})\s*[/.-]\s*(\d{1,2})\s*[/.-]\s*(\d{1,2})"), iso(r"(\d{4})\s*年\s*(\d{1,2})\s*月\s*(\d{1,2})\s*日"), iso(r"(\d{1,2})\s*[/.-]\s*(\d{1,2})", year), text)
        return F.when(is_meaningful(text), found)

    return layout.let(repair_cjk(squash(value)), of)


def attendees(text: Column) -> Column:
    """Split at commas and lines; two CJK tokens of two characters or more are two names, shorter ones are one."""

    def names(segment: Column) -> Column:
        parts = F.split(squash(segment), " ")
        cjk = (F.size(parts) == 2) & F.forall(parts, lambda p: p.rlike("^[㐀-鿿]+$"))
        return F.when(cjk & F.forall(parts, lambda p: F.length(p) >= 2), parts).when(cjk, F.array(F.array_join(parts, ""))).otherwise(F.array(squash(segment)))

    return F.array_distinct(F.filter(F.flatten(F.transform(F.split(F.coalesce(text, F.lit("")), r"[,，、;；\n]"), names)), lambda n: n != ""))


def meetings(payloads: DataFrame, company: str | None = None) -> DataFrame:
    """A meeting row for each payload; a missing label gives null. company is a pattern of the name that heads the form."""
    raw = folded(F.coalesce("raw_text", F.lit("")))

    def label(pattern: str) -> Column:
        return F.nullif(repair_cjk(squash(F.regexp_extract(raw, f"(?s){pattern}", 1))), F.lit(""))

    y, m, d = (F.regexp_extract(raw, DATE, g) for g in (1, 2, 3))
    t = [F.regexp_extract(raw, TIMES, g) for g in (1, 2, 3, 4)]
    time = lambda a, b: F.when(t[0] != "", F.concat_ws(":", F.lpad(a, 2, "0"), F.lpad(b, 2, "0")))
    return payloads.select(
        F.concat(F.lit("meeting_"), F.substring(F.sha1(F.encode("document_id", "UTF-8")), 1, 12)).alias("meeting_id"),
        "document_id",
        (label(f"({company})") if company else F.lit(None).cast("string")).alias("company_name"),
        F.when(F.regexp_replace(raw, r"(?U)\s+", "").contains(TITLE), F.lit(TITLE)).alias("form_title"),
        *[label(p).alias(name) for name, p in LABELS.items()],
        F.when(y != "", F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))).alias("meeting_date"),
        time(t[0], t[1]).alias("start_time"),
        time(t[2], t[3]).alias("end_time"),
        attendees(F.regexp_extract(raw, ATTENDEES, 1)).alias("attendees"),
        "page_count",
        F.when(needs_ocr(), "needs_ocr").otherwise("parsed").alias("status"),
    )


def table_items(payloads: DataFrame, parsed: DataFrame) -> DataFrame:
    """Items from table rows whose first cell is a number and whose other cells say anything."""
    pages = payloads.select("document_id", F.explode("pages").alias("p"))
    rows = pages.select("document_id", F.col("p.page_number").alias("page_number"), F.explode("p.tables").alias("t")).select("document_id", "page_number", F.explode("t.rows").alias("cells"))
    cell = lambda k: F.get("cells", F.lit(k))
    # A number that lpad must not cut has more than two digits.
    number = F.regexp_replace(F.regexp_extract(folded(strip(F.coalesce(cell(0), F.lit("")))), r"^(\d+)\.*$", 1), "^0+(?=.)", "")
    raw = squash(F.array_join(F.transform("cells", lambda c: F.coalesce(c, F.lit(""))), " "))
    item_no = F.when(F.length(number) < 2, F.lpad(number, 2, "0")).otherwise(number)
    said = layout.filled([cell(k + 1) for k in range(len(CELLS))])
    return _items(rows.where((number != "") & said).select("document_id", "page_number", item_no.alias("item_no"), *[cell(k + 1).alias(c) for k, c in enumerate(CELLS)], repair_cjk(raw).alias("raw_row_text"), F.lit("tables").alias("source")), parsed)


def _items(rows: DataFrame, parsed: DataFrame) -> DataFrame:
    joined = rows.join(parsed.select("document_id", "meeting_id", "meeting_date"), "document_id")
    clean = {c: nullable(repair_cjk(squash(F.col(c)))) for c in ("owner", "tracking_result")} | {"content": F.nullif(repair_cjk(squash(F.col("content"))), F.lit(""))}
    dates = {c: normalized_date(folded(F.col(c)), F.col("meeting_date")) for c in ("planned_date", "actual_completed_date")}
    keyed = joined.withColumns(clean | dates)
    digest = F.substring(F.sha1(F.encode(F.concat_ws("|", "document_id", F.col("page_number").cast("string"), "item_no", "raw_row_text"), "UTF-8")), 1, 12)
    return with_status(keyed.withColumn("item_id", F.concat(F.lit("item_"), digest))).drop("meeting_date")


def word_items(payloads: DataFrame, parsed: DataFrame) -> DataFrame:
    """Items from word boxes (layout), each payload by itself."""
    # The outer form keeps Spark from inferring a filter on the array and so folding each document again.
    rows = payloads.select("document_id", F.explode_outer(layout.document_rows(F.col("pages"))).alias("r")).where("r is not null")
    cells = [F.get("r.cells", F.lit(k)).alias(c) for k, c in enumerate(CELLS)]
    return _items(rows.select("document_id", "r.page_number", F.lpad(F.col("r.number").cast("string"), 2, "0").alias("item_no"), *cells, "r.raw_row_text", F.lit("words").alias("source")), parsed)


def items(payloads: DataFrame, parsed: DataFrame) -> DataFrame:
    """Table rows where a document has any, else word boxes."""
    tabled = table_items(payloads, parsed)
    rest = payloads.join(tabled.select("document_id").distinct(), "document_id", "left_anti")
    return tabled.unionByName(word_items(rest, parsed))


def replace_document(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Stored rows of other documents, and the new rows."""
    return stored.join(new.select("document_id").distinct(), "document_id", "left_anti").unionByName(new, allowMissingColumns=True)
