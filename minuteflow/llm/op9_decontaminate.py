"""Benchmark decontamination by canonical templates, in DataFrame functions only.

Words become canonical tokens: numbers (in figures, with a sign or an attached unit, or spelled),
names (words with a capital and small letters but function words, wherever they stand) and units (after a number) turn
into typed placeholders, other words lose case and outer punctuation. Every 5-token window of the
whole text is hashed and joined to the windows of the benchmark items; a window of placeholders
alone stands for its words, so it matches only word for word. An item leaks into a document that
holds at least 0.8 of its windows, if the values that fill the placeholders are consistent: under
the alignment with most windows, one value of the item always meets one value of the document, so
a question with other numbers or names is still caught. Values are compared without case and outer
punctuation, at the first and last token of each window, which together are all tokens.

Items have a second set of windows with names left as words, which the words of a document in
capitals or small letters match. A window that repeats in an item is joined once, at its first
place, and counts at all of them, so repetitive texts give no pairs of all places. The benchmark's windows are broadcast
only if their counted number is at most BROADCAST_WINDOWS; beyond that the join shuffles.

Defined cases: a text of under five words is one window of its own, which only a whole text of the
same words matches; null and empty texts have no windows and neither leak nor are leaked; equal rows of an
item are one item; repeated rows of a doc_id count as one document; rows without doc_id are
one document for each different text; of alignments with equally many windows a consistent one
counts; extra columns don't matter; an empty table on either side gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from minuteflow.llm.op5_quality import STOP_WORDS, words_sql
from minuteflow.session import materialize

WINDOW = 5
CONTAINMENT = 0.8
#: At about 60 bytes a window, 30 MB.
BROADCAST_WINDOWS = 500_000

OUTER = ".,;:!?\"()[]'"
# Units of measurement that may follow a number.
UNITS = "kg g mg t lb oz km m cm mm mi ft in l ml s ms min h hr hrs hours hour minutes minute seconds second days day weeks week months month years year percent % usd eur gbp dollars euros cents miles meters metres feet inches liters litres grams pounds degrees".split()


NUMBER_WORDS = (
    "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety "
    "hundred thousand million billion dozen half"
).split()
_NUMBER = f"^[$\u20ac\u00a3\u00a5+-]?[0-9][0-9.,:/]*(?:{'|'.join(u for u in UNITS if u.isalpha())}|[%\u20ac\u00a3$])?$"
_SLOTS = "('<num>', '<name>', '<unit>')"


def _listed(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in dict.fromkeys(words))


def _canonical(names: bool) -> str:
    """SQL for word i's token, from the words _w and the bare words _n; names can be left as words."""
    quoted = OUTER.replace("'", "\\'")
    trimmed = f"trim(both '{quoted}' from _w[i])"
    return (
        f"case when ascii(_w[i]) between 97 and 122 then case when b in ({_listed(NUMBER_WORDS)}) then '<num>' when b in ({_listed(UNITS)}) and i > 0 and ascii(_w[i - 1]) between 48 and 57 then '<unit>' else b end "
        f"when b rlike '{_NUMBER}' then '<num>' "
        f"when b in ({_listed(NUMBER_WORDS)}) then '<num>' "
        f"when b in ({_listed([u for u in UNITS if not u.isalpha()])}) and i > 0 and ascii(_w[i - 1]) between 48 and 57 then '<unit>' "
        f"when {'true' if names else 'false'} and left({trimmed}, 1) <> left(b, 1) and {trimmed} rlike '[\\\\p{{Ll}}]' and b not in ({_listed(STOP_WORDS)}) then '<name>' else b end"
    )


def windows(rows: DataFrame, key: str, names: bool = True) -> DataFrame:
    """(key, pos, h, first, last): a row for each window; first and last are the bare words of its outer tokens if these are placeholders, else ''."""
    quoted = OUTER.replace("'", "\\'")
    alone = " and ".join(f"_t[i + {k}] in {_SLOTS}" for k in range(WINDOW))
    literal = "xxhash64('', " + ", ".join(f"_n[i + {k}]" for k in range(WINDOW)) + ")"
    arrays = (
        rows.select(key, F.expr(words_sql("coalesce(text, '')")).alias("_w"))
        .where("size(_w) > 0")
        .withColumn("_n", F.expr(f"transform(_w, x -> lower(trim(both '{quoted}' from x)))"))
        .withColumn("_t", F.expr(f"transform(_n, (b, i) -> {_canonical(names)})"))
        .withColumn("_a", F.expr("transform(_t, x -> xxhash64(x))"))
        .withColumn("_b", F.expr("zip_with(_a, slice(_a, 2, size(_a)), (x, y) -> xxhash64(x, y))"))
        .withColumn("_c", F.expr("zip_with(_b, slice(_b, 3, size(_b)), (x, y) -> xxhash64(x, y))"))
        .withColumn("_h", F.expr(f"slice(zip_with(_c, slice(_a, 5, size(_a)), (x, y) -> xxhash64(x, y)), 1, greatest(size(_a) - {WINDOW - 1}, 0))"))
        .withColumn("_v", F.expr(f"zip_with(_t, _n, (t, b) -> case when t in {_SLOTS} then b else '' end)"))
        .select(
            key,
            F.expr(
                f"case when size(_w) < {WINDOW} then array(struct(xxhash64(array_join(_n, ' ')) as h, '' as first, '' as last)) "
                f"else transform(_h, (h, i) -> struct(case when {alone} then {literal} else h end as h, _v[i] as first, _v[i + {WINDOW - 1}] as last)) end"
            ).alias("_z"),
        )
    )
    # The outer form keeps Spark from inferring a filter on the array and so computing it twice.
    return arrays.select(key, F.posexplode_outer("_z").alias("pos", "_z")).select(key, "pos", "_z.h", "_z.first", "_z.last").where("h is not null")


#: What tells documents apart: a struct is never null, so it also joins.
DOCUMENT = "named_struct('doc_id', doc_id, 'text', case when doc_id is null then sha2(coalesce(text, ''), 256) end)"


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, matched, n_windows, containment): the items that each document leaks."""
    return document_leaks(docs, benchmark).select("_doc.doc_id", "item_id", "matched", "n_windows", "containment")


def document_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The same with _doc, by DOCUMENT, in place of doc_id."""
    stated = benchmark.select("item_id", "text").withColumn("_item", F.struct("item_id", F.xxhash64("text").alias("text")))
    # Repeated rows of an item are one item.
    every = windows(stated, "_item").unionByName(windows(stated, "_item", names=False)).groupBy("_item", "h", "pos").agg(F.max("first").alias("item_first"), F.max("last").alias("item_last"))
    places = materialize(every.withColumn("n_windows", (F.max("pos").over(Window.partitionBy("_item")) + 1).cast("bigint")))
    small = places.count() <= BROADCAST_WINDOWS
    # Of a window that repeats in an item the first place stands for all.
    items = places.groupBy("_item", "n_windows", "h").agg(F.min(F.struct("pos", "item_first", "item_last")).alias("p"))
    items = items.select("_item", "h", "n_windows", F.col("p.pos").alias("item_pos"), "p.item_first", "p.item_last")
    # The few hits are written, so that the scan of the texts keeps no aggregation state.
    found = windows(docs.select(F.expr(DOCUMENT).alias("_doc"), "text"), "_doc").join(F.broadcast(items) if small else items, "h")
    hits = materialize(found.select("_doc", "_item", "n_windows", "h", "pos", "item_pos", "item_first", "first", "item_last", "last"))
    own = places.select("_item", "h", F.col("pos").alias("place"))
    matched = hits.select("_doc", "_item", "h").distinct().join(F.broadcast(own) if small else own, ["_item", "h"]).groupBy("_doc", "_item").agg(F.count_distinct("place").alias("matched"))
    slots = F.array(F.struct(F.col("item_first").alias("i"), F.col("first").alias("d")), F.struct(F.col("item_last").alias("i"), F.col("last").alias("d")))
    aligned = hits.groupBy("_doc", "_item", "n_windows", (F.col("pos") - F.col("item_pos")).alias("shift")).agg(
        F.count_distinct("item_pos").alias("n"),
        F.array_distinct(F.flatten(F.collect_set(F.filter(slots, lambda x: (x["i"] != "") & (x["d"] != ""))))).alias("pairs"),
    )
    consistent = F.size("pairs") == F.size(F.array_distinct(F.expr("transform(pairs, x -> x.i)")))
    each = aligned.groupBy("_doc", "_item", "n_windows").agg(F.max(F.struct("n", consistent.alias("ok"))).alias("best")).join(matched, ["_doc", "_item"])
    return (
        each.where((F.col("matched") >= CONTAINMENT * F.col("n_windows")) & F.col("best.ok"))
        .withColumn("containment", F.col("matched") / F.col("n_windows"))
        .select("_doc", "_item.item_id", "matched", "n_windows", "containment")
    )


def op9_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    """A row for each benchmark item that a document leaks."""
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The pipeline's form: documents that leak an item go."""
    found = document_leaks(docs, benchmark).select("_doc").distinct()
    return docs.withColumn("_doc", F.expr(DOCUMENT)).join(found, "_doc", "left_anti").select(docs.columns)


_OUTER = OUTER.replace("'", "''")
ORACLE_SQL = f"""
with raw as (
  select 'd' as kind, doc_id as id, coalesce(text, '') as text from documents
  union all select 'b', item_id, coalesce(text, '') from benchmark),
w as (select kind, id, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from raw),
x as (select kind, id, len(w) as size, unnest(w) as x, unnest(range(len(w))) as pos from w),
p as (select *, trim(x, '{_OUTER}') as o, lower(trim(x, '{_OUTER}')) as b,
  regexp_matches(coalesce(lag(x) over (partition by kind, id order by pos), ''), '^[0-9]') as numbered from x),
c as (select *, case
    when regexp_matches(b, '{_NUMBER}') and not regexp_matches(x, '^[a-z]') or b in ({_listed(NUMBER_WORDS)}) then '<num>'
    when numbered and b in ({_listed(UNITS)}) and regexp_matches(x, '^([a-z]|%)') then '<unit>' end as plain,
  left(o, 1) <> lower(left(o, 1)) and regexp_matches(o, '\\p{{Ll}}') and b not in ({_listed(STOP_WORDS)}) as name from p),
t as (select *, coalesce(plain, case when name then '<name>' end) is not null as slot, coalesce(plain, case when name then '<name>' end, b) as t from c
  union all select *, plain is not null, coalesce(plain, b) from (select * replace ('w' as kind) from c where kind = 'b')),
win as (select kind, id, pos, case when slot then b else '' end as f, case when lead(slot, 4) over o then lead(b, 4) over o else '' end as l,
  case when slot and lead(slot, 1) over o and lead(slot, 2) over o and lead(slot, 3) over o and lead(slot, 4) over o
       then 'words ' || b || ' ' || lead(b, 1) over o || ' ' || lead(b, 2) over o || ' ' || lead(b, 3) over o || ' ' || lead(b, 4) over o
       else 'tokens ' || t || ' ' || lead(t, 1) over o || ' ' || lead(t, 2) over o || ' ' || lead(t, 3) over o || ' ' || lead(t, 4) over o end as g
  from t window o as (partition by kind, id order by pos)
  union all select kind, id, 0, '', '', 'short ' || string_agg(b, ' ' order by pos) from t where size < {WINDOW} group by kind, id),
ever as (select id as item_id, pos as ipos, g, max(f) as iff, max(l) as il, max(pos) over (partition by id) + 1 as n from win where kind in ('b', 'w') and g is not null group by id, pos, g),
items as (select item_id, g, n, min(ipos) as ipos, arg_min(iff, ipos) as iff, arg_min(il, ipos) as il from ever group by item_id, g, n),
hits as (select d.id as doc_id, item_id, n, g, d.pos - ipos as shift, ipos, iff, f, il, l from win d join items using (g) where d.kind = 'd'),
slots as (select doc_id, item_id, shift, iff as iv, f as dv from hits where iff <> '' and f <> '' union select doc_id, item_id, shift, il, l from hits where il <> '' and l <> ''),
bad as (select distinct doc_id, item_id, shift from (select doc_id, item_id, shift, iv from slots group by all having count(distinct dv) > 1)),
al as (select doc_id, item_id, shift, count(distinct ipos) as m from hits group by all),
best as (select doc_id, item_id, max_by(bad.shift is null, m * 2 + (bad.shift is null)::int) as ok from al left join bad using (doc_id, item_id, shift) group by all),
tot as (select doc_id, item_id, n, count(distinct e.ipos) as m from (select distinct doc_id, item_id, g from hits) join ever e using (item_id, g) group by all)
select doc_id, item_id, m::bigint as matched, n::bigint as n_windows, m / n as containment
from tot join best using (doc_id, item_id) where m >= {CONTAINMENT} * n and ok
"""
