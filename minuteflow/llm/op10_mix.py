"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions only.

A source of weight u / P (u units of a period of P slots) gets one block in each of its windows:
block i (from 0) is released at slot floor(i * P / u) and due by slot ceil((i + 1) * P / u). The
units sum to P, so earliest-deadline-first fills every slot and meets every deadline, and each
source is always less than one block away from its target share. The schedule repeats after P
slots: only one period is laid out (P rows), and every document finds its slot by arithmetic.

Up to MAX_SOURCES sources the period is PERIOD and both small tables are broadcast. Beyond that
the period grows with the sources, one Python task lays it out with two heaps, its rows are joined
without a broadcast hint, and places come from sums over slots.

The order inside a source is by doc_id. Ranks come from counts of narrow doc_id ranges, summed
over the 12-bit digits of the ids, so a source that holds a third of all rows is ranked by many
tasks however its ids lie. No row is dropped: once a source is used up its slots pass on, and the
others keep their order.

Defined cases: an empty table gives an empty result; a null source counts as '' and a null
doc_id comes first; repeated rows get a place each; a source without a target weight, or with one
of 0 or less, has one unit; input columns are kept, except that the operator's own columns
replace ones of the same name.
"""

from __future__ import annotations

from heapq import heappop, heappush

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from minuteflow.session import materialize

BLOCK_DOCS = 16
PERIOD = 240
#: The schedule has PERIOD rows of one count a source; with more sources the period grows and nothing is broadcast.
MAX_SOURCES = 200
#: Slots for each source beyond MAX_SOURCES.
SLOTS_A_SOURCE = 12
#: Bits of a doc_id whose values are ranked together, and of the ranges whose counts are summed together.
RANKED_BITS = 12
SUMMED = 1 << 16


def tempered_units(counts: DataFrame, period: int = PERIOD, power: float = 0.5) -> DataFrame:
    """counts (_source, n) -> (_source, n, s, u): weights by n ** power, or by a column weight, in whole units of the period.

    Every source has a unit; the rest goes by largest remainder. s numbers the sources by name.
    """
    every = Window.partitionBy()
    weight = F.greatest(F.coalesce(F.col("weight").cast("double"), F.lit(0.0)), F.lit(0.0)) if "weight" in counts.columns else F.pow("n", F.lit(power))
    total = F.sum(weight).over(every)
    # Without any weight all sources share alike.
    share = F.when(total > 0, weight / total).otherwise(1 / F.count("*").over(every)) * (period - F.count("*").over(every))
    floored = counts.withColumn("_share", share).withColumn("_floor", F.floor("_share"))
    # Rounding keeps ties apart from the last bit of a double.
    fraction = F.round(F.col("_share") - F.col("_floor"), 9)
    rest = F.lit(period) - F.sum(F.col("_floor") + 1).over(every)
    ranked = floored.withColumn("_rest", rest).withColumn("_rank", F.row_number().over(Window.orderBy(fraction.desc(), "_source")))
    return ranked.select(
        "_source",
        "n",
        (F.row_number().over(Window.orderBy("_source")) - 1).alias("s"),
        (F.col("_floor") + 1 + F.when(F.col("_rank") <= F.col("_rest"), 1).otherwise(0)).cast("int").alias("u"),
    )


def period_schedule(units: DataFrame, period: int = PERIOD) -> DataFrame:
    """(slot_in_period, s, k, done, n_all, u_all): one period of earliest-deadline-first; k numbers a source's blocks in it."""
    packed = units.agg(F.sort_array(F.collect_list(F.struct("s", "u", "n"))).alias("a")).where("size(a) > 0").select(F.expr("transform(a, x -> x.u)").alias("u_all"), F.expr("transform(a, x -> x.n)").alias("n_all"))
    eligible = f"d < u_all[s] and (d * {period}) div u_all[s] <= t"
    deadline = f"((d + 1) * {period} + u_all[s] - 1) div u_all[s]"
    pick = f"array_min(transform(acc.done, (d, s) -> case when {eligible} then named_struct('due', {deadline}, 's', s) end)).s"
    step = f"transform(array({pick}), p -> named_struct('done', transform(acc.done, (d, s) -> d + if(s = p, 1L, 0L)), 'rows', concat(acc.rows, array(named_struct('s', p, 'done', acc.done)))))[0]"
    start = "named_struct('done', transform(u_all, x -> 0L), 'rows', cast(array() as array<struct<s:int,done:array<bigint>>>))"
    rows = packed.select("u_all", "n_all", F.expr(f"posexplode(aggregate(sequence(0, {period} - 1), {start}, (acc, t) -> {step}, acc -> acc.rows))").alias("slot_in_period", "r"))
    return rows.select("slot_in_period", F.col("r.s").alias("s"), F.expr("r.done[r.s]").alias("k"), F.col("r.done").alias("done"), "u_all", "n_all")


def _lay_out(parts, period: int):
    """One part of all (s, u) -> (slot_in_period, s, k): the same earliest-deadline-first with heaps."""
    units = {int(s): int(u) for part in parts for s, u in zip(part["s"], part["u"])}
    # Of every source the next block waits either for its release or, released, for its slot.
    waiting, ready = [(0, s, 0) for s in sorted(units)], []
    rows = []
    for t in range(period if units else 0):
        while waiting and waiting[0][0] <= t:
            _, s, k = heappop(waiting)
            heappush(ready, (-(-(k + 1) * period // units[s]), s, k))
        _, s, k = heappop(ready)
        rows.append((t, s, k))
        if k + 1 < units[s]:
            heappush(waiting, ((k + 1) * period // units[s], s, k + 1))
        if len(rows) == 1 << 16:
            yield pd.DataFrame(rows, columns=["slot_in_period", "s", "k"])
            rows = []
    yield pd.DataFrame(rows, columns=["slot_in_period", "s", "k"])


def long_schedule(units: DataFrame, period: int) -> DataFrame:
    """(slot_in_period, s, k) for any number of sources."""
    return units.select("s", "u").coalesce(1).mapInPandas(lambda parts: _lay_out(parts, period), "slot_in_period bigint, s int, k bigint")


def running(counts: DataFrame, keys: list[str], reach: int) -> DataFrame:
    """counts (keys, _piece, _n) of distinct pieces, reach apart at most -> (keys, _piece, _offset): the sum of _n over smaller pieces.

    Beyond SUMMED pieces only those that differ in the last bits are summed in one group; the others come from sums of groups.
    """
    if reach < SUMMED:
        return counts.select(*keys, "_piece", (F.sum("_n").over(Window.partitionBy(*keys).orderBy("_piece")) - F.col("_n")).alias("_offset"))
    grouped = counts.withColumn("_group", F.shiftright("_piece", RANKED_BITS))
    above = running(grouped.groupBy(*keys, F.col("_group").alias("_piece")).agg(F.sum("_n").alias("_n")), keys, (reach >> RANKED_BITS) + 1)
    inside = F.sum("_n").over(Window.partitionBy(*keys, "_group").orderBy("_piece")) - F.col("_n")
    return (
        grouped.withColumn("_inside", inside)
        .join(above.select(*keys, F.col("_piece").alias("_group"), "_offset"), [*keys, "_group"])
        .select(*keys, "_piece", (F.col("_offset") + F.col("_inside")).alias("_offset"))
    )


def ranked(docs: DataFrame) -> DataFrame:
    """docs with _source and _rank, from 0 by doc_id inside each source."""
    named = docs.withColumn("_source", F.coalesce("source", F.lit(""))).withColumn("_key", F.col("doc_id").cast("bigint")).withColumn("_known", F.col("doc_id").isNotNull().cast("int"))
    span = named.agg(F.min("_key").alias("low"), F.max("_key").alias("high"), F.count(F.when(F.col("_known") == 0, 1)).alias("nulls")).first()
    low, high = span["low"] or 0, span["high"] or 0
    if span["nulls"]:
        # Rows without id are told apart by their place; it is written, so that it's the same in each job.
        named = materialize(named.withColumn("_key", F.coalesce("_key", F.monotonically_increasing_id())))
        placed = named.where("_known = 0").agg(F.max("_key")).first()[0]
        low, high = min(low, 0), max(high, placed)
    keys = ["_source", "_known"]
    pieced = named.withColumn("_piece", F.shiftright("_key", RANKED_BITS))
    counted = pieced.groupBy(*keys, "_piece").agg(F.count("*").alias("_n"))
    offsets = running(counted, keys, (high >> RANKED_BITS) - (low >> RANKED_BITS))
    inside = F.row_number().over(Window.partitionBy(*keys, "_piece").orderBy("_key")) - 1
    out = pieced.withColumn("_inside", inside).join(offsets, [*keys, "_piece"]).withColumn("_rank", F.col("_offset") + F.col("_inside"))
    if span["nulls"]:
        first = named.groupBy("_source").agg(F.count(F.when(F.col("_known") == 0, 1)).alias("_first"))
        out = out.join(first, "_source").withColumn("_rank", F.col("_rank") + F.col("_known") * F.col("_first")).drop("_first")
    return out.drop("_piece", "_inside", "_offset", "_known", "_key")


def mix(docs: DataFrame, period: int = PERIOD, block_docs: int = BLOCK_DOCS, targets: DataFrame | None = None) -> DataFrame:
    """docs with block, slot, release, deadline and position (its place in the mixed order, from 0).

    targets (source, weight) replaces the square roots of the sources' sizes.
    """
    counts = docs.groupBy(F.coalesce("source", F.lit("")).alias("_source")).agg(F.count("*").alias("n"))
    if targets is not None:
        wanted = targets.groupBy(F.coalesce("source", F.lit("")).alias("_source")).agg(F.sum("weight").alias("weight"))
        counts = counts.join(wanted, "_source", "left")
    n_sources = counts.count()
    many = n_sources > min(MAX_SOURCES, period * MAX_SOURCES // PERIOD)
    if many:
        period = max(period, SLOTS_A_SOURCE * n_sources)
    units = tempered_units(counts, period)
    if many:
        units = materialize(units)
        schedule = materialize(long_schedule(units, period))
    else:
        # Both tables are bounded by MAX_SOURCES and the period.
        units, schedule = F.broadcast(units), F.broadcast(period_schedule(units, period))
    own = ("block", "slot", "release", "deadline", "position")
    keep = [c for c in docs.columns if c.lower() not in own]
    # The rows travel in one column, so that no column of theirs meets one of the schedule's.
    placed = (
        ranked(docs.select("doc_id", "source", F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_row")))
        .join(units.select("_source", "s", "u"), "_source")
        .withColumn("block", F.expr(f"_rank div {block_docs}"))
        .withColumn("_round", F.expr("block div u"))
        .withColumn("k", F.expr("block % u"))
        .join(schedule, ["s", "k"])
        .withColumn("slot", F.expr(f"_round * {period} + slot_in_period"))
    )
    if many:
        # A slot holds one block: of each the documents in earlier slots are summed.
        sizes = placed.groupBy(F.col("slot").alias("_piece")).agg(F.count("*").alias("_n"))
        last = (docs.count() // block_docs + 1) * period
        placed = placed.join(running(sizes.withColumn("_all", F.lit(0)), ["_all"], last).select(F.col("_piece").alias("slot"), "_offset"), "slot")
        before = "_offset"
    else:
        before = f"aggregate(zip_with(zip_with(u_all, done, (x, d) -> _round * x + d), n_all, (b, m) -> least(m, b * {block_docs})), 0L, (a, x) -> a + x)"
    return (
        placed.withColumn("release", F.expr(f"block * {period} div u"))
        .withColumn("deadline", F.expr(f"((block + 1) * {period} + u - 1) div u"))
        .withColumn("position", F.expr(f"{before} + _rank % {block_docs}"))
        .select("_row.*", *own)
    )


def op10_mix_sources(spark, sf_dir: str) -> DataFrame:
    """Every document with its place in the mix."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source"))


ORACLE_SQL = f"""
with recursive c as (select coalesce(source, '') as source, count(*) as n from documents group by 1),
sh as (select source, n, sqrt(n) / sum(sqrt(n)) over () * ({PERIOD} - count(*) over ()) as share from c),
fl as (select *, floor(share)::bigint as f, round(share - floor(share), 9) as fr from sh),
rk as (select *, row_number() over (order by fr desc, source) as r, {PERIOD} - sum(f + 1) over () as rest from fl),
un as (select source, n, row_number() over (order by source) as s, (f + 1 + (r <= rest)::int)::bigint as u from rk),
pk as (select list(u order by s) as u, list(n order by s) as n from un),
edf as (
  select 0::bigint as t, list_transform(u, lambda x: 0::bigint) as done, u, n from pk
  union all
  select t + 1, list_transform(done, lambda d, i: d + (i = 1 + list_min(list_transform(done, lambda e, j:
      case when e < u[j] and (e * {PERIOD}) // u[j] <= t then (((e + 1) * {PERIOD} + u[j] - 1) // u[j]) * 1000 + j - 1 end)) % 1000)::bigint), u, n
  from edf where t < {PERIOD}),
sl as (select a.t, a.done, a.u as ua, a.n as na, unnest(range(1, len(a.u) + 1)) as s, b.done as after from edf a join edf b on b.t = a.t + 1),
sc as (select t, done, ua, na, s, done[s] as k from sl where after[s] > done[s]),
d as (select doc_id, coalesce(source, '') as src, row_number() over (partition by coalesce(source, '') order by doc_id) - 1 as rank, source from documents),
p as (select d.*, s, u, rank // {BLOCK_DOCS} as block from d join un on un.source = d.src)
select doc_id, source, block::bigint as block, ((block // u) * {PERIOD} + t)::bigint as slot, ((block * {PERIOD}) // u)::bigint as release,
  (((block + 1) * {PERIOD} + u - 1) // u)::bigint as deadline,
  (list_sum(list_transform(ua, lambda x, i: least(na[i], ((block // u) * x + done[i]) * {BLOCK_DOCS}))) + rank % {BLOCK_DOCS})::bigint as position
from p join sc on sc.s = p.s and sc.k = p.block % p.u
"""
