"""Source divergence audit: how far the term frequencies of a language's sources lie apart.

Texts are tokenised with a translate table: bytes.translate lower-cases letters and blanks all other
ASCII in one pass, bytes.split parts the terms, and Counters take a document's terms natively. A
task keeps a Counter for each (lang, source) and hands on partial sums whenever it
holds FLUSH of them, so its memory is bounded; Spark adds the partial sums, which are one row for
each term of a group from then on, however common the term is.

A language keeps the terms of MIN_DOCS of its documents or more. With smoothed shares p of a group
and q of what it is held against, both in billionths, a term's divergence is floor((p-q)^2 / q).

* terms: each group's terms above their share in the language, the TOP greatest divergences.
* pairs: each group against each other source of its language, summed over all kept terms. A term
  that neither source has adds the same, one that only one has depends on its count only, so these
  are sums over the sources' count histograms; only terms that both have are met one by one, as
  corrections, summed in the task by pairs of sources. Work grows with the terms' sources, the
  result with the pairs of sources, as asked.

Arithmetic is exact in whole numbers: shares are divided in three steps of three digits, which holds
up to 9e15 counted terms, and squares of billionths fit a long.

Defined cases: null text, lang and source count as empty; a group without terms, or of a language
that keeps none, still meets the other sources (value 0 if none are kept); one source alone has no
pairs; equal values are ordered by item, bytewise; repeated rows count each; very long texts are
tokenised whole; an empty table gives an empty result; extra columns don't matter.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from minuteflow.session import materialize

MIN_DOCS, TOP = 3, 200
#: Partial sums that a task holds before it hands them on, and pairs of term occurrences computed at once.
FLUSH, CHUNK = 300_000, 2_000_000
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: str | bytes) -> list[bytes]:
    """The terms of a text as UTF-8."""
    return (text if isinstance(text, bytes) else text.encode("utf-8", "replace")).translate(_TABLE).split()


def _counted(batches):
    """Batches of (lang, source, text) -> partial sums (lang, source, term, docs, n)."""
    counts, docs, held = defaultdict(Counter), defaultdict(Counter), 0

    def out():
        for (lang, source), group in counts.items():
            if group:
                terms = pa.array(group.keys(), pa.binary()).cast(pa.string())
                own = pa.array(map(docs[lang, source].__getitem__, group), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(group)), pa.repeat(source, len(group)), terms, own, pa.array(group.values(), pa.int64())], names=["lang", "source", "term", "docs", "n"])

    for batch in batches:
        # The texts' bytes as they are: nothing is decoded.
        texts = batch.column("text").cast(pa.binary())
        for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), texts):
            terms = terms_of(text.as_py())
            group, own = counts[lang, source], docs[lang, source]
            before = len(group)
            # Sequences are counted natively; a Counter would be added term by term.
            group.update(terms)
            own.update(set(terms))
            held += len(group) - before
            if held >= FLUSH:
                yield from out()
                counts.clear()
                docs.clear()
                held = 0
    yield from out()


def term_counts(docs: DataFrame) -> DataFrame:
    """docs (lang, source, text) -> (lang, source, term, docs, n), one row for each term of a group."""
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    return rows.mapInArrow(_counted, "lang string, source string, term string, docs bigint, n bigint").groupBy("lang", "source", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))


def share_sql(count: str, total: str) -> str:
    """1 + floor(1e9 * (count + 1) / total), total being N + V: the quotient digit by digit, three at a time."""
    a = f"({count} + 1)"
    one = f"({a} % {total} * 1000)"
    two = f"({one} % {total} * 1000)"
    three = f"({two} % {total} * 1000)"
    return f"(1 + {a} div {total} * 1000000000 + {one} div {total} * 1000000 + {two} div {total} * 1000 + {three} div {total})"


def divergence_sql(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q}) div {q})"


def _floor(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _met(batches):
    """Batches of a row for each term, sources [(id, p, none)] -> (a, b, v): what the terms both have add to pair (a, b), beyond what its histograms add."""
    for batch in batches:
        column = batch.column("sources")
        flat = column.flatten()
        ids, p, none = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(3))
        starts = column.offsets.to_numpy()
        sizes, starts = np.diff(starts), starts[:-1] - starts[0]
        known, local = np.unique(ids, return_inverse=True)
        keys, values = [], []

        def summed():
            key, value = np.concatenate(keys), np.concatenate(values)
            order = np.argsort(key)
            key, first = np.unique(key[order], return_index=True)
            return key, np.add.reduceat(value[order], first)

        for size in np.unique(sizes[sizes > 1]).tolist():
            having = starts[sizes == size]
            # Terms of many sources go one slice of their sources at a time, so that a chunk stays bounded.
            width = max(1, min(size, CHUNK // size))
            step = max(1, CHUNK // (size * width))
            for at in range(0, len(having), step):
                row = having[at : at + step, None] + np.arange(size)
                for left in range(0, size, width):
                    i, j = row[:, left : left + width, None], row[:, None, :]
                    v = _floor(p[i], p[j]) - _floor(p[i], none[j]) - _floor(none[i], p[j]) + _floor(none[i], none[j])
                    key = local[i] * len(known) + local[j]
                    other = np.broadcast_to(i != j, v.shape)
                    keys.append(key[other])
                    values.append(v[other])
                    if sum(map(len, keys)) >= CHUNK:
                        key, value = summed()
                        keys, values = [key], [value]
        if keys:
            key, value = summed()
            yield pa.RecordBatch.from_pydict({"a": known[key // len(known)], "b": known[key % len(known)], "v": value})


def divergences(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """docs (lang, source, text) -> (lang, source, part, item, value, rank)."""
    own = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).groupBy("lang", "source").agg(F.count("*").alias("n_docs"))
    names = materialize(own.select("lang", "source").withColumn("id", F.monotonically_increasing_id()))
    # The sources of a term: as many as the language has at most, and their pairs are no more than the result's rows.
    gathered = term_counts(docs).groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"), F.collect_list(F.struct("source", "n")).alias("sources"))
    kept = materialize(gathered.where(F.col("docs") >= min_docs).drop("docs"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n").alias("n_lang"))
    each = kept.select("lang", "term", F.col("n").alias("n_term"), F.inline("sources"))
    sums = each.groupBy("lang", "source").agg(F.sum("n").alias("n_group"))
    groups = names.join(langs, "lang", "left").join(sums, ["lang", "source"], "left")
    groups = groups.select("lang", "source", "id", F.coalesce("terms", F.lit(0)).alias("terms"), (F.coalesce("n_lang", F.lit(0)) + F.col("terms")).alias("of_lang"), (F.coalesce("n_group", F.lit(0)) + F.col("terms")).alias("of_group"))
    groups = materialize(groups.withColumn("none", F.expr(share_sql("0L", "of_group"))))
    shares = each.join(groups, ["lang", "source"]).select("lang", "source", "term", "n", "id", "none", F.expr(share_sql("n_term", "of_lang")).alias("q"), F.expr(share_sql("n", "of_group")).alias("p"))

    place = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    columns = ["lang", "source", "part", "item", "value", "rank"]
    above = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(divergence_sql("p", "q")).alias("value"))
    terms = above.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= top).select(columns)

    met = shares.groupBy("lang", "term").agg(F.collect_list(F.struct("id", "p", "none")).alias("sources")).select("sources").mapInArrow(_met, "a bigint, b bigint, v bigint")
    exact = "decimal(38,0)"
    histogram = materialize(shares.groupBy("lang", "id", "none", "p").agg(F.count("*").alias("m")))
    others = groups.select("lang", F.col("id").alias("other"), F.col("none").alias("blank"))
    facing = histogram.join(others, "lang").where("id <> other")
    sides = facing.select(
        F.inline(
            F.array(
                F.struct(F.col("id").alias("a"), F.col("other").alias("b"), F.expr(f"cast(m as {exact}) * ({divergence_sql('p', 'blank')} - {divergence_sql('none', 'blank')})").alias("v")),
                F.struct(F.col("other").alias("a"), F.col("id").alias("b"), F.expr(f"cast(m as {exact}) * ({divergence_sql('blank', 'p')} - {divergence_sql('blank', 'none')})").alias("v")),
            )
        )
    )
    added = met.groupBy("a", "b").agg(F.sum(F.col("v").cast(exact)).alias("v")).unionByName(sides.groupBy("a", "b").agg(F.sum("v").alias("v"))).groupBy("a", "b").agg(F.sum("v").alias("added"))
    left = groups.select("lang", "source", F.col("id").alias("a"), "terms", "none")
    right = groups.select("lang", F.col("source").alias("item"), F.col("id").alias("b"), F.col("none").alias("blank"))
    pairs = left.join(right, "lang").where("a <> b").join(added, ["a", "b"], "left")
    value = f"cast(coalesce(cast(terms as {exact}) * {divergence_sql('none', 'blank')}, 0) + coalesce(added, 0) as bigint)"
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.expr(value).alias("value"))
    return pairs.withColumn("rank", F.row_number().over(place)).select(columns).unionByName(terms)


def op13_source_divergence(spark, sf_dir: str) -> DataFrame:
    """The contract's columns over all documents."""
    return divergences(spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "source", "text"))


_SHARE = "1 + (1000000000::hugeint * ({} + 1)) // ({} + 1 * v.v)"
ORACLE_SQL = f"""
with d as (select row_number() over () as id, coalesce(lang, '') as lang, coalesce(source, '') as source,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as words from documents),
w as (select id, lang, source, term, count(*) as n from (select id, lang, source, unnest(words) as term from d) group by all),
k as (select lang, term, sum(n) as n from w group by lang, term having count(distinct id) >= {MIN_DOCS}),
v as (select lang, count(*) as v, sum(n) as n from k group by lang),
g as (select distinct lang, source from d),
c as (select g.lang, g.source, k.term, k.n as n_lang, coalesce(sum(w.n), 0) as n from g join k using (lang) left join w on w.lang = g.lang and w.source = g.source and w.term = k.term group by all),
s as (select *, sum(n) over (partition by lang, source) as total from c),
p as (select s.lang, s.source, s.term, s.n, {_SHARE.format("s.n", "s.total")} as p, {_SHARE.format("s.n_lang", "v.n")} as q from s join v using (lang)),
pairs as (select a.lang, a.source, b.source as item, coalesce(sum((x.p - y.p) * (x.p - y.p) // y.p), 0)::bigint as value
          from g a join g b on a.lang = b.lang and a.source <> b.source
          left join p x on x.lang = a.lang and x.source = a.source left join p y on y.lang = b.lang and y.source = b.source and y.term = x.term group by all),
terms as (select lang, source, term as item, ((p - q) * (p - q) // q)::bigint as value from p where n > 0 and p > q)
select *, row_number() over (partition by lang, source order by value desc, item)::int as rank from (select lang, source, 'pair' as part, item, value from pairs)
union all
select * from (select *, row_number() over (partition by lang, source order by value desc, item)::int as rank from (select lang, source, 'term' as part, item, value from terms)) where rank <= {TOP}
"""
