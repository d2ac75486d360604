"""Quality rules: a threshold table compiled into one Spark projection.

All measures are built-in expressions over the whole text (null counts as empty):
no user functions, no shuffle. The table RULES is data: a rule is a ratio of two measures
and its allowed range, and compile_rules() turns the table into Spark columns.

Defined cases: null, empty and blank texts have no words, so base_failed is true and kept
false; repeated rows give repeated results; extra columns are carried along unless they clash
with a measure's name, when the measure wins.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Frequent function words of the four languages of the corpus.
STOP_WORDS = (
    "the of and to in is it that for on with as was be by at this are or an from not you have has "
    "le la les de des du et un une est que qui pour dans sur pas au par en il elle avec "
    "der die das und ist in den von zu mit auf für ein eine nicht sich des dem auch als "
    "el los las del y en que por con para no es se su al una como"
).split()


@dataclass(frozen=True)
class Rule:
    """kept requires low <= numerator / denominator <= high; a zero denominator passes."""

    name: str
    numerator: str
    denominator: str
    low: float | None
    high: float | None


# Production thresholds.
RULES = (
    Rule("mean_word_length", "word_chars", "n_words", 1.5, 15.0),
    Rule("symbol_ratio", "n_symbols", "word_chars", None, 0.10),
    Rule("symbols_per_word", "n_symbols", "n_words", None, 0.30),
    Rule("exclamation_ratio", "n_exclamations", "n_words", None, 0.50),
    Rule("stop_word_ratio", "n_stop_words_1", "n_words", 0.02, None),
    Rule("dup_line_ratio", "n_dup_lines", "n_lines", None, 0.50),
)


def words_sql(text_sql: str) -> str:
    """SQL for the array of words of a text: every white space becomes a blank, as splitting at one character is quick."""
    for code in range(9, 14):
        text_sql = f"replace({text_sql}, char({code}), ' ')"
    return f"array_remove(split({text_sql}, ' '), '')"


def with_measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """The measures as columns beside the input's own. n_stop_words_1 is smoothed by one, so that
    a short text isn't rejected for want of a single word.

    Each repeated window is found by sorting (hash, position) pairs of the row's 5-word
    windows, so a long document costs n log n; rows without equal windows skip the sort.
    """
    stop = ", ".join(f"'{w}', '{w.capitalize()}'" for w in dict.fromkeys(STOP_WORDS))
    t = f"coalesce(`{text}`, '')"
    five = ", ".join(f"_w[i + {k}]" for k in range(5))
    return (
        docs.withColumn("_w", F.expr(words_sql(t)))
        .withColumn("_l", F.expr(f"filter(split({t}, '\\n'), x -> x rlike '[^\\\\x20\\\\x09-\\\\x0D]')"))
        .withColumn("n_words", F.expr("cast(size(_w) as bigint)"))
        .withColumn("word_chars", F.expr("cast(length(array_join(_w, '')) as bigint)"))
        .withColumn("n_symbols", F.expr(f"cast(length(regexp_replace({t}, '[^#*$%&|<>]+', '')) as bigint)"))
        .withColumn("n_exclamations", F.expr(f"cast(length(regexp_replace({t}, '[^!]+', '')) as bigint)"))
        .withColumn("n_stop_words", F.expr(f"cast(size(filter(_w, x -> x in ({stop}))) as bigint)"))
        .withColumn("n_stop_words_1", F.col("n_stop_words") + 1)
        .withColumn("n_lines", F.expr("cast(size(_l) as bigint)"))
        .withColumn("n_dup_lines", F.expr("cast(size(_l) - size(array_distinct(_l)) as bigint)"))
        .withColumn("_a", F.expr("transform(_w, x -> xxhash64(x))"))
        .withColumn("_b", F.expr("zip_with(_a, slice(_a, 2, size(_a)), (x, y) -> xxhash64(x, y))"))
        .withColumn("_c", F.expr("zip_with(_b, slice(_b, 3, size(_b)), (x, y) -> xxhash64(x, y))"))
        .withColumn("_h", F.expr("slice(zip_with(_c, slice(_a, 5, size(_a)), (x, y) -> xxhash64(x, y)), 1, greatest(size(_a) - 4, 0))"))
        .withColumn(
            "_s",
            F.expr(
                "case when size(array_distinct(_h)) = size(_h) then cast(array() as array<struct<h:bigint,i:int>>) "
                "else array_sort(transform(_h, (h, i) -> struct(h as h, i as i))) end"
            ),
        )
        .withColumn("_e", F.expr("zip_with(_s, slice(_s, 2, size(_s)), (x, y) -> coalesce(x.h = y.h, false))"))
        .withColumn("_f", F.expr("zip_with(_e, concat(array(false), _e), (x, y) -> coalesce(x, false) or y)"))
        .withColumn("_p", F.expr("sort_array(array_compact(zip_with(_s, slice(_f, 1, size(_s)), (x, y) -> case when y then x.i end)))"))
        .withColumn("n_repeat_words", F.expr("aggregate(_p, struct(0L as n, -5 as last), (a, p) -> struct(a.n + least(5, p - a.last) as n, p as last), a -> a.n)"))
        .drop("_w", "_l", "_a", "_b", "_c", "_h", "_s", "_e", "_f", "_p")
    )


def compile_rules(rules: tuple[Rule, ...] = RULES) -> Column:
    """One boolean column: true if every rule of the table holds."""
    verdict = F.lit(True)
    for rule in rules:
        ratio = F.col(rule.numerator) / F.when(F.col(rule.denominator) > 0, F.col(rule.denominator))
        if rule.low is not None:
            verdict = verdict & F.coalesce(ratio >= rule.low, F.lit(True))
        if rule.high is not None:
            verdict = verdict & F.coalesce(ratio <= rule.high, F.lit(True))
    return verdict


def _packed(docs: DataFrame, text: str) -> DataFrame:
    """The rows in one column, so that no column of theirs meets one of the measures'."""
    return docs.select(F.col(f"`{text}`").alias("_text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))


def _verdict(packed: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    return (
        with_measures(packed, "_text")
        .withColumn("base_failed", F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words"))
        .withColumn("kept", ~F.col("base_failed") & compile_rules(rules))
    )


def quality(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with its measures, base_failed and kept."""
    measured = _verdict(_packed(docs, text), rules)
    names = [c for c in measured.columns if c not in ("_text", "_row")]
    return measured.select(*[F.col(f"_row.`{c}`") for c in docs.columns if c.lower() not in names], *names)


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    """The contract's columns for every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return quality(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def keep_documents(docs: DataFrame) -> DataFrame:
    """The pipeline's form: rejected documents go, columns stay."""
    # The filter stands on an exploded column: on the projection itself it would be pushed down with every measure inlined, and computed many times over.
    return _verdict(_packed(docs, "text"), RULES).select("_row", F.explode_outer(F.array("kept")).alias("kept")).where("kept").select("_row.*")


_WORDS = "list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
_STOP = ", ".join(f"'{w}', '{w.capitalize()}'" for w in dict.fromkeys(STOP_WORDS))


def _sql_verdict() -> str:
    parts = []
    for r in RULES:
        for bound, op in ((r.low, ">="), (r.high, "<=")):
            if bound is not None:
                parts.append(f"coalesce({r.numerator} / nullif({r.denominator}, 0) {op} {bound}, true)")
    return " and ".join(parts)


ORACLE_SQL = f"""
with t as (select doc_id, coalesce(text, '') as text, {_WORDS} as w,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as l from documents),
win as (select doc_id, i, array_to_string(w[i:i + 4], ' ') as g
        from (select doc_id, w, unnest(range(1, len(w) - 3)) as i from t where len(w) >= 5)),
rep as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) as n from win) where n >= 2),
cov as (select doc_id, count(distinct p) as n from (select doc_id, unnest(range(i, i + 5)) as p from rep) group by doc_id),
m as (select t.doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::bigint as n_symbols,
             length(regexp_replace(text, '[^!]+', '', 'g'))::bigint as n_exclamations,
             len(list_filter(w, lambda x: x in ({_STOP})))::bigint as n_stop_words,
             len(list_filter(w, lambda x: x in ({_STOP})))::bigint + 1 as n_stop_words_1,
             len(l)::bigint as n_lines, (len(l) - len(list_distinct(l)))::bigint as n_dup_lines,
             coalesce(cov.n, 0)::bigint as n_repeat_words
      from t left join cov using (doc_id)),
b as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and {_sql_verdict()} as kept from b
"""
