"""Evidence for answers: fusion of retrievers, numbered records, claims, consistency and golden cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STRUCTURED_SCORE = 5.0
KEY = ("meeting_id", "item_id", "matched_relation", "matched_entity", "evidence_source")
EXPLICIT = ("structural_list", "relation_lookup", "composite_query", "follow_up_tracking")


def fuse(graph: DataFrame, structured: DataFrame, semantic: DataFrame) -> DataFrame:
    """Graph rows in the answer's context, filled from structured rows; then structured and semantic items not yet there.

    graph (meeting_id, item_id, content, matched_relation, matched_entity, graph_score), structured
    (meeting_id, item_id, content), semantic (meeting_id, item_id, content, score). An empty context
    keeps all graph rows.
    """
    cols = ["meeting_id", "item_id", "content", "matched_relation", "matched_entity", "graph_score", "evidence_source", "source_rank"]
    none = F.lit(None).cast("string")
    context = structured.select("item_id").union(semantic.select("item_id")).where("item_id is not null").distinct()
    has_context = not context.isEmpty()
    kept = graph.join(context, "item_id", "left_semi") if has_context else graph
    filled = kept.join(structured.select("item_id", F.col("content").alias("_content")).dropDuplicates(["item_id"]), "item_id", "left").withColumn("content", F.coalesce(F.nullif("content", F.lit("")), "_content"))
    rows = filled.withColumns({"evidence_source": F.lit("graph"), "source_rank": F.lit(0)}).select(cols)
    more = structured.join(rows.select("item_id").distinct(), "item_id", "left_anti").withColumns({"matched_relation": none, "matched_entity": none, "graph_score": F.lit(STRUCTURED_SCORE), "evidence_source": F.lit("structured"), "source_rank": F.lit(1)}).select(cols)
    rest = semantic.join(rows.select("item_id").union(more.select("item_id")).distinct(), "item_id", "left_anti").withColumns({"matched_relation": none, "matched_entity": none, "graph_score": F.col("score"), "evidence_source": F.lit("semantic"), "source_rank": F.lit(2)}).select(cols)
    return rows.union(more).union(rest)


def records(fused: DataFrame, limit: int = 50) -> DataFrame:
    """Distinct evidence in order of source, score and item, numbered evidence_001, ...; the answer's evidence is bounded by limit."""
    key = [F.coalesce(c, F.lit("")) for c in KEY]
    order = ["source_rank", F.desc("graph_score"), *key]
    one = fused.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order[:2], F.coalesce("content", F.lit(""))))).where("_r = 1").drop("_r").orderBy(*order).limit(limit)
    return one.withColumn("evidence_id", F.format_string("evidence_%03d", F.row_number().over(Window.orderBy(*order))))


def claim_text() -> F.Column:
    """One sentence for a record, by its relation."""
    item, entity = F.coalesce("content", "item_id"), F.coalesce("matched_entity", F.lit(""))
    return (
        F.when(F.col("matched_relation") == "RESPONSIBLE_BY", F.concat(entity, F.lit(" is responsible for "), item))
        .when(F.col("matched_relation") == "HAS_PLANNED_DATE", F.concat(item, F.lit(" is planned for "), entity))
        .when(F.col("matched_relation") == "HAS_COMPLETED_DATE", F.concat(item, F.lit(" was completed on "), entity))
        .when(F.col("matched_relation").isin("MENTIONS", "MENTIONS_PRODUCT", "MENTIONS_REGULATION"), F.concat(item, F.lit(" mentions "), entity))
        .otherwise(item)
    )


def complete_claims(claims: DataFrame, evidence: DataFrame, query_type: str) -> DataFrame:
    """Claims (claim, evidence_ids) with a valid id, without repeats; explicit routes and empty claim lists get one for each uncited record."""
    cited = claims.where(F.trim("claim") != "").select("claim", F.posexplode("evidence_ids").alias("at", "evidence_id"))
    known = cited.groupBy("claim", "evidence_id").agg(F.min("at").alias("at")).join(evidence.select("evidence_id").distinct(), "evidence_id", "left_semi")
    listed = F.array_sort(F.collect_list(F.struct("at", "evidence_id")))
    valid = known.groupBy("claim").agg(F.transform(listed, lambda x: x["evidence_id"]).alias("evidence_ids"))
    if query_type not in EXPLICIT and not valid.isEmpty():
        return valid
    cited = valid.select(F.explode("evidence_ids").alias("evidence_id")).distinct()
    return valid.union(evidence.join(cited, "evidence_id", "left_anti").select(claim_text().alias("claim"), F.array("evidence_id").alias("evidence_ids")))


def cited_evidence(evidence: DataFrame, claims: DataFrame) -> DataFrame:
    return evidence.join(claims.select(F.explode("evidence_ids").alias("evidence_id")).distinct(), "evidence_id", "left_semi")


def render_answer(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """One row: a numbered list of claims with their meetings and items. Claims of one answer are few."""
    source = evidence.select("evidence_id", F.concat_ws(" / ", "meeting_id", "item_id").alias("ref"))
    lines = claims.withColumn("evidence_id", F.explode("evidence_ids")).join(source, "evidence_id").groupBy("claim").agg(F.min("evidence_id").alias("first"), F.array_join(F.array_sort(F.collect_set("ref")), "; ").alias("refs"))
    listed = F.array_sort(F.collect_list(F.struct("first", "claim", "refs")))
    return lines.agg(F.array_join(F.transform(listed, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["claim"], F.lit(" ("), x["refs"], F.lit(")"))), "\n").alias("answer"))


def trace_counts(evidence: DataFrame) -> DataFrame:
    """(kind, value, count) of evidence by source and by relation."""
    by_source = evidence.groupBy(F.col("evidence_source").alias("value")).agg(F.count("*").alias("count")).select(F.lit("source").alias("kind"), "value", "count")
    by_relation = evidence.where("matched_relation is not null").groupBy(F.col("matched_relation").alias("value")).agg(F.count("*").alias("count")).select(F.lit("relation").alias("kind"), "value", "count")
    return by_source.union(by_relation)


def consistent(claim_ids: F.Column, graph_ids: F.Column, source_ids: F.Column) -> F.Column:
    """The three sets of evidence ids are equal."""
    a, b, c = (F.array_sort(F.array_distinct(x)) for x in (claim_ids, graph_ids, source_ids))
    return (a == b) & (b == c)


def evaluate(cases: DataFrame, answers: DataFrame) -> DataFrame:
    """Each golden case with its missing and unexpected ids and whether it passed; disabled cases are skipped.

    cases (id, enabled, expected_item_ids, unexpected_item_ids), answers (id, item_ids).
    """
    none = F.array().cast("array<string>")
    joined = cases.join(answers, "id", "left").withColumns({c: F.coalesce(c, none) for c in ("expected_item_ids", "unexpected_item_ids", "item_ids")})
    missing = F.array_sort(F.array_except("expected_item_ids", "item_ids"))
    unexpected = F.array_sort(F.array_intersect("unexpected_item_ids", "item_ids"))
    status = F.when(~F.col("enabled"), "skipped").when((F.size("missing") == 0) & (F.size("unexpected") == 0), "passed").otherwise("failed")
    return joined.withColumns({"missing": missing, "unexpected": unexpected}).withColumn("result", status).select("id", "missing", "unexpected", "result")


def summarize(evaluated: DataFrame) -> DataFrame:
    return evaluated.agg(F.count("*").alias("total"), *[F.count_if(F.col("result") == r).alias(r) for r in ("passed", "failed", "skipped")])
