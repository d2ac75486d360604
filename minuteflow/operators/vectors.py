"""Vector index and thresholded cosine search over array columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from minuteflow.functions.text import is_meaningful, uuid5_url

THRESHOLD = 0.7
# Fields of the embedding text, and the tokens that stand for hidden names.
TEXT_FIELDS = ("meeting_name", "meeting_date", "item_no", "content", "owner", "planned_date", "actual_completed_date", "tracking_result", "status", "responsible_unit")
MEETING_FIELDS = ("meeting_name", "meeting_date", "responsible_unit")
NEUTRAL = {"Person": "person", "Unit": "unit", "Company": "company", "File": "file", "Ref": "reference", "Email": "email", "Phone": "phone", "ID": "identifier", "Token": "identifier"}
TOKEN_LIKE = r"(?<![A-Za-z0-9_])(?:Person|Unit|Company|File|Ref|Email|Phone|ID|Token)_[A-Za-z0-9]+"
TOKEN = r"(?<![A-Za-z0-9_])(?:Person|Unit|Company|File|Ref|Email|Phone|ID|Token)_[A-F0-9]{10}(?![A-Za-z0-9_])"


def neutralized(c: Column) -> Column:
    """A whole-value token is no value; a token inside a text becomes a neutral noun. Texts without an underscore hold none."""
    out = c
    for kind, noun in NEUTRAL.items():
        out = F.regexp_replace(out, rf"(?<![A-Za-z0-9_]){kind}_[A-F0-9]{{10}}(?![A-Za-z0-9_])", noun)
    return F.when(~c.contains("_"), c).when(c.rlike(f"^{TOKEN}$"), None).otherwise(out)


def malformed_token(c: Column) -> Column:
    """The text holds something like a token that isn't one."""
    return F.regexp_replace(c, TOKEN, "").rlike(TOKEN_LIKE)


def with_lines(rows: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """rows with a column _line_<field> for each field that they have: 'field: value', null without a value."""
    own = [f for f in fields if f in rows.columns]
    clean = rows.withColumns({f"_line_{f}": neutralized(F.col(f)) for f in own})
    return clean.withColumns({f"_line_{f}": F.when(is_meaningful(F.col(f"_line_{f}")), F.concat(F.lit(f"{f}: "), f"_line_{f}")) for f in own})


def embedding_texts(items: DataFrame, meetings: DataFrame, fields: tuple[str, ...] = TEXT_FIELDS) -> DataFrame:
    """items with their meetings' fields and embedding_text, the 'field: value' lines of the fields that have a value.

    Each side's lines are made before the join, where each row is once.
    """
    shown = [f for f in MEETING_FIELDS if f in meetings.columns]
    of_items = tuple(f for f in fields if f not in MEETING_FIELDS)
    joined = with_lines(items, of_items).join(with_lines(meetings.select("meeting_id", *shown), tuple(f for f in fields if f in shown)), "meeting_id", "left")
    lines = [f"_line_{f}" for f in fields if f"_line_{f}" in joined.columns]
    return joined.withColumn("embedding_text", F.concat_ws("\n", *lines)).drop(*[c for c in joined.columns if c.startswith("_line_")])


def points(items: DataFrame, meetings: DataFrame, embed=None) -> DataFrame:
    """(id, payload..., embedding_text, vector): embed is a function from a text column to a vector column, such as a pandas UDF."""
    out = embedding_texts(items, meetings).withColumn("id", uuid5_url(F.col("item_id"))).where("embedding_text <> ''")
    return out.withColumn("vector", embed(F.col("embedding_text"))) if embed else out


def upsert(stored: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Stored rows that new doesn't replace, and the new rows."""
    return stored.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def dot(left: Column, right: Column) -> Column:
    return F.aggregate(F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(left: Column, right: Column) -> Column:
    """Clamped to [-1, 1]; 0 for empty vectors, other lengths and zero norms."""
    norm = F.sqrt(dot(left, left)) * F.sqrt(dot(right, right))
    value = F.when((F.size(left) == F.size(right)) & (F.size(left) > 0) & (norm > 0), dot(left, right) / norm).otherwise(0.0)
    return F.least(F.greatest(value, F.lit(-1.0)), F.lit(1.0))


def nearest(vectors: DataFrame, query: list[float], limit: int = 10, threshold: float | None = THRESHOLD, column: str = "vector", key: str = "id") -> DataFrame:
    """The limit most similar rows at or above the threshold; a threshold of None or 0 passes all. Each task keeps only its best rows."""
    scored = vectors.withColumn("score", cosine(F.col(column), F.array(*[F.lit(float(x)) for x in query])))
    if threshold:
        scored = scored.where(F.col("score") >= threshold)
    return scored.orderBy(F.desc("score"), key).limit(limit)


def wrong_dimension(vectors: DataFrame, dimension: int, column: str = "vector") -> DataFrame:
    """Rows whose vector isn't of the dimension."""
    return vectors.where(F.coalesce(F.size(column), F.lit(-1)) != dimension)
