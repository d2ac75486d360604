"""De-identification: stable pseudonyms for fields, neutral nouns in free text, mapping export."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from minuteflow.functions.text import has_owner, is_meaningful, strip
from minuteflow.session import materialize

# Prefixes, nouns and patterns of personal data.
PREFIXES = {"person": "Person", "unit": "Unit", "company": "Company", "location": "Location", "file": "File", "ref": "Ref"}
NOUNS = {"person": "person", "unit": "unit", "company": "company", "location": "location", "file": "file", "ref": "reference", "email": "email", "phone": "phone", "id": "identifier"}
FIELDS = {"chairperson": "person", "recorder": "person", "owner": "person", "responsible_unit": "unit", "company_name": "company", "location": "location", "form_no": "ref", "ref_no": "ref"}
TEXTS = ("meeting_name", "content", "tracking_result", "raw_row_text", "raw_text", "description")
STORED_NOUNS = {"person": "人員", "unit": "單位", "company": "公司", "location": "地點", "file": "文件", "ref": "編號", "email": "電子郵件", "phone": "電話", "id": "身分識別碼", "token": "識別碼"}
STORED_FIELDS = FIELDS | {"person": "person", "person_name": "person", "matched_entity": "person", "unit": "unit", "unit_name": "unit"}
KEPT = (
    "_id", "document_id", "meeting_id", "item_id", "search_id", "click_id", "action_id", "decision_id", "risk_id", "issue_id", "stored_filename", "file_path", "absolute_file_path", "file_ext", "mime_type", "doc_type",
    "status", "status_source", "status_confidence", "meeting_date", "start_time", "end_time", "planned_date", "actual_completed_date", "created_at", "updated_at", "deleted_at", "file_modified_at", "page_count", "file_size", "is_deleted", "result_count",
)
RETRIEVAL_TEXTS = ("raw_text", "content", "tracking_result", "raw_row_text", "query", "filters")
TOKEN = r"(?<![A-Za-z0-9_])(Person|Unit|Company|File|Ref|Email|Phone|ID|Token)_[A-F0-9]{10}(?![A-Za-z0-9_])"
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
NATIONAL_ID = r"(?i)\b[A-Z][12]\d{8}\b"
#: Nine digits at least, by look-ahead; dates have eight.
PHONE = r"(?<!\w)(?=(?:[\s().+-]*\d){9})(?:\+?\d[\d\s().-]{7,}\d)(?!\w)"


#: Values are looked up in texts by their rarest piece of this many characters; shorter ones whole.
GRAM = 6
#: The bitmap of filed pieces: 2^27 bits (16 MB) in blocks of Spark's bitmap_construct_agg; and the keys that one piece is dealt over.
BITS, BLOCK, SALTS = 1 << 27, 32768, 16


def pseudonym(kind: str, value: Column, salt: str) -> Column:
    """Prefix_ and ten hex digits of the salted digest; placeholders and nulls stay."""
    text = strip(value)
    digest = F.upper(F.substring(F.sha2(F.concat(F.lit(salt), F.lit("\0"), F.lit(kind), F.lit("\0"), text), 256), 1, 10))
    return F.when(is_meaningful(value), F.concat(F.lit(PREFIXES.get(kind, "Token") + "_"), digest)).otherwise(value)


def filename(value: Column, salt: str) -> Column:
    """A pseudonym with the file's own suffix."""
    return F.when(is_meaningful(value), F.concat(pseudonym("file", value, salt), F.regexp_extract(value, r"(\.[^.]*)$", 1))).otherwise(value)


def scrub_patterns(text: Column, nouns: dict[str, str] = NOUNS) -> Column:
    """E-mail addresses, national ids and phone numbers become nouns."""
    out = F.regexp_replace(text, EMAIL, nouns["email"])
    out = F.regexp_replace(out, NATIONAL_ID, nouns["id"])
    return F.regexp_replace(out, PHONE, nouns["phone"])


def neutralize_tokens(text: Column, nouns: dict[str, str] = STORED_NOUNS) -> Column:
    """Pseudonyms in a text become nouns."""
    return reduce(lambda t, kind: F.regexp_replace(t, TOKEN.replace("Person|Unit|Company|File|Ref|Email|Phone|ID|Token", kind), nouns[kind.lower()]), ("Person", "Unit", "Company", "File", "Ref", "Email", "Phone", "ID", "Token"), text)


def neutralize_texts(rows: DataFrame) -> DataFrame:
    """rows with nouns for the pseudonyms in the texts that retrieval reads."""
    return rows.withColumns({c: neutralize_tokens(F.col(c)) for c in RETRIEVAL_TEXTS if c in rows.columns})


def sensitive_values(rows: DataFrame, key: str) -> DataFrame:
    """(key, kind, original): the distinct values of the sensitive fields of each document."""
    fields = [F.struct(F.lit(kind).alias("kind"), strip(F.col(c)).alias("original")) for c, kind in FIELDS.items() if c in rows.columns]
    parts = [F.array(*fields)]
    if "attendees" in rows.columns:
        parts.append(F.transform(F.coalesce("attendees", F.array().cast("array<string>")), lambda a: F.struct(F.lit("person").alias("kind"), strip(a).alias("original"))))
    return rows.select(key, F.explode(F.concat(*parts)).alias("v")).select(key, "v.kind", "v.original").where(is_meaningful(F.col("original"))).distinct()


def deidentify(rows: DataFrame, values: DataFrame, key: str, salt: str) -> DataFrame:
    """rows with pseudonyms in fields and, in texts, each document's own values replaced longest first, then patterns."""
    nouns = F.create_map(*[F.lit(x) for kv in NOUNS.items() for x in kv])
    own = values.groupBy(key).agg(F.array_sort(F.collect_set(F.struct((-F.length("original")).alias("shortness"), "original", nouns[F.col("kind")].alias("noun")))).alias("_values"))
    out = rows.join(own, key, "left")
    no_values = F.expr("cast(array() as array<struct<shortness:int,original:string,noun:string>>)")

    def text(c: str) -> Column:
        replaced = F.aggregate(F.coalesce("_values", no_values), F.col(c), lambda t, v: F.replace(t, v["original"], v["noun"]))
        return scrub_patterns(replaced)

    changed = {c: pseudonym(kind, F.col(c), salt) for c, kind in FIELDS.items() if c in rows.columns}
    changed |= {c: text(c) for c in TEXTS if c in rows.columns}
    if "attendees" in rows.columns:
        changed["attendees"] = F.transform("attendees", lambda a: pseudonym("person", a, salt))
    if "original_filename" in rows.columns:
        changed["original_filename"] = filename(F.col("original_filename"), salt)
    return out.withColumns(changed).drop("_values")


def mapping(values: DataFrame, salt: str) -> DataFrame:
    """(kind, original, anonymized), sorted, one row for each value."""
    chain = None
    for kind in PREFIXES:
        chain = (F if chain is None else chain).when(F.col("kind") == kind, pseudonym(kind, F.col("original"), salt))
    return values.select("kind", "original").distinct().withColumn("anonymized", chain).orderBy("kind", "original")


def changed_fields(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, fields): which columns differ between two versions of the rows."""
    columns = [c for c in before.columns if c != key and c in after.columns]
    a, b = before.alias("a"), after.alias("b")
    diff = F.array_compact(F.array(*[F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), F.lit(c)) for c in columns]))
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}")).select(F.col(f"a.{key}").alias(key), diff.alias("fields")).where(F.size("fields") > 0)


def stored_values(*tables: DataFrame) -> DataFrame:
    """(kind, original): the distinct sensitive values of all stored tables together."""

    def of(rows: DataFrame) -> DataFrame:
        lists = [F.transform(F.coalesce("attendees", F.array().cast("array<string>")), lambda a: F.struct(F.lit("person").alias("kind"), strip(a).alias("original")))] if "attendees" in rows.columns else []
        fields = [F.struct(F.lit(kind).alias("kind"), strip(F.col(c)).alias("original")) for c, kind in (STORED_FIELDS | {"original_filename": "file"}).items() if c in rows.columns]
        none = F.expr("cast(array() as array<struct<kind:string,original:string>>)")
        return rows.select(F.explode_outer(F.concat(none, *([F.array(*fields)] if fields else []), *lists)).alias("v")).select("v.*").where(has_owner(F.col("original"))).distinct()

    return reduce(DataFrame.union, map(of, tables)).distinct()


def stored_texts(rows: DataFrame, key: str) -> list[str]:
    """The string columns that are neither kept, nor pseudonymised, nor the key."""
    return [c for c, kind in rows.dtypes if kind == "string" and c not in (key, "original_filename", *KEPT, *STORED_FIELDS)]


def candidates_in(rows: DataFrame, key: list[str], texts: list[str], values: DataFrame) -> DataFrame:
    """(key, kind, original): values that may stand in a row's texts, every one that does among them; the caller checks the text.

    Each value is filed under its rarest piece of GRAM characters, so that values with a common
    beginning don't meet under one key. A bitmap of the filed pieces (BITS bits, whatever the values)
    goes to all tasks, and only pieces of texts that it knows are shuffled to the values. A piece that
    stands in every text is dealt over SALTS keys. Values are merged, never broadcast: Spark knows the
    size of their file, but not how many rows their pieces and salts make of it.
    """

    def pieces(c: Column, size: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length(c) - size + 1), lambda i: c.substr(i, size))

    values = materialize(values.select("kind", "original"))
    cut = values.select("kind", "original", F.explode_outer(F.array_distinct(pieces(F.col("original"), F.least(F.length("original"), F.lit(GRAM))))).alias("piece"))
    common = cut.groupBy("piece").agg(F.count("*").alias("n"))
    filed = materialize(cut.hint("merge").join(common, "piece").groupBy("kind", "original").agg(F.min(F.struct("n", "piece"))["piece"].alias("piece")))
    place = F.pmod(F.xxhash64("piece"), F.lit(BITS))
    bitmap = filed.select(place.alias("_place")).groupBy(F.floor(F.col("_place") / BLOCK).alias("_block")).agg(F.bitmap_construct_agg(F.col("_place") % BLOCK).alias("_bits"))
    # At most GRAM sizes, whatever the values.
    sizes = [r[0] for r in values.select(F.least(F.length("original"), F.lit(GRAM)).alias("size")).distinct().collect()]
    none = F.array().cast("array<string>")
    blob = F.array(*[F.coalesce(c, F.lit("")) for c in texts])

    def of_size(size: int) -> Column:
        return F.flatten(F.transform(blob, lambda t: F.when(F.length(t) >= size, pieces(t, F.lit(size))).otherwise(none)))

    found = rows.select(*key, F.explode_outer(F.array_distinct(F.concat(none, *map(of_size, sizes)))).alias("piece")).select("*", place.alias("_place"))
    byte = F.conv(F.hex(F.substring("_bits", F.floor(F.col("_place") % BLOCK / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    known = byte.bitwiseAND(F.expr("shiftleft(1, cast(_place % 8 as int))")) != 0
    likely = found.withColumn("_block", F.floor(F.col("_place") / BLOCK)).join(F.broadcast(bitmap), "_block").where(known)
    likely = likely.select(*key, "piece", F.pmod(F.xxhash64(*key), F.lit(SALTS)).alias("_salt"))
    dealt = filed.select("*", F.explode(F.array(*[F.lit(k).cast("bigint") for k in range(SALTS)])).alias("_salt"))
    return likely.join(dealt.hint("merge"), ["piece", "_salt"]).select(*key, "kind", "original")


_VALUES = "array<struct<shortness:int,original:string,noun:string>>"


def _entry() -> Column:
    """What replacing needs of a candidate (kind, original), longest first in order."""
    nouns = F.create_map(*[F.lit(x) for kv in STORED_NOUNS.items() for x in kv])
    return F.struct((-F.length("original")).alias("shortness"), "original", nouns[F.col("kind")].alias("noun"))


def _scrubbed(text: Column, values: Column) -> Column:
    """A text with nouns for values, patterns and pseudonyms."""
    replaced = F.aggregate(values, text, lambda t, v: F.replace(t, v["original"], v["noun"]))
    return neutralize_tokens(scrub_patterns(replaced, STORED_NOUNS))


def deidentify_stored(rows: DataFrame, values: DataFrame, key: str, salt: str) -> DataFrame:
    """rows with pseudonyms in fields; in all other texts every stored value, whoever's it is, becomes a noun, longest first, then patterns and pseudonyms.

    Ids, dates, states and numbers stay. key must be unique and not null.
    """
    texts = stored_texts(rows, key)
    own = candidates_in(rows, [key], texts, values).groupBy(key).agg(F.array_sort(F.collect_set(_entry())).alias("_values"))
    stands = lambda v: reduce(lambda a, b: a | b, (F.coalesce(F.col(c).contains(v["original"]), F.lit(False)) for c in texts), F.lit(False))
    found = rows.join(own, key, "left").withColumn("_values", F.filter(F.coalesce("_values", F.array().cast(_VALUES)), stands))
    changed = {c: pseudonym(kind, F.col(c), salt) for c, kind in STORED_FIELDS.items() if c in rows.columns}
    changed |= {c: _scrubbed(F.col(c), F.col("_values")) for c in texts}
    if "attendees" in rows.columns:
        changed["attendees"] = F.transform("attendees", lambda a: pseudonym("person", a, salt))
    if "original_filename" in rows.columns:
        changed["original_filename"] = filename(F.col("original_filename"), salt)
    return found.withColumns(changed).drop("_values").select(*rows.columns)


def deidentify_properties(rows: DataFrame, values: DataFrame, key: list[str], salt: str, properties: str = "properties") -> DataFrame:
    """(key, properties) of graph nodes or vector points, whose property map is treated like columns.

    The name of a node of type Person or Unit is a field; rows without a column type are points. Keys must be unique.
    The map is changed where it is: a row meets the values found in its texts, and no entry travels by itself.
    """
    of_type = F.col("type") if "type" in rows.columns else F.lit("Point")

    def kind(name: Column) -> Column:
        of = F.when((name == "name") & (of_type == "Person"), "person").when((name == "name") & (of_type == "Unit"), "unit")
        for field, k in STORED_FIELDS.items():
            of = of.when(name == field, k)
        return of.when(name == "original_filename", "file").when(name.isin(*KEPT), "kept").otherwise("text")

    entries = rows.select(*key, of_type.alias("_type"), F.explode(F.map_filter(properties, lambda name, value: kind(name) == "text")).alias("_name", "_value"))
    found = candidates_in(entries.select(*key, "_name", "_value"), [*key, "_name"], ["_value"], values)
    own = found.groupBy(*key).agg(F.array_sort(F.collect_set(F.struct(_entry().alias("v"), F.col("_name").alias("name")))).alias("_values"))
    own = own.select(*[F.col(k).alias(f"_key_{k}") for k in key], "_values")
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in key))
    none = F.array().cast(f"array<struct<v:{_VALUES[6:-1]},name:string>>")

    def changed(e: Column) -> Column:
        stand = F.filter(F.coalesce("_values", none), lambda v: (v["name"] == e["key"]) & e["value"].contains(v["v"]["original"]))
        new = reduce(lambda c, k: c.when(kind(e["key"]) == k, pseudonym(k, e["value"], salt)), PREFIXES, F.when(kind(e["key"]) == "text", _scrubbed(e["value"], F.transform(stand, lambda v: v["v"]))).when(kind(e["key"]) == "file", filename(e["value"], salt)))
        return F.struct(e["key"].alias("key"), new.otherwise(e["value"]).alias("value"))

    held = F.array_sort(F.map_entries(F.coalesce(properties, F.create_map().cast("map<string,string>"))))
    return rows.join(own, same, "left").select(*key, F.map_from_entries(F.transform(held, changed)).alias(properties))


def change_summary(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """One row (seen, changed): how many rows there are, and in how many some column differs."""
    columns = [c for c in before.columns if c != key and c in after.columns]
    one, two = (rows.select(key, F.xxhash64(*columns).alias(name)) for rows, name in ((before, "a"), (after, "b")))
    return one.join(two, key).agg(F.count("*").alias("seen"), F.count_if(F.col("a") != F.col("b")).alias("changed"))
