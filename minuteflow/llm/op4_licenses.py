"""License scans in DataFrame functions only: sparse TF-IDF cosine, then inheritance by path joins.

Every line and every sentence of every file is a unit, and the whole of a licence file (by its
name) is one too; a sentence may go over several lines, as a wrapped header does. A unit's terms
are weighted by TF-IDF over the templates; terms that no template has get the highest weight, so
text around a licence statement lowers its cosine. Only units with a telling term are exploded:
telling_terms() takes so many of each template that the rest of it can't reach THRESHOLD, so no
unit at or above it is lost, whatever the templates. A file carries the licence of its best unit at
or above THRESHOLD; a directory carries that of its licence files; a file without its own takes
that of the nearest ancestor directory that has one.

The templates are constants of bounded size and are broadcast. Inheritance is resolved once for
each distinct directory and joined to files by directory; adaptive execution splits a directory
that holds a large part of them.

Defined cases: null and empty texts carry no licence of their own; a null path has no ancestors;
equal scores take the first licence by name; repeated rows give repeated results; extra columns
don't matter; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from minuteflow.session import discard, materialize

THRESHOLD = 0.55

# Licence statements, headers and opening passages, by SPDX identifier.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("LGPL-3.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)
# Words without weight.
IGNORED = "a all an and any are as at be but by for from have has if in is it its may no nor not of on or that the this to under was with you".split()
LICENCE_FILE = r"(?i)(^|/)(licen[cs]e|copying|notice|unlicense)([._-][^/]*)?$"


def terms(text: str) -> list[str]:
    return [t.strip(".") for t in re.split(r"[^a-z0-9.]+", text.lower()) if t.strip(".") and t.strip(".") not in IGNORED]


def _terms_sql(column: str) -> str:
    ignored = ", ".join(f"'{w}'" for w in ["", *IGNORED])
    return f"filter(transform(split(lower({column}), '[^a-z0-9.]+'), x -> trim(both '.' from x)), x -> x not in ({ignored}))"


def template_weights() -> tuple[list[tuple[str, int, str, float]], float]:
    """(licence, template, term, weight of the unit-length template) rows, and the weight of unknown terms."""
    counts = [(name, k, Counter(terms(text))) for k, (name, text) in enumerate(TEMPLATES)]
    frequency = Counter(t for _, _, c in counts for t in c)
    idf = {t: math.log((1 + len(counts)) / (1 + n)) + 1 for t, n in frequency.items()}
    rows = []
    for name, k, c in counts:
        norm = math.sqrt(sum((n * idf[t]) ** 2 for t, n in c.items()))
        rows += [(name, k, t, idf[t], n * idf[t] / norm) for t, n in sorted(c.items())]
    return rows, math.log(1 + len(counts)) + 1


def telling_terms() -> list[str]:
    """Terms of which a unit at or above the threshold has one: without them the rest of a template is too short a vector."""
    rows, _ = template_weights()
    telling = set()
    for k in {r[1] for r in rows}:
        left = 1.0
        for weight, term in sorted(((r[4], r[2]) for r in rows if r[1] == k), reverse=True):
            if math.sqrt(max(left, 0)) < THRESHOLD - 1e-6:
                break
            telling.add(term)
            left -= weight * weight
    return sorted(telling)


#: White space after a full stop parts sentences.
SENTENCE = "[.!?][ \t\n\r\f]+"


def own_licences(files: DataFrame) -> DataFrame:
    """files (file_id, path, text) -> (file_id, licence, score) for files with a unit at or above the threshold."""
    rows, unknown = template_weights()
    spark = files.sparkSession
    weights = spark.createDataFrame(rows, "licence string, template int, term string, idf double, weight double")
    telling = ", ".join(f"'{t}'" for t in telling_terms())
    whole = f"case when path rlike '{LICENCE_FILE}' then array(text) else cast(array() as array<string>) end"
    # The outer form keeps Spark from inferring a filter on the array and so computing it twice.
    sentence = SENTENCE.encode("unicode_escape").decode().replace("\\", "\\\\")
    units = files.select("file_id", F.posexplode_outer(F.expr(f"concat(split(text, '\\n'), split(text, '{sentence}'), {whole})")).alias("unit", "line"))
    termed = units.select("file_id", "unit", F.expr(_terms_sql("line")).alias("terms")).where(F.expr(f"arrays_overlap(terms, array({telling}))"))
    # Written: norms and products read it, and it is small.
    counted = materialize(termed.select("file_id", "unit", F.explode_outer("terms").alias("term")).groupBy("file_id", "unit", "term").agg(F.count("*").alias("tf")))
    idf = F.broadcast(weights.select("term", "idf").distinct())
    weighted = counted.join(idf, "term", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(unknown)))
    norms = weighted.groupBy("file_id", "unit").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = weighted.join(F.broadcast(weights.select("licence", "template", "term", "weight")), "term").groupBy("file_id", "unit", "licence", "template").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    scored = dots.join(norms, ["file_id", "unit"]).withColumn("score", F.round(F.col("dot") / F.col("norm"), 6)).where(F.col("score") >= THRESHOLD)
    best = scored.groupBy("file_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "licence")).alias("b"))
    own = materialize(best.select("file_id", "b.licence", (-F.col("b.s")).alias("score")))
    discard(counted)
    return own


def scan(files: DataFrame) -> DataFrame:
    """files (file_id, path, text) -> (file_id, path, licence, score, inherited_from); score is null and inherited_from set where inherited."""
    directory = F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).otherwise(F.when(F.col("path").isNotNull(), F.lit("")))
    placed = files.select("file_id", "path", directory.alias("dir"), F.col("path").rlike(LICENCE_FILE).alias("is_licence"))
    own = own_licences(files)
    marked = placed.join(own, "file_id", "left")
    # Of several licence files in a directory the best score counts, then the first name.
    stated = marked.where("is_licence and licence is not null").groupBy("dir").agg(F.min(F.struct((-F.col("score")).alias("s"), "licence")).alias("b")).select(F.col("dir").alias("ancestor"), F.col("b.licence").alias("dir_licence"))
    ancestors = F.expr("transform(sequence(0, size(split(dir, '/'))), i -> array_join(slice(split(dir, '/'), 1, i), '/'))")
    climbing = placed.select("dir").where("dir is not null").distinct().select("dir", F.explode(F.array_distinct(ancestors)).alias("ancestor"))
    nearest = climbing.join(stated, "ancestor").groupBy("dir").agg(F.max(F.struct(F.length("ancestor").alias("n"), "ancestor", "dir_licence")).alias("a"))
    inherited = nearest.select("dir", F.col("a.ancestor").alias("ancestor"), F.col("a.dir_licence").alias("dir_licence"))
    return marked.join(inherited, "dir", "left").select(
        "file_id",
        "path",
        F.coalesce("licence", "dir_licence").alias("licence"),
        "score",
        F.when(F.col("licence").isNull(), F.col("ancestor")).alias("inherited_from"),
    )


def derived_files(docs: DataFrame) -> DataFrame:
    """The documents table has no paths: source and language are folders, and each hundred of doc_ids is a folder.

    Documents of a multiple of 20 are named LICENSE and stand by turns in the source's, the language's or the inner folder.
    """
    inner = "concat('d', doc_id div 100 % 50)"
    path = f"case when doc_id % 20 > 0 then concat_ws('/', source, lang, {inner}, concat(doc_id, '.txt')) when doc_id div 20 % 60 = 0 then concat_ws('/', source, concat('LICENSE.', doc_id)) when doc_id div 20 % 20 = 1 then concat_ws('/', source, lang, concat('LICENSE.', doc_id)) else concat_ws('/', source, lang, {inner}, concat('LICENSE.', doc_id)) end"
    return docs.select(F.col("doc_id").alias("file_id"), F.expr(path).alias("path"), "text")


def op4_license_scan(spark, sf_dir: str) -> DataFrame:
    """Every document with the licence that holds for it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scan(derived_files(docs)).withColumnRenamed("file_id", "doc_id")


def _values() -> str:
    rows, _ = template_weights()
    return ", ".join(f"('{n}', {k}, '{t}', {i!r}::double, {w!r}::double)" for n, k, t, i, w in rows)


_IGNORED = ", ".join(f"'{w}'" for w in ["", *IGNORED])
ORACLE_SQL = f"""
with w(licence, template, term, idf, weight) as (values {_values()}),
f as (select doc_id, doc_id % 20 = 0 as lic, dir, dir || '/' || case when doc_id % 20 = 0 then 'LICENSE.' || doc_id else doc_id || '.txt' end as path, text
  from (select *, case when doc_id % 20 = 0 and doc_id // 20 % 60 = 0 then source when doc_id % 20 = 0 and doc_id // 20 % 20 = 1 then source || '/' || lang
    else source || '/' || lang || '/d' || (doc_id // 100 % 50) end as dir from documents)),
us as (select doc_id, string_split(text, chr(10)) || regexp_split_to_array(text, '{SENTENCE}') || case when lic then [text] else [] end as us from f),
u as (select doc_id, unnest(us) as line, unnest(range(len(us))) as unit from us),
t as (select doc_id, unit, unnest(list_filter(list_transform(regexp_split_to_array(lower(line), '[^a-z0-9.]+'), lambda x: trim(x, '.')), lambda x: x not in ({_IGNORED}))) as term from u),
c as (select doc_id, unit, term, count(*) as tf from t group by all),
x as (select c.*, tf * coalesce(i.idf, {template_weights()[1]!r}) as v from c left join (select distinct term, idf from w) i using (term)),
n as (select doc_id, unit, sqrt(sum(v * v)) as norm from x group by all),
d as (select doc_id, unit, licence, template, sum(v * weight) as dot from x join w using (term) group by all),
s as (select doc_id, licence, round(dot / norm, 6) as score from d join n using (doc_id, unit) where round(dot / norm, 6) >= {THRESHOLD}),
own as (select doc_id, licence, score from s qualify row_number() over (partition by doc_id order by score desc, licence) = 1),
m as (select f.doc_id, path, dir, lic, licence, score from f left join own using (doc_id)),
st as (select dir as ancestor, licence as dl from m where lic and licence is not null qualify row_number() over (partition by dir order by score desc, licence) = 1),
near as (select dd.dir, ancestor, dl from (select distinct dir from f) dd join st on dd.dir = ancestor or dd.dir like ancestor || '/%'
  qualify row_number() over (partition by dd.dir order by length(ancestor) desc) = 1)
select doc_id, path, coalesce(licence, dl) as licence, score, case when licence is null then ancestor end as inherited_from
from m left join near using (dir)
"""
