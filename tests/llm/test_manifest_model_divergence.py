"""Merkle manifest, quality model and source divergence against brute force, held-out labels and edge cases."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from minuteflow.llm import op11_manifest, op12_quality_model, op13_divergence

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def sha(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    values = [row.doc_id, row.source, row.lang, row.n_chars, text]
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree_of(nodes):
    """Levels of a tree, plainly."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][k : k + 8]) for k in range(0, len(levels[-1]), 8)])
    return levels


def siblings_of(levels, k):
    """(before, after) on each level below the last."""
    for nodes in levels[:-1]:
        run = nodes[k // 8 * 8 : k // 8 * 8 + 8]
        yield run[: k % 8], run[k % 8 + 1 :]
        k //= 8


def manifest_by_hand(docs):
    def tampered(row):
        if row.text is None or row.doc_id is None or zlib.crc32(str(row.doc_id).encode()) % 3:
            return row.text
        return re.sub("[A-Z]", lambda m: m[0].lower(), row.text)

    groups = defaultdict(list)
    for row in docs:
        groups[row.lang].append((row.doc_id is not None, row.doc_id or 0, leaf(row, row.text), leaf(row, tampered(row)), row))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    levels = {g: tree_of([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in names}
    top = tree_of([levels[g][-1][0] for g in names])
    out = []
    for place, g in enumerate(names):
        for k, (_, _, own, candidate, row) in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            path = [*siblings_of(levels[g], k), *siblings_of(top, place)]
            node = candidate
            for before, after in path:
                node = sha(*before, node, *after)
            out.append((row.doc_id, own, levels[g][-1][0], top[-1][0], sha(*[x for before, after in path for x in before + after]), node, node == top[-1][0]))
    return out


@pytest.mark.parametrize("sizes", [{"en": 1}, {"en": 8, None: 1, "": 9}, {"de": 513, "en": 70, "é": 2, None: 65}, {f"l{k}": 1 + k % 3 for k in range(70)}])
def test_manifest_equals_brute_force(spark, tmp_path, sizes):
    rnd = random.Random(7)
    rows = []
    for lang, n in sizes.items():
        for _ in range(n):
            text = rnd.choice([None, "", "Große Räder Rollen", "plain", "Only A-Z Changes ÀÉ", f"Text {rnd.random()}"])
            rows.append((rnd.choice([None, *range(40)] if n < 100 else range(100_000)), text, lang, rnd.choice([None, "a", "b:c"]), rnd.choice([None, 3])))
    rows += rows[:2]
    docs = spark.createDataFrame(rows, DOCS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = op11_manifest.op11_merkle_manifest(spark, str(tmp_path)).collect()
    want = manifest_by_hand(docs.collect())
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert not any(r.verified for r in got if r.folded_root != r.root)


def test_manifest_of_an_empty_table_clashing_columns_and_long_texts(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    assert op11_manifest.op11_merkle_manifest(spark, str(tmp_path)).collect() == []
    docs = spark.createDataFrame([(k, "Ab" * 300_000 if k == 1 else "x", "en", "s", 1) for k in range(9)], DOCS)
    odd = docs.withColumns({c: F.lit(5) for c in ("tree", "pos", "n", "digest", "key", "candidate", "left", "group", "_id", "piece")})
    plain, other = (op11_manifest.build(d).proofs().orderBy("key").collect() for d in (docs, odd))
    assert plain == other and len(plain) == 9 and all(r.folded_root == r.root for r in plain)


def test_a_parent_resumes_its_states():
    children = [sha(str(k)).encode() for k in range(5)]
    parent = op11_manifest.Parent(children)
    for slot in range(5):
        changed = [*children[:slot], b"0" * 64, *children[slot + 1 :]]
        assert parent.fold(slot, b"0" * 64) == hashlib.sha256(b"".join(changed)).hexdigest().encode()
    assert parent.fold(2, children[2]) == parent.digest


def divergence_by_hand(docs, min_docs=3, top=200):
    words = [(r.lang or "", r.source or "", [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall("[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+", r.text or "")]) for r in docs]
    groups = {(lang, source) for lang, source, _ in words}
    seen, counts = defaultdict(Counter), defaultdict(Counter)
    for lang, source, ws in words:
        seen[lang].update(set(ws))
        counts[lang, source].update(ws)
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in seen[lang].items() if n >= min_docs]

        def shares(count):
            n = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 1) // (n + len(kept)) for t in kept}

        own = {s: shares(counts[lang, s]) for g, s in groups if g == lang}
        whole = shares(sum((counts[lang, s] for s in own), Counter()))
        for s in own:
            pairs = [(o, sum((own[s][t] - own[o][t]) ** 2 // own[o][t] for t in kept)) for o in own if o != s]
            terms = [(t, (own[s][t] - whole[t]) ** 2 // whole[t]) for t in kept if counts[lang, s][t] and own[s][t] > whole[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                for rank, (item, value) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most], 1):
                    out.append((lang, s, part, item, value, rank))
    return out


@pytest.fixture()
def sources(spark):
    rnd = random.Random(3)
    vocabulary = [f"{a}{b}" for a in ("Tür", "house", "été", "z") for b in ("", "x", "yy", "Q")]
    rows = [(k, " ".join(rnd.choice(vocabulary[: 4 + k % 13]) + rnd.choice(["", ",", "1x", "\x00", "_"]) for _ in range(rnd.randrange(1, 60))), rnd.choice(["en", "de", None]), rnd.choice(["s1", "s2", "S3", None, ""]), 1) for k in range(150)]
    rows += [(900, None, "en", "silent", 1), (901, "", "lone", "only", 1), (902, "one two", "pair", "a", 1), (903, "three", "pair", "b", 1), *rows[:3]]
    return spark.createDataFrame(rows, DOCS)


def test_divergence_equals_brute_force(spark, sources, tmp_path):
    sources.withColumn("term", F.lit(1)).withColumn("n", F.lit(1)).write.parquet(f"{tmp_path}/documents.parquet")
    got = op13_divergence.op13_source_divergence(spark, str(tmp_path)).collect()
    want = divergence_by_hand(sources.collect())
    assert sorted(map(tuple, got)) == sorted(want)
    assert ("pair", "b", 0) in {(r.part, r.item, r.value) for r in got if r.lang == "pair"} and not [r for r in got if r.lang == "lone"]


def test_divergence_does_not_depend_on_flushes_and_chunks(sources, monkeypatch):
    want = sorted(map(tuple, op13_divergence.divergences(sources, top=2).collect()))
    monkeypatch.setattr(op13_divergence, "FLUSH", 3)
    monkeypatch.setattr(op13_divergence, "CHUNK", 5)
    assert sorted(map(tuple, op13_divergence.divergences(sources, top=2).collect())) == want
    assert want == sorted(divergence_by_hand(sources.collect(), top=2))


def test_terms_are_counted_from_the_texts_bytes(monkeypatch):
    batch = pa.RecordBatch.from_pydict({"lang": ["en", "en", "en"], "source": ["s", "s", "t"], "text": ["Ein ein Été", "ein", ""]})
    for flush in (1, 100):
        monkeypatch.setattr(op13_divergence, "FLUSH", flush)
        found = Counter()
        for part in op13_divergence._counted(iter([batch])):
            for row in part.to_pylist():
                found[row["lang"], row["source"], row["term"], "docs"] += row["docs"]
                found[row["lang"], row["source"], row["term"], "n"] += row["n"]
        assert found == {("en", "s", "ein", "docs"): 2, ("en", "s", "ein", "n"): 3, ("en", "s", "Été", "docs"): 1, ("en", "s", "Été", "n"): 1}


def test_shares_are_exact_for_large_counts(spark):
    cases = [(0, 1), (7, 10), (10**15, 10**15 + 12345), (9 * 10**15 - 2, 9 * 10**15 - 1), (123_456_789_012_345, 8_999_999_999_999_999)]
    got = spark.createDataFrame(cases, "c bigint, t bigint").select("c", "t", F.expr(op13_divergence.share_sql("c", "t")).alias("p")).collect()
    assert [r.p for r in got] == [1 + 10**9 * (c + 1) // t for c, t in cases]


def test_divergence_of_an_empty_table_and_terms(spark):
    assert op13_divergence.divergences(spark.createDataFrame([], DOCS)).collect() == []
    assert op13_divergence.terms_of("Don't STOP\x7f\x00Été_zwei3drei") == ["don".encode(), b"t", b"stop", "Été".encode(), b"zwei", b"drei"]


DATA = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def classified(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    scores, model = op12_quality_model.classify(docs, labels)
    return scores.toPandas().set_index("doc_id"), labels.toPandas().set_index("doc_id"), model


def test_quality_of_held_out_documents(spark, classified):
    scores, labels, model = classified
    both = scores.join(labels, how="inner")
    held = both[both.held_out]
    assert len(held) > 1000 and (held.predicted == held.quality).mean() >= 0.99
    worst_good, best_bad = held[held.quality == 1].score.quantile(0.01), held[held.quality == 0].score.quantile(0.99)
    assert worst_good > best_bad and scores.score.between(0, 1).all()
    assert set(scores.index[scores.held_out]) == {k for k in scores.index if zlib.crc32(str(k).encode()) % 3 == 1}
    assert abs(model.prior - labels.quality.mean()) < 0.05
    assert op12_quality_model.Model.loads(model.dumps()) == model


def test_quality_reads_trusted_positives_only(spark, classified):
    scores, _, _ = classified
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    other = labels.withColumn("quality", F.when(op12_quality_model.held_out(), 1 - F.col("quality")).otherwise(F.col("quality"))).where(op12_quality_model.held_out() | (F.col("quality") == 1))
    again = op12_quality_model.classify(docs, other)[0].toPandas().set_index("doc_id")
    assert np.allclose(again.score.sort_index(), scores.score.sort_index())


def test_quality_edge_cases(spark, tmp_path):
    rows = [(1, None, "en", "a", 0), (None, "some words here", "en", "a", 0), (2, "", "en", "a", 0), (3, "word " * 200_000, "en", "a", 0), (4, "the river and the stone", None, None, None), (4, "the river and the stone", None, None, None)]
    docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(1) for c in ("x", "score", "positive", "half", "held_out")})
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    none.write.parquet(f"{tmp_path}/labels.parquet")
    got = op12_quality_model.op12_quality_classifier(spark, str(tmp_path)).collect()
    assert len(got) == 6 and {r.score for r in got} == {0.5} and {r.predicted for r in got} == {1}
    few = spark.createDataFrame([(4, 1, 0), (3, 0, 0), (None, 1, 0), (77, 1, 0), (2, 1, 0), (2, 0, 0), (2, None, 0)], none.schema)
    scored = op12_quality_model.classify(docs, few)[0].collect()
    assert len(scored) == 6 and len({r.score for r in scored if r.doc_id == 4}) == 1 and all(0 <= r.score <= 1 for r in scored)
    assert [r.doc_id for r in op12_quality_model.trusted(few).orderBy("doc_id").collect()] == [k for k in (4, 77) if zlib.crc32(str(k).encode()) % 3 != 1]
    assert op12_quality_model.classify(docs.limit(0), few)[0].count() == 0


def test_risk_is_kept_from_going_negative():
    rnd = np.random.default_rng(0)
    hot = np.ones((400, 9))
    hot[:, :8] = rnd.random((400, 8)) < 0.5
    positive = hot[:300]
    unlabelled, trusted = hot.T @ hot, positive.T @ positive

    def negative(w, prior):
        return ((1 + hot @ w) ** 2).mean() / 4 - prior * ((1 + positive @ w) ** 2).mean() / 4

    for prior in (0.5, 0.99):
        w = op12_quality_model.minimise(unlabelled, trusted, prior)
        su, sp = unlabelled / 400, trusted / 300
        free = np.linalg.solve(su + (op12_quality_model.RIDGE + op12_quality_model.FEW / 300) * np.eye(9), 2 * prior * sp[-1] - su[-1])
        risk = lambda v: max(0.0, negative(v, prior)) + prior * ((1 - positive @ v) ** 2).mean() / 4
        assert negative(w, prior) > -1e-3 or risk(w) <= risk(free) + 1e-9


def test_prior_is_the_least_ratio():
    bins = np.zeros((2, 10))
    bins[0], bins[1] = [4000, 0, 0, 0, 0, 0, 0, 0, 3000, 3000], [0, 0, 0, 0, 0, 0, 0, 0, 5000, 5000]
    assert abs(op12_quality_model.estimated_prior(bins[0], bins[1]) - 0.6) < 0.02
