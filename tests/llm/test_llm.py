"""The operators of the training-data pipeline on small fixtures: edge cases and brute force."""

from __future__ import annotations

import collections
import hashlib
import random
import re

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from minuteflow.llm import bwt, op1_html, op2_simhash, op3_pii, op4_licenses, op5_quality, op6_urls, op7_suffix_dedup, op8_chat, op9_decontaminate, op10_mix, pipeline
from minuteflow.llm import bitmap as bitmaps
from minuteflow.llm.components import connected_components
from minuteflow.llm.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = "the of and to in is it that for on with as was be by at this are or an river stone window garden letter music winter bridge".split()


def prose(seed: int, n: int = 60) -> str:
    rnd = random.Random(seed)
    return " ".join(rnd.choice(WORDS) + str(rnd.randrange(50)) * (rnd.random() < 0.3) for _ in range(n))


def docs(spark, texts, sources=None):
    return spark.createDataFrame([(k, t, "en", (sources or ["a"])[k % len(sources or ["a"])], len(t or "")) for k, t in enumerate(texts)], DOCS)


def saved(spark, tmp_path, frame, name="documents"):
    frame.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("documents", "pages", "benchmark", "conversations"):
        con.sql(f"create view {name} as select * from '{DATA}/{name}.parquet'")
    return con


def rows(frame):
    columns = sorted(frame.columns)
    for c in columns:
        if "date" in str(frame[c].dtype):
            frame[c] = frame[c].dt.date
    frame = frame[columns].astype(object).where(frame[columns].notna(), None)
    return columns, sorted(map(repr, frame.values.tolist()))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    assert rows(QUERIES[name](spark, DATA).toPandas()) == rows(duck.sql(ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, tmp_path, name):
    for table in ("documents", "pages", "benchmark", "conversations", "labels"):
        spark.read.parquet(f"{DATA}/{table}.parquet").limit(0).write.parquet(f"{tmp_path}/{table}.parquet")
    assert QUERIES[name](spark, str(tmp_path)).count() == (1 if name == "op8_chat_format" else 0)


# 1. HTML


def test_html_structure():
    long = "long text here " * 10
    page = f'<body><div id=menu><a>Home</a></div><div class="post"><h1>Title</h1><p>{long}<p>short</p><span class="ad-box">Buy</span><p>{long}</p></div><div class="comments"><p>{long}</p></div><footer>x</footer>'
    assert op1_html.main_text(page) == "\n".join(["Title", long.strip(), "short", long.strip()])


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("<html><head><title>t</title></head><body></body></html>", ""),
        ("<article><p>a &amp;amp; b&nbsp; &#233;</p><p>c<b>d</b>\n e</article><footer>f</footer>", "a &amp; b é\ncd e"),
        ('<article><script>var t="</p>";</script><p title="a>b">x < y</p><form><p>name</p></form></article>', "x < y"),
        ("<nav>menu</nav><article><header><h1>T</h1><p>by me</p></header><p>x</p><aside>s</aside></article><aside>more</aside>", "T\nx"),
        ("<main><p>one<br>two<p>three<div class='share-bar'>tweet</div></main>", "one two\nthree"),
    ],
)
def test_html_cases(page, text):
    assert op1_html.main_text(page) == text


def test_html_without_marks_keeps_short_text():
    assert op1_html.main_text("<h1>Road closed</h1><p>Main Street is closed on Monday.</p>") == "Road closed\nMain Street is closed on Monday."
    long, advert = "long text here " * 10, '<ul class="ad"><li>Buy</li><li>this</li><li>now</li></ul>'
    page = f"<h2>Heading</h2><p>one</p><p>two</p><p>{long}</p>{advert}<p>Short end.</p>"
    assert op1_html.main_text(page) == "\n".join(["Heading", "one", "two", long.strip(), "Short end."])


def test_html_inline_parts_do_not_split_a_block():
    assert op1_html.main_text('<p>Hello <svg/> world <span class="share">x</span> end</p>') == "Hello world end"
    assert op1_html.main_text("<div><p>Short article text.</p></div>") == "Short article text."
    assert op1_html.main_text("<article><p>one <button>b</button> two<p><span class=ad>x<p>three</article>") == "one two\nthree"


def test_html_surges_and_dives_decide(monkeypatch):
    links = "".join(f"<div><a href=x>Link number {k}</a></div>" for k in range(5))
    text = "long text here " * 10
    page = f"{links}<h1><a>T</a></h1><p>{text}</p>{links}<p>Corp 2020</p>"
    assert op1_html.main_text(page) == f"T\n{text.strip()}"
    # In a marked article nothing but structure takes anything away.
    assert op1_html.main_text(f"<article>{page}</article>").count("Link number") == 10
    assert op1_html.main_text(links) == "\n".join(f"Link number {k}" for k in range(5))
    monkeypatch.setattr(op1_html, "located", lambda lengths, sizes=None: [True] * len(lengths))
    assert op1_html.main_text(page) != f"T\n{text.strip()}"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<article><p>Keep <span class="ad">BUY <span>now</span> cheap</span> end</p></article>', "Keep end"),
        ('<p>Keep <span class="ad">BUY <span>now</span> cheap</span> end</p>', "Keep end"),
        ('<article><p>x</p><span class="share">Tweet <span>this</span> page</span></article>', "x"),
        ('<article><p>a <b class="comment">no <b>not</b> this</b> b</p></article>', "a b"),
        ("<article><p><b>one <i>two</b> three</i> four</p><p>five</p></article>", "one two three four\nfive"),
        ("<article><span><div>in</span> still</div></article>", "in still"),
    ],
)
def test_html_inline_elements_nest(page, text):
    assert op1_html.main_text(page) == text


def test_html_marked_articles_keep_links_and_last_lines():
    long = ("long text here " * 14).strip()
    sources = "".join(f"<p><a href=x>Source {k}</a></p>" for k in range(3))
    want = [long, "Source 0", "Source 1", "Source 2", "Closing short."]
    assert op1_html.main_text(f"<nav>n</nav><article><p>{long}</p>{sources}<p>Closing short.</p></article><footer>f</footer>") == "\n".join(want)
    assert op1_html.main_text(f"<article><p>{long}</p><ul>{sources.replace('p>', 'li>')}</ul><p>Closing short.</p></article>") == "\n".join(want)
    # Without marks a list of links between two long stretches stays, one that outweighs them goes.
    assert "Source 1" in op1_html.main_text(f"<p>{long}</p>{sources}<p>{long}</p>")
    assert "Source 1" not in op1_html.main_text(f"<p>{long}</p>{sources * 30}<p>{long}</p>")


def test_html_is_linear_in_unclosed_elements():
    page = "<article>" + "<b>" * 50_000 + "<i></u>" * 50_000 + "<p>x</p>" * 50_000 + "</article>"
    assert op1_html.main_text(page).count("x") == 50_000


def test_html_random_pages_against_a_tree():
    rnd = random.Random(11)

    def node(depth):
        if depth == 0 or rnd.random() < 0.3:
            return rnd.choice(["alpha", "beta ", " gamma", "x &amp; y", "\n"])
        name = rnd.choice(["p", "div", "ul", "li", "span", "b", "i", "section", "nav", "script", "h2"])
        if name == "p":
            return (name, "", [node(0) if rnd.random() < 0.5 else ("b", "", [node(0)]) for _ in range(2)])
        return (name, rnd.choice(["", "", "", "ad", "share-bar", "story"]), [node(depth - 1) for _ in range(rnd.randrange(4))] if name != "script" else ["var x;"])

    def markup(n):
        return n if isinstance(n, str) else f"<{n[0]}{f' class={n[1]!r}' if n[1] else ''}>{''.join(map(markup, n[2]))}</{n[0]}>"

    def parts(n):
        return not isinstance(n, str) and (n[0] not in ("span", "b", "i", "script") or any(map(parts, n[2])))

    def blocks(n, out, block):
        if isinstance(n, str):
            out[-1] += n.replace("&amp;", "&")
        elif n[1] in ("ad", "share-bar") or n[0] in ("nav", "script"):
            if parts(n):
                out.append("")
        else:
            split = n[0] not in ("span", "b", "i")
            out += [""] * split
            for child in n[2]:
                blocks(child, out, block)
            out += [""] * split

    def has_nested(n, names=()):
        """A p in a p and a li in a li close the outer one, which the plain tree doesn't know."""
        if isinstance(n, str):
            return False
        block = names[-1:] if n[0] in ("span", "b", "i") else (n[0],)
        return (bool(names) and n[0] not in ("span", "b", "i") and (names[-1] == "p" or names[-1] == n[0] == "li")) or any(has_nested(c, block or names) for c in n[2])

    seen = 0
    for _ in range(3000):
        tree = ("section", "", [node(4) for _ in range(3)])
        if has_nested(tree):
            continue
        out = [""]
        blocks(tree, out, None)
        seen += 1
        want = "\n".join(t for t in (" ".join(b.split()) for b in out) if t)
        assert op1_html.main_text(f"<article>{markup(tree)}</article>") == want, markup(tree)
    assert seen > 1000


def test_html_windows_against_brute_force():
    def brute(lengths, w=3, surge=80):
        n, w = len(lengths), min(w, len(lengths))
        windows = [range(k, k + w) for k in range(n - w + 1)]
        dived = {i for win in windows for i in win if sum(lengths[j] for j in win) == 0}
        areas = []
        for i in range(n):
            if i not in dived:
                if i - 1 in dived or i == 0:
                    areas.append([])
                areas[-1].append(i)
        good = [a for a in areas if any(sum(lengths[j] for j in win) >= surge for win in windows if set(win) & set(a))]
        return [not areas or any(i in a for a in good or areas) for i in range(n)]

    rnd = random.Random(4)
    for _ in range(2000):
        lengths = [rnd.choice([0, 0, 0, 0, 5, 30, 70, 200]) for _ in range(rnd.randrange(30))]
        assert op1_html.located(lengths) == brute(lengths)


def test_html_rows(spark):
    page = "<article><p>x &amp; y</p></article>"
    frame = spark.createDataFrame([(1, page, "old"), (1, page, "old"), (2, None, "old"), (3, "<p>" + "word " * 200_000, "old")], "page_id bigint, html string, text string")
    got = sorted((r["page_id"], r["text"][:5], r["n_chars"]) for r in op1_html.extract(frame).collect())
    assert got == [(1, "x & y", 5), (1, "x & y", 5), (2, "", 0), (3, "word ", 999_999)]


# 2. SimHash


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in ([" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)])]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_against_brute_force(spark):
    texts = [None, "", " \t", "One two", "ÉCOLE one two"]
    for k in range(40):
        base = prose(k, 200)
        texts += [base] + [base.replace(" ", "  ", j).upper() if j % 2 else base + " end" * j for j in range(k % 4)]
    frame = docs(spark, texts)
    got = {r["doc_id"]: r for r in op2_simhash.near_duplicates(frame.unionByName(frame.where("doc_id < 3"))).distinct().collect()}
    prints = [brute_fingerprint(t) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    for k in range(len(texts)):
        assert got[k]["fp"] % 2**64 == prints[k]
        assert got[k]["component_id"] == find(k)


def test_simhash_blocks_and_thresholds(spark, monkeypatch):
    rnd = random.Random(5)
    base = [rnd.getrandbits(64) for _ in range(3)]
    values = {b ^ sum(1 << rnd.randrange(64) for _ in range(rnd.randrange(4))) for b in base for _ in range(60)} | {rnd.getrandbits(64) for _ in range(50)}
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    nodes = spark.createDataFrame([(v,) for v in signed], "fp bigint")
    monkeypatch.setattr(op2_simhash, "BLOCK", 16)
    expected = None
    for plan in ([(list(range(0, 22)), 1), (list(range(22, 43)), 1), (list(range(43, 64)), 0)], [(list(range(k, 64, 5)), 0) for k in range(5)]):
        edges = op2_simhash.links(nodes, plan)
        roots = {r["node"]: r["root"] for r in connected_components(edges).collect()}
        groups = sorted(sorted(g) for g in by_root(signed, roots))
        expected = expected or groups
        assert groups == expected
    brute = {v: v for v in signed}
    for _ in range(len(signed)):
        new = {a: min(brute[b] for b in signed if ((a ^ b) & (2**64 - 1)).bit_count() <= 4) for a in signed}
        if new == brute:
            break
        brute = new
    assert sorted(sorted(g) for g in by_root(signed, brute)) == expected


def by_root(nodes, roots):
    groups = collections.defaultdict(list)
    for n in nodes:
        groups[roots.get(n, n)].append(n)
    return groups.values()


def test_allocation_sums_to_radius():
    for m in (3, 4, 5):
        cost, thresholds = op2_simhash.allocate([1e6] * m, [64 // m] * m, 1e5, 4)
        assert sum(thresholds) == 4 - m + 1 and cost > 0


def test_one_of_each_group_and_id(spark):
    a, b, c = prose(1, 200), prose(2, 200), prose(3, 200)
    given = [(1, a), (1, b), (2, a), (2, a), (None, a), (None, c), (None, c), (5, c.upper()), (6, None), (7, ""), (8, prose(4, 60_000)), (8, prose(4, 60_000))]
    frame = spark.createDataFrame([(i, t, "en", "s", 0, k) for k, (i, t) in enumerate(given)], DOCS + ", fp int").withColumn("_k", F.lit("k"))
    out = op2_simhash.one_of_each(frame)
    assert out.columns == frame.columns
    got = sorted((r["doc_id"], (r["text"] or "")[:20]) for r in out.collect())
    assert got == sorted([(1, a[:20]), (1, b[:20]), (5, c.upper()[:20]), (6, ""), (8, prose(4, 60_000)[:20])])


# 3. Personal data


def brute_spans(text):
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m.group())
        if 14 <= len(digits) <= 19 and op3_pii.luhn(digits):
            found.append((m.start(), 2, m.end()))
    found += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return sorted(found)


def test_pii_base_against_brute_force():
    rnd = random.Random(1)
    for _ in range(3000):
        text = "".join(rnd.choice("a@.+1 2(3)-4567890.5%_é\n") for _ in range(70))
        assert op3_pii.detect(text) == brute_spans(text)


@pytest.mark.parametrize(
    ("text", "spans"),
    [
        ("write bob (at) mail [dot] example (dot) com now", "email:6:43"),
        ("раssа@ехаmple.com", "email:0:17"),
        ("４３３７１６６５９８４６４３９９ card", "card:0:16"),
        ("plus four nine one five one two three four five six seven", "phone:0:57"),
        ("look at the dot in here, one two three", ""),
        ("a.b@c.de and bob at x dot org", "email:0:8,email:13:29"),
    ],
)
def test_pii_disguises(text, spans):
    base = op3_pii.detect(text)
    assert op3_pii.named(sorted({*base, *op3_pii.added(text, base)})) == spans


@pytest.mark.parametrize(
    ("text", "spans"),
    [
        ("call plus 44 20 7946 0958", "phone:5:25"),
        ("4111 1111 1111 one one one one", "card:0:30"),
        ("+44 20 7946 zero nine 58", "phone:0:24"),
        ("bob (at) host\tdot\norg", "email:0:21"),
        ("+44 20 7946 \u017f\u0131x n\u0130ne 58", "phone:0:23"),
    ],
)
def test_pii_disguises_without_other_signs(text, spans):
    base = op3_pii.detect(text)
    assert op3_pii.named(sorted({*base, *op3_pii.added(text, base)})) == spans


def test_pii_gate_loses_nothing(monkeypatch):
    rnd = random.Random(8)
    parts = [*op3_pii.DIGIT_WORDS, "plus", " at ", " dot ", "\tDOT\n", "(at)", "[ Punkt ]", "a", "com", "44", "7", "+", "-", " ", " ", "\u0430", "\u017fix", "n\u0131ne", "\u00e9"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 14))) for _ in range(20_000)]
    gated = [op3_pii.added(t, op3_pii.detect(t)) for t in texts]
    monkeypatch.setattr(op3_pii, "disguised", lambda text: True)
    assert gated == [op3_pii.added(t, op3_pii.detect(t)) for t in texts]


def test_pii_query_and_mask(spark, tmp_path):
    frame = docs(spark, [None, "", "a@b.co", "x" * 200_000 + " 1.2.3.4"])
    got = {r["doc_id"]: r for r in op3_pii.op3_pii_spans(spark, saved(spark, tmp_path, frame)).collect()}
    assert got[0]["spans"] == got[1]["spans"] == "" and got[0]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert (got[2]["n_email"], got[3]["n_ip"], got[3]["spans"]) == (1, 1, "ip:200001:200008")
    clean = {r["doc_id"]: r for r in op3_pii.without_pii(frame).collect()}
    assert clean[2]["text"] == "[EMAIL]" and clean[2]["n_chars"] == 7 and clean[0]["text"] is None


# 4. Licences


def test_license_inheritance(spark):
    files = [(1, "a/LICENSE", "Released under the MIT License."), (2, "a/b/x.txt", "nothing"), (3, "a/b/y.txt", "intro\nLicensed under the Apache License, Version 2.0."), (4, "c/z.txt", None), (5, None, "Released under the MIT License."), (6, "top.txt", "licence talk in the river garden window")]
    got = {r["file_id"]: (r["licence"], r["inherited_from"]) for r in op4_licenses.scan(spark.createDataFrame(files, "file_id bigint, path string, text string")).collect()}
    assert got == {1: ("MIT", None), 2: ("MIT", "a"), 3: ("Apache-2.0", None), 4: (None, None), 5: ("MIT", None), 6: (None, None)}


def test_license_units(spark):
    header = "// Licensed under the Apache\n// License, Version\n// 2.0 (the License); you may not use\n// this file except in compliance with the License.\n\nint x;"
    files = [(1, "a.c", "CC BY-NC 4.0"), (2, "b.c", "Released under MIT."), (3, "c.c", header), (4, "d.c", "We like rivers. Copyright 2020 Example Corp. Released under the MIT License."), (5, "e.c", "word " * 100_000 + ". Released under the MIT License. " + "word " * 1000), (6, "f.c", ""), (6, "f.c", "")]
    frame = spark.createDataFrame(files, "file_id bigint, path string, text string").withColumn("term", F.lit("x")).withColumn("licence", F.lit("y"))
    got = sorted((r["file_id"], r["licence"]) for r in op4_licenses.scan(frame).collect())
    assert got == [(1, "CC-BY-NC-4.0"), (2, "MIT"), (3, "Apache-2.0"), (4, "MIT"), (5, "MIT"), (6, None), (6, None)]


def test_telling_terms_lose_nothing():
    rnd = random.Random(5)
    weights, unknown = op4_licenses.template_weights()
    idf, telling = {r[2]: r[3] for r in weights}, set(op4_licenses.telling_terms())
    words = [*idf, "river", "stone"]
    for _ in range(5000):
        k, name = rnd.randrange(len(op4_licenses.TEMPLATES)), None
        unit = collections.Counter([w for w in op4_licenses.terms(op4_licenses.TEMPLATES[k][1]) if rnd.random() < 0.6] + [rnd.choice(words) for _ in range(rnd.randrange(4))])
        norm = sum((n * idf.get(w, unknown)) ** 2 for w, n in unit.items()) ** 0.5
        best = max((sum(unit[r[2]] * r[3] * r[4] for r in weights if r[1] == j) / norm for j in range(len(op4_licenses.TEMPLATES))), default=0) if norm else 0
        assert best < op4_licenses.THRESHOLD or telling & set(unit)


# 5. Quality


def test_quality_cases(spark):
    texts = [None, "", "one two three", prose(1), " ".join(["the red ring is in it"] * 20), prose(2) + "\n" + "a line\n" * 3, "### $$$ " * 40 + prose(3, 20)]
    frame = docs(spark, texts).withColumnRenamed("lang", "n_words")
    got = {r["doc_id"]: r for r in op5_quality.quality(frame).collect()}
    assert [got[k]["base_failed"] for k in range(5)] == [True, True, True, False, True]
    assert [got[k]["kept"] for k in range(7)] == [False, False, False, True, False, True, False]
    assert got[5]["n_dup_lines"] == 2 and got[4]["n_repeat_words"] == 120
    kept = op5_quality.keep_documents(frame)
    assert kept.columns == frame.columns and {r["doc_id"] for r in kept.collect()} == {3, 5}


def test_quality_keeps_odd_columns_and_long_texts(spark):
    frame = docs(spark, [prose(1, 60), "river " + prose(2, 150_000), prose(1, 60)]).withColumn("_w", F.lit("w")).withColumn("_row", F.lit("r")).withColumn("kept", F.lit("mine"))
    got = op5_quality.quality(frame).collect()
    assert {(r["_w"], r["_row"], r["base_failed"]) for r in got} == {("w", "r", False)} and {r["kept"] for r in got} <= {True, False}
    kept = op5_quality.keep_documents(frame)
    assert kept.columns == frame.columns and {r["kept"] for r in kept.collect()} == {"mine"} and kept.count() == 3


# 6. URLs


def test_url_filter(spark):
    entries = spark.createDataFrame([("l", "bad.com", "add", "2024-01-02"), ("l", "bad.com", "add", "2024-01-03"), ("l", "bad.com", "remove", "2024-01-05"), ("l", "ok.com/x", "add", "2024-01-01"), ("m", None, "add", "2024-01-01")], "list string, pattern string, action string, entry_date string").selectExpr("list", "pattern", "action", "cast(entry_date as date) as entry_date")
    urls = [("http://a.bad.com/p", "2024-01-01"), ("http://a.bad.com/p", "2024-01-02"), ("http://BAD.com:80?q", "2024-01-05"), ("https://u:p@ok.com/x/y?z", "2024-02-01"), ("https://ok.com/xy", "2024-02-01"), (None, "2024-02-01"), ("nonsense", "2024-02-01"), ("http://bad.com", None)]
    captures = spark.createDataFrame([(k, u, d) for k, (u, d) in enumerate(urls)], "page_id bigint, url string, d string").selectExpr("page_id", "url", "cast(d as date) as fetch_date")
    got = {r["page_id"]: r["blocked"] for r in op6_urls.filter_captures(captures.unionByName(captures), entries).collect()}
    assert got == {0: False, 1: True, 2: False, 3: True, 4: False, 5: False, 6: False, 7: False}


def test_url_ties(spark):
    entries = spark.sql("select * from values ('b', 'x.com', 'add', date'2024-01-01'), ('a', 'x.com', 'add', date'2024-01-01'), ('a', 'y.x.com', 'add', date'2024-01-01'), ('a', 'z.com', 'add', date'2024-01-01'), ('a', 'z.com', 'remove', date'2024-01-01') as t(list, pattern, action, entry_date)")
    captures = spark.sql("select *, 'mine' as list, 'mine' as _key from values (1, 'http://y.x.com/p'), (2, 'http://x.com/'), (2, 'http://x.com/'), (3, 'http://z.com/') as t(page_id, url)").withColumn("fetch_date", F.expr("date'2024-02-01'"))
    got = sorted((r["page_id"], r["list"], r["pattern"]) if r["blocked"] else (r["page_id"],) for r in op6_urls.filter_captures(captures, entries).collect())
    assert got == [(1, "a", "y.x.com"), (2, "a", "x.com"), (2, "a", "x.com"), (3,)]


# 7. Repeated passages


def test_bwt_merge_against_sorting():
    rnd = random.Random(2)
    for _ in range(30):
        shards = [np.array([c for _ in range(rnd.randint(1, 4)) for c in [*(rnd.randint(1, 3) for _ in range(rnd.randint(0, 9))), 0]]) for _ in range(3)]
        orders = [bwt.shard_order(s, 64) for s in shards]
        interleave, common = bwt.merge([bwt.transform(s, o) for s, o in zip(shards, orders)], 64)
        flat = np.concatenate(shards).tolist()
        suffix = bwt.merged_suffixes(orders, interleave).tolist()

        def of(p):
            return flat[p : flat.index(0, p)]

        assert [of(p) for p in suffix] == sorted((of(p) for p in range(len(flat))))
        for k in range(1, len(suffix)):
            a, b = of(suffix[k - 1]), of(suffix[k])
            assert common[k] == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_repeated_starts_against_brute_force():
    rnd = random.Random(3)
    for _ in range(25):
        base = bytes(rnd.choice(b"ab c") for _ in range(300))
        contexts = []
        for _ in range(rnd.randint(1, 12)):
            a = rnd.randint(0, 100)
            part = bytearray(base[a : a + rnd.randint(40, 120)])
            if rnd.random() < 0.6:
                part[rnd.randrange(len(part))] = 65
            contexts.append(bytes(part))
        starts, weights = [len(c) - 39 for c in contexts], [rnd.choice([1, 1, 2]) for _ in contexts]
        count = collections.Counter()
        for c, n, w in zip(contexts, starts, weights):
            for p in range(n):
                count[c[p : p + 40]] += w
        got = op7_suffix_dedup.repeated_starts(contexts, starts, weights, length=40, symbol=rnd.choice([8, 20, 40]), shards=3)
        assert [g.tolist() for g in got] == [[count[c[p : p + 40]] >= 2 for p in range(n)] for c, n in zip(contexts, starts)]


@pytest.mark.parametrize("together", [op7_suffix_dedup.TOGETHER, 1])
def test_suffix_dedup_against_brute_force(spark, tmp_path, monkeypatch, together):
    monkeypatch.setattr(op7_suffix_dedup, "TOGETHER", together)
    monkeypatch.setattr(op7_suffix_dedup, "PIECE", 700)
    passage, other = prose(9, 80), prose(10, 70)
    texts = [None, "", "short", passage, prose(1) + passage + prose(2), passage, "é" * 300, prose(3) + other + prose(4) + other, prose(5, 400), "ab" * 400, prose(6) + passage[:210] + "é" + passage[210:]]
    got = {r["doc_id"]: r for r in op7_suffix_dedup.op7_suffix_array_dedup(spark, saved(spark, tmp_path, docs(spark, texts))).collect()}
    raw = [(t or "").encode() for t in texts]
    count = collections.Counter(b[i : i + 200] for b in raw for i in range(len(b) - 199))
    for k, b in enumerate(raw):
        gone = bytearray(len(b))
        for i in range(len(b) - 199):
            if count[b[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        left = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        assert (got[k]["n_bytes"], got[k]["n_removed"], got[k]["n_spans"], got[k]["kept_sha256"]) == (len(b), sum(gone), spans, hashlib.sha256(left).hexdigest())


def test_suffix_dedup_of_two_texts_of_one_id_and_very_long_texts(spark, tmp_path):
    passage, base = prose(9, 80), "".join(random.Random(11).choices("abcdefgh ", k=1_300_000))
    texts = [(1, passage), (1, prose(12, 90)), (None, "x" + passage), (None, None), (2, base + "#" + passage), (3, prose(13, 50) + "#" + base[900_000:1_100_000])]
    frame = spark.createDataFrame(texts, "doc_id bigint, text string")
    got = {(r["doc_id"], r["n_bytes"]): r["n_removed"] for r in op7_suffix_dedup.op7_suffix_array_dedup(spark, saved(spark, tmp_path, frame)).collect()}
    size = len(passage.encode())
    assert got == {
        (1, size): size,
        (1, len(texts[1][1].encode())): 0,
        (None, size + 1): size,
        (None, 0): 0,
        (2, 1_300_001 + size): size + 200_000,
        (3, len(texts[5][1].encode())): 200_000,
    }


# 8. Chat


def test_chat_round_trip():
    messages = [("system", "a\\b[INST]"), ("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]"), ("tool]", "x[/TURN"), ("assistant", ""), ("", " ")]
    formatted, spans, texts, rewritten = op8_chat.turn_spans(op8_chat.render, messages)
    assert op8_chat.parse(formatted) == messages and rewritten == []
    assert [op8_chat.unescape(formatted[a:b]) for a, b in texts] == [t for _, t in messages]
    assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:])) and spans[-1][1] == len(formatted)


def test_chat_detects_rewriting():
    def template(messages):
        return "".join(f"<{r}:{t if k == len(messages) - 1 or r == 'user' else t[:1]}>" for k, (r, t) in enumerate(messages))

    _, _, _, rewritten = op8_chat.turn_spans(template, [("user", "hi"), ("assistant", "long answer"), ("user", "q"), ("assistant", "end")])
    assert rewritten == [2]


def test_chat_template_that_rewrites_late(spark):
    def template(messages):
        return "".join(f"<{r}:{t if k == len(messages) - 1 or r == 'user' else t[:1]}>" for k, (r, t) in enumerate(messages))

    turns = [(1, k, "assistant" if k == 100 else "user", f"text {k}") for k in range(150)]
    read = [(r, t) for r, t in (("x", ""),)]
    frame = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string")
    got = op8_chat.format_digests(frame, template, lambda piece: read, lambda text: text).collect()
    assert [r["n_rewrites"] for r in got] == [1]
    assert [r["n_rewrites"] for r in op8_chat.format_digests(frame).collect()] == [0]


@pytest.mark.parametrize(("back", "turns", "seen"), [(100, 600, True), (40, 128, True), (500, 3000, True), (700, 600, False)])
def test_chat_template_that_rewrites_far_back(spark, back, turns, seen):
    def template(messages):
        return "".join(f"<{r}:{t if k + back >= len(messages) else '...'}>" for k, (r, t) in enumerate(messages))

    frame = spark.createDataFrame([(1, k, "user", f"text {k}") for k in range(turns)], "conv_id bigint, turn bigint, role string, text string")
    assert (op8_chat.format_digests(frame, template, lambda piece: [("x", "")], lambda text: text).first()["n_rewrites"] > 0) is seen


def test_chat_exact_way_looks_back_over_all_turns(spark):
    def numbered(messages):
        return "".join(f"<{k}:{t}>" for k, (_, t) in enumerate(messages))

    def rewriting(messages):
        return "".join(f"<{t if k + 100 >= len(messages) else '...'}>" for k, (_, t) in enumerate(messages))

    turns = [("user", f"text {k}") for k in range(128)]
    frame = spark.createDataFrame([(1, k, *turn) for k, turn in enumerate(turns)], "conv_id bigint, turn bigint, role string, text string")
    chat = (lambda piece: [("x", "")], lambda text: text)
    assert op8_chat.format_digests(frame, numbered, *chat, exact=True).first()["formatted_chars"] == len(numbered(turns))
    assert op8_chat.format_digests(frame, rewriting, *chat, exact=True).first()["n_rewrites"] == 28
    assert op8_chat.format_digests(frame, exact=True).collect() == op8_chat.format_digests(frame).collect()


def test_chat_ids_are_exact_beside_a_null(spark, tmp_path):
    turns = [(2**53, 0, "user", "a"), (2**53 + 1, 0, "user", "b"), (None, 0, "user", "c"), (None, 1, "assistant", "d"), (2**63 - 1, 0, "user", "e")]
    path = saved(spark, tmp_path, spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string"), "conversations")
    assert {r["conv_id"]: r["n_turns"] for r in op8_chat.op8_chat_format(spark, path).collect()} == {2**53: 1, 2**53 + 1: 1, None: 2, 2**63 - 1: 1, -1: 2}


def test_chat_digests_against_an_independent_formatter(spark, tmp_path):
    rnd = random.Random(5)
    pieces = ["</s>", "[INST]", " ok ", "[/INST]", "\\", "<s>", "é😀", "\n", "", "[TURN]", "[/ROLE]", "\\]"]
    turns = []
    for conv in range(40):
        for turn in range(rnd.randrange(1, 90)):
            text = None if rnd.random() < 0.1 else "".join(rnd.choice(pieces) for _ in range(rnd.randrange(6)))
            turns.append((conv, rnd.choice([turn, turn, max(0, turn - 1)]), rnd.choice(["user", "assistant", "assistant", "system", "tool[/ROLE]", None]), text))
    shuffled = turns[:]
    rnd.shuffle(shuffled)
    path = saved(spark, tmp_path, spark.createDataFrame(shuffled, "conv_id bigint, turn bigint, role string, text string").withColumn("role2", F.lit(1)), "conversations")
    got = {r["conv_id"]: r for r in op8_chat.op8_chat_format(spark, path).collect()}
    for conv in range(40):
        own = sorted((t[1:] for t in turns if t[0] == conv), key=lambda t: (t[0], t[1] is not None, t[1] or "", t[2] is not None, t[2] or ""))
        said = "".join(t[2] or "" for t in own if t[1] == "assistant")
        r = got[conv]
        assert (r["n_turns"], r["loss_chars"]) == (len(own), len(said))
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{t[1] or ''}\n{t[2] or ''}\n" for t in own).encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()


def test_chat_own_conversation_stays_apart(spark, tmp_path):
    turns = [(-1, 0, "user", "mine"), (-1, 1, "assistant", "x" * 300_000), (-1, 1, "assistant", "x" * 300_000)]
    path = saved(spark, tmp_path, spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string"), "conversations")
    got = sorted((r["conv_id"], r["n_turns"], r["loss_chars"]) for r in op8_chat.op8_chat_format(spark, path).collect())
    assert got == [(-1, 2, 21), (-1, 3, 600_000)]


def test_chat_query(spark, tmp_path):
    turns = [(1, k, "assistant" if k % 2 else "user", f"t{k}") for k in range(150)] + [(2, 0, "user", None), (None, 0, None, "x")]
    path = saved(spark, tmp_path, spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string"), "conversations")
    got = {r["conv_id"]: r for r in op8_chat.op8_chat_format(spark, path).collect()}
    assert set(got) == {1, 2, None, -1} and got[1]["n_turns"] == 150
    assert got[1]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in turns[:150]).encode()).hexdigest()
    assert got[1]["loss_sha256"] == hashlib.sha256("".join(t for _, _, r, t in turns[:150] if r == "assistant").encode()).hexdigest()
    assert got[1]["formatted_chars"] == len(op8_chat.render([(r, t) for _, _, r, t in turns[:150]]))
    assert got[-1]["loss_chars"] == 21 and got[2]["loss_chars"] == 0


# 9. Decontamination


def test_reparameterised_questions(spark):
    question = "A train leaves Paris at 9 with 120 kg of cargo and needs 3 hours to reach the old harbour near the river"
    changed = question.replace("Paris", "Vienna").replace("120", "340").replace("3 hours", "7 hours").replace("9", "8")
    broken = prose(4, 30)
    texts = ["intro words here. " + question + " more", "so. " + changed, broken, None, "", question[:40]]
    bench = spark.createDataFrame([(7, question), (8, None), (9, "too short"), (7, question)], "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]) for r in op9_decontaminate.leaks(docs(spark, texts), bench).collect()}
    assert got == {(0, 7), (1, 7)}
    renamed = [(1, "Alice has 12 apples. Bob has 9 apples. How many apples do they have together in all?", "Carol has 7 apples. Dave has three apples. How many apples do they have together in all?")]
    renamed += [(2, "O'Brien paid \u20ac5 for 120kg of coal and McDonald sold the rest of the coal to 9", "McCoy paid \u20ac8 for 75kg of coal and O'Hara sold the rest of the coal to 8,")]
    # One value of the item may not stand for two: the first and the last slot differ.
    renamed += [(3, "9 red stones lay in the old garden wall by the quiet river next to 9", "8 red stones lay in the old garden wall by the quiet river next to 7")]
    renamed += [(6, "La. Arno came to Bern by night and left. The old road was long", "LA. ARNO CAME TO BERN BY NIGHT AND LEFT. THE OLD ROAD WAS LONG!!")]
    renamed += [(4, "too short", "Too short."), (5, "too short two", "it is too short two")]
    items = spark.createDataFrame([(k, a) for k, a, _ in renamed], "item_id bigint, text string")
    found = op9_decontaminate.leaks(spark.createDataFrame([(k, b) for k, _, b in renamed], "doc_id bigint, text string"), items)
    assert sorted((r["doc_id"], r["item_id"]) for r in found.collect()) == [(1, 1), (2, 2), (4, 4), (6, 6)]
    left = op9_decontaminate.without_leaks(docs(spark, texts), bench)
    assert {r["doc_id"] for r in left.collect()} == {2, 3, 4, 5}


def test_windows_of_numbers_give_no_pairs_of_all_places(spark, monkeypatch):
    rnd = random.Random(8)
    table = spark.createDataFrame([(1, " ".join(str(rnd.randrange(100)) for _ in range(3000))), (2, "a b " * 2000), (3, None), (4, "")], "doc_id bigint, text string")
    items = spark.createDataFrame([(k, " ".join(str(rnd.randrange(100)) for _ in range(40))) for k in range(200)] + [(200, "a b " * 30), (201, None)], "item_id bigint, text string")
    hits, write = [], op9_decontaminate.materialize
    monkeypatch.setattr(op9_decontaminate, "materialize", lambda f: hits.append(write(f)) or hits[-1])
    assert [(r["doc_id"], r["item_id"], r["containment"]) for r in op9_decontaminate.leaks(table, items).collect()] == [(2, 200, 1.0)]
    assert hits[-1].count() < 10_000


def test_leaks_without_doc_id(spark):
    item = prose(70, 30)
    half = item.split()
    texts = [item, " ".join(half[:17]), " ".join(half[13:]), None, prose(71, 30)]
    frame = spark.createDataFrame([(None, t, "en", "a", 0) for t in texts], DOCS)
    bench = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    assert [(r["doc_id"], r["matched"]) for r in op9_decontaminate.leaks(frame, bench).collect()] == [(None, 26)]
    assert op9_decontaminate.leaks(frame.where(~F.col("text").eqNullSafe(item)), bench).count() == 0
    left = op9_decontaminate.without_leaks(frame, bench)
    assert left.columns == frame.columns and collections.Counter(r["text"] for r in left.collect()) == collections.Counter(texts[1:])


# 10. Mixing


def test_mix_stays_within_a_block(spark):
    frame = docs(spark, [prose(k, 3) for k in range(2000)], ["a", "a", "a", "b", "c", None])
    out = op10_mix.mix(frame.select("doc_id", "source"), 240, 4).toPandas().sort_values("position")
    assert out["position"].tolist() == list(range(2000))
    blocks = out.drop_duplicates(["source", "block"])
    assert ((blocks["slot"] >= blocks["release"]) & (blocks["slot"] < blocks["deadline"])).all()
    assert blocks["slot"].is_unique


@pytest.mark.parametrize("sources", [7, 300])
def test_mix_of_many_sources_and_odd_ids(spark, sources):
    """More sources than MAX_SOURCES, far outlying and null ids."""
    rnd = random.Random(6)
    ids = [None] * 40 + [rnd.choice([k, -k, k << 40, 2**63 - 1 - k, k - 2**63]) for k in range(1, 4000)]
    given = [(i, f"s{rnd.randrange(sources) * rnd.randrange(2)}") for i in ids]
    out = sorted(op10_mix.mix(spark.createDataFrame(given, "doc_id bigint, source string")).collect(), key=lambda r: r["position"])
    assert [r["position"] for r in out] == list(range(len(given)))
    for source in {s for _, s in given}:
        assert [r["doc_id"] for r in out if r["source"] == source] == sorted((i for i, s in given if s == source), key=lambda i: (i is not None, i or 0))
    blocks = {(r["source"], r["block"]): r for r in out}.values()
    assert all(r["release"] <= r["slot"] < r["deadline"] for r in blocks) and len({r["slot"] for r in blocks}) == len(blocks)


def test_mix_ranks_any_ids(spark):
    rnd = random.Random(7)
    given = sorted({rnd.choice([1, 1 << 20, 1 << 45, 1 << 62]) * rnd.choice([-1, 1]) + rnd.randrange(9000) for _ in range(3000)})
    got = op10_mix.ranked(spark.createDataFrame([(i, "a") for i in given], "doc_id bigint, source string")).collect()
    assert {r["doc_id"]: r["_rank"] for r in got} == {i: k for k, i in enumerate(given)}


def test_long_schedule_equals_period_schedule(spark):
    counts = spark.createDataFrame([(f"s{k}", 1 + k * k * 7) for k in range(23)], "_source string, n bigint")
    units = op10_mix.tempered_units(counts)
    both = [f.select("slot_in_period", "s", "k").orderBy("slot_in_period").collect() for f in (op10_mix.long_schedule(units, 240), op10_mix.period_schedule(units, 240))]
    assert len(both[0]) == 240 and [tuple(map(int, r)) for r in both[0]] == [tuple(map(int, r)) for r in both[1]]


def test_mix_to_target_weights(spark):
    frame = docs(spark, [None] * 900, ["a", "b", "c"]).select("doc_id", "source")
    targets = spark.createDataFrame([("a", 3.0), ("b", 1.0)], "source string, weight double")
    first = op10_mix.mix(frame, 240, 1, targets).where("position < 200").groupBy("source").count().collect()
    got = {r["source"]: r["count"] for r in first}
    assert abs(got["a"] - 149) < 3 and abs(got["b"] - 50) < 3 and got.get("c", 0) <= 1


def test_mix_keeps_odd_columns_and_repeated_rows(spark):
    frame = spark.createDataFrame([(k % 50, "ab"[k % 2] if k % 5 else None) for k in range(200)], "doc_id bigint, source string")
    for name in ("s", "u", "k", "done", "_piece", "_row", "_source", "Slot", "position"):
        frame = frame.withColumn(name, F.lit("mine"))
    out = op10_mix.mix(frame, 240, 4)
    rows_ = out.collect()
    assert sorted(r["position"] for r in rows_) == list(range(200)) and {(r["s"], r["done"], r["_piece"], r["_row"]) for r in rows_} == {("mine",) * 4}
    assert collections.Counter((r["doc_id"], r["source"]) for r in rows_) == collections.Counter((r["doc_id"], r["source"]) for r in frame.collect())


# The pipeline


def test_stages_on_empty_null_and_odd_rows(spark):
    odd = docs(spark, [None, "", prose(1), prose(1), "a@b.co " + prose(2)]).unionByName(docs(spark, [prose(3)]).withColumn("doc_id", F.lit(None).cast("bigint")))
    odd = odd.withColumn("_row", F.lit("r")).withColumn("kept", F.lit("k"))
    for frame in (odd, odd.limit(0)):
        for name, stage in pipeline.STAGES:
            out = stage(spark, frame, DATA)
            assert out.columns[: len(frame.columns)] == frame.columns, name
            assert {(r["_row"], r["kept"]) for r in out.collect()} <= {("r", "k")}
            assert out.count() <= frame.count()


def test_pipeline(spark, tmp_path):
    clean = [prose(k, 80) for k in range(12)]
    leak = prose(50, 40)
    texts = [*clean, clean[0], clean[1] + " end", "junk " * 50, None, prose(30, 60) + " " + leak + " " + prose(31, 60), prose(32, 60) + " write to a.b@example.com"]
    saved(spark, tmp_path, docs(spark, texts, ["a", "b", "c"]))
    path = saved(spark, tmp_path, spark.createDataFrame([(1, leak)], "item_id bigint, text string"), "benchmark")
    out = {r["doc_id"]: r for r in pipeline.run(spark, path).collect()}
    gone = {12, 14, 15, 16}
    assert set(range(12)) <= set(out) and not gone & set(out) and 17 in out
    assert out[17]["text"].endswith("[EMAIL]")
    assert sorted(r["position"] for r in out.values()) == list(range(len(out)))


def test_bitmap_comes_to_the_driver_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(bitmaps, "BLOCK", 4)
    hashes = [r["v"] for r in spark.range(40).select(F.xxhash64("id").alias("v")).collect()]
    words = bitmaps.bitmap(spark.range(40).select(F.xxhash64("id").alias("v")), 40)
    want = np.zeros(len(words), dtype=np.uint64)
    for v in hashes:
        want[(v % 2**64 >> 6) % len(words)] |= np.uint64(1 << (v & 63))
    assert len(words) == 16 and (words == want).all()
    one = bitmaps.bitmap(spark.range(1).select(F.lit(77).cast("bigint").alias("v")), 1)
    assert one.tolist() == [1 << 13]
