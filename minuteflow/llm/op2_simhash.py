"""SimHash near-duplicates by the generalised pigeonhole principle.

1. fingerprints(): 64-bit SimHash of the 4-word shingles of the whole lower-cased text.
2. choose_plan(): the 64 bits are grouped into m partitions of correlated bits; each partition i
   gets its own threshold t_i (-1: skipped) with sum(t_i) = radius - m + 1, chosen by dynamic
   programming on estimated candidate counts. Whatever the choice, two fingerprints within the
   radius agree within t_i on some partition, so the estimates cost time, never links.
3. links(): every distinct fingerprint is filed under its masked value in each partition and,
   where t_i > 0, probes the values within t_i flipped bits. Rows of a key meet in one task, are
   verified on all 64 bits and linked as a spanning forest, never as all pairs. A key with many
   rows is dealt out as pairs of blocks.
4. connected_components() over distinct fingerprints; copies meet only in grouped minima.

Defined cases: null, empty and blank texts have the fingerprint zero and are linked like any
other; a text of fewer than four words is one shingle; repeated rows share a component; rows
with a null doc_id take part in links but never name a component; an empty table gives an
empty result.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from minuteflow.llm.bitmap import row_keys, split_by_key
from minuteflow.llm.components import connected_components
from minuteflow.session import materialize

SHINGLE_WORDS = 4
RADIUS = 4
#: Rows of one key that meet in a task; keys with more are dealt out as pairs of blocks of half as many.
BLOCK = 4096
#: The estimates come from at most about this many fingerprints.
SAMPLE = 500_000


def simhash(text: str | None) -> int:
    """The fingerprint of one text as a signed 64-bit number."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined, size = b" ".join(words), min(SHINGLE_WORDS, len(words))
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[s:e], 42) for s, e in zip(starts, ends[size - 1 :].tolist())], dtype=">u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes)).view(">i8")[0])


@F.pandas_udf(T.LongType())
def simhash_udf(texts: pd.Series) -> pd.Series:
    return pd.Series([simhash(t) for t in texts], dtype="int64")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) for every row."""
    return docs.select("doc_id", simhash_udf("text").alias("fp"))


def bit_correlation(distinct: DataFrame) -> np.ndarray:
    """64 x 64 correlations of the bits of (fp); bit 0 is the highest."""

    def gram(parts):
        total = np.zeros((65, 65))
        for part in parts:
            fps = part["fp"].to_numpy(dtype=np.int64).astype(">i8")
            for at in range(0, len(fps), 1 << 14):
                chunk = fps[at : at + (1 << 14)]
                bits = np.ones((len(chunk), 65), dtype=np.float32)
                bits[:, :64] = np.unpackbits(chunk.view(np.uint8).reshape(-1, 8), axis=1)
                total += bits.T @ bits
        yield pd.DataFrame({"k": np.arange(65 * 65), "v": total.ravel()})

    sums = distinct.select("fp").mapInPandas(gram, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).toPandas()
    total = np.zeros(65 * 65)
    total[sums["k"].to_numpy(dtype=int)] = sums["v"]
    total = total.reshape(65, 65)
    n = max(total[64, 64], 1)
    mean = total[64, :64] / n
    cov = total[:64, :64] / n - np.outer(mean, mean)
    scale = np.sqrt(np.maximum(np.diag(cov), 1e-9))
    return cov / np.outer(scale, scale)


def correlated_groups(correlation: np.ndarray, m: int) -> list[list[int]]:
    """m groups of nearly equal size; each takes the bits most correlated with those it has."""
    strength, free, groups = np.abs(correlation), set(range(64)), []
    for k in range(m):
        room = (64 - sum(map(len, groups))) // (m - k)
        group = [max(sorted(free), key=lambda b: strength[b, sorted(free)].sum())]
        free.discard(group[0])
        while len(group) < room:
            best = max(sorted(free), key=lambda b: strength[b, group].sum())
            group.append(best)
            free.discard(best)
        groups.append(sorted(group))
    return groups


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def mask_of(bits: list[int]) -> int:
    return signed(sum(1 << (63 - b) for b in bits))


def ball(width: int, t: int) -> int:
    return sum(comb(width, j) for j in range(t + 1))


def allocate(pairs: list[float], widths: list[int], rows: float, radius: int, row_cost: float = 400.0) -> tuple[float, list[int]]:
    """Thresholds of least cost: dynamic programming over partitions and the thresholds' sum.

    pairs: estimated pairs of equal value in each partition. A probe row costs row_cost checked
    candidates; a threshold t multiplies the candidates by the values in its ball.
    """
    target, best = radius - len(widths) + 1, {0: (0.0, [])}
    for p, w in zip(pairs, widths):
        step: dict[int, tuple[float, list[int]]] = {}
        for total, (cost, chosen) in best.items():
            for t in range(-1, 4):
                new = cost + (0 if t < 0 else p * ball(w, t) + row_cost * rows * ball(w, t))
                if total + t not in step or new < step[total + t][0]:
                    step[total + t] = (new, [*chosen, t])
        best = step
    return best[target]


def choose_plan(distinct: DataFrame, n: int, radius: int = RADIUS) -> list[tuple[list[int], int]]:
    """(bits, threshold) for each partition that is used."""
    if n < 2:
        return [(g, 0) for g in correlated_groups(np.eye(64), radius + 1)]
    sample = distinct.where(F.pmod(F.xxhash64("fp"), F.lit(1_000_003)) < int(1_000_003 * min(1.0, SAMPLE / n)) + 1)
    correlation = bit_correlation(sample)
    plans = {m: correlated_groups(correlation, m) for m in range(3, radius + 2)}
    keys = [F.struct(F.lit(m).alias("m"), F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(mask_of(g))).alias("key")) for m, groups in plans.items() for i, g in enumerate(groups)]
    counted = sample.select(F.explode(F.array(*keys)).alias("k")).groupBy("k.m", "k.i", "k.key").agg(F.count("*").cast("double").alias("c"))
    found = {(r.m, r.i): (r.pairs, r.rows) for r in counted.groupBy("m", "i").agg(F.sum(F.col("c") * (F.col("c") - 1) / 2).alias("pairs"), F.sum("c").alias("rows")).collect()}
    options = []
    for m, groups in plans.items():
        pairs = [found[m, i][0] * (n / max(found[m, i][1], 1)) ** 2 for i in range(m)]
        cost, thresholds = allocate(pairs, [len(g) for g in groups], n, radius)
        options.append((cost, m, list(zip(groups, thresholds))))
    return [(g, t) for g, t in min(options, key=lambda o: o[:2])[2] if t >= 0]


def probes(distinct: DataFrame, plan: list[tuple[list[int], int]]) -> DataFrame:
    """(part, key, probe, fp): one row for the value itself and one for each value within the threshold."""
    rows = []
    for part, (bits, t) in enumerate(plan):
        for size in range(t + 1):
            for flips in combinations(bits, size):
                key = F.col("fp").bitwiseXOR(F.lit(mask_of(list(flips)))).bitwiseAND(F.lit(mask_of(bits)))
                rows.append(F.struct(F.lit(part).alias("part"), key.alias("key"), F.lit(size > 0).alias("probe")))
    return distinct.select("fp", F.explode(F.array(*rows)).alias("r")).select("r.part", "r.key", "r.probe", "fp")


def _forest(fps: np.ndarray, probe: np.ndarray, radius: int):
    """Edges of a spanning forest of the rows of one key within radius; two probes aren't compared."""
    left = np.ones(len(fps), dtype=bool)
    while left.any():
        stack = [int(np.argmax(left))]
        left[stack[0]] = False
        while stack:
            u = stack.pop()
            near = left & (np.bitwise_count(fps ^ fps[u]) <= radius)
            if probe[u]:
                near &= ~probe
            found = np.flatnonzero(near)
            left[found] = False
            stack.extend(found.tolist())
            for v in found.tolist():
                yield fps[u], fps[v]


def _linked(parts, radius: int):
    """Sorted rows (part, key, deal, probe, fp) -> edges; the rows of a key that a batch cuts are kept for the next."""
    kept = None

    def edges(frame):
        fps, probe = frame["fp"].to_numpy(dtype=np.int64).view(np.uint64), frame["probe"].to_numpy(dtype=bool)
        start = np.flatnonzero(change(frame))
        sizes = np.diff(np.append(start, len(frame)))
        out = []
        two = start[sizes == 2]
        good = (np.bitwise_count(fps[two] ^ fps[two + 1]) <= radius) & ~(probe[two] & probe[two + 1]) if len(two) else np.zeros(0, dtype=bool)
        out.append(np.stack([fps[two[good]], fps[two[good] + 1]], axis=1) if len(two) else np.zeros((0, 2), dtype=np.uint64))
        for s, k in zip(start[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
            if not probe[s : s + k].all() and (found := list(_forest(fps[s : s + k], probe[s : s + k], radius))):
                out.append(np.array(found, dtype=np.uint64))
        both = np.concatenate(out).view(np.int64)
        return pd.DataFrame({"a": both[:, 0], "b": both[:, 1]})

    def change(frame):
        k = frame[["part", "key", "deal"]].to_numpy(dtype=np.int64)
        return np.append(True, (k[1:] != k[:-1]).any(axis=1))

    for frame in parts:
        if not len(frame):
            continue
        if kept is not None:
            frame = pd.concat([kept, frame], ignore_index=True)
        cut = int(np.flatnonzero(change(frame))[-1])
        kept = frame.iloc[cut:]
        if cut:
            yield edges(frame.iloc[:cut])
    if kept is not None:
        yield edges(kept)


def links(distinct: DataFrame, plan: list[tuple[list[int], int]], radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) that connect all distinct fingerprints within radius."""
    rows = probes(distinct, plan)
    large = rows.groupBy("part", "key").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK)
    blocks = F.ceil(F.col("n") / (BLOCK // 2)).cast("int")
    dealt = (
        rows.join(large, ["part", "key"], "left")
        .withColumn("blocks", F.coalesce(blocks, F.lit(1)))
        .withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
        .withColumn("deal", (F.least("mine", "other") * F.col("blocks") + F.greatest("mine", "other")).cast("bigint"))
        .select("part", "key", "deal", "probe", "fp")
    )
    sorted_rows = dealt.repartition("part", "key", "deal").sortWithinPartitions("part", "key", "deal")
    return sorted_rows.mapInPandas(lambda parts: _linked(parts, radius), "a bigint, b bigint").distinct()


def rooted_fingerprints(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """prints (fp, ...) -> (fp, root): the smallest fingerprint that each distinct one is linked to."""
    nodes = materialize(prints.select("fp").distinct())
    plan = choose_plan(nodes, nodes.count(), radius)
    roots = connected_components(links(nodes, plan, radius))
    return nodes.join(roots, nodes.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs."""
    prints = materialize(fingerprints(docs))
    rooted = prints.groupBy("fp").agg(F.min("doc_id").alias("rep")).join(rooted_fingerprints(prints, radius), "fp")
    smallest = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    classes = rooted.join(smallest, "root").select("fp", "component_id")
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id")


def op2_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """The contract's columns for every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The pipeline's form: of each component one row stays, that of the smallest doc_id.

    Rows are told apart by doc_id and text, so rows of one doc_id with unrelated texts all stay. A
    row without doc_id stays only where no row of its component has one; of equal rows one stays.
    Only rows that may go, or have equals, are shuffled.
    """
    keyed = row_keys(docs.select("doc_id", "text"))
    prints = materialize(keyed.select("_k", "_v", F.col("doc_id").isNull().alias("nameless"), simhash_udf("text").alias("fp")))
    rows = prints.groupBy("fp", "nameless", "_k", "_v").agg(F.count("*").alias("n")).join(rooted_fingerprints(prints, radius), "fp")
    rows = materialize(rows.select("root", "n", F.struct("nameless", "_k", "_v").alias("row")))
    best = rows.groupBy("root").agg(F.min("row").alias("best"))
    touched = materialize(rows.join(best, "root").where("n > 1 or row <> best").select("row._k", "row._v", (F.col("row") == F.col("best")).alias("stays")))
    mine = row_keys(docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))).select("_k", "_v", "_row")
    some, others = split_by_key(mine, touched)
    kept = some.join(touched.where("not stays").hint("merge"), ["_k", "_v"], "left_anti").dropDuplicates(["_k", "_v"])
    return kept.unionByName(others).select("_row.*")
