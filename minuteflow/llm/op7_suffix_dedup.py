"""Exact repeated-passage removal with merged Burrows-Wheeler transforms.

A byte goes if a LENGTH-byte string that covers it starts anywhere else. The work is cut into
buckets of anchors, and nothing is lost:

1. anchors(): the LENGTH-byte strings that start in a row at neighbouring bytes and share their
   smallest ANCHOR-byte hash form one context. Equal strings have equal anchors at equal places,
   so strings need comparing only under one anchor, and an anchor seen once holds no repeat: a
   first scan counts anchors, a second one keeps the contexts of those in a bitmap of bounded size.
2. Contexts that are equal as a whole are counted, not compared: seen twice, all their strings
   repeat. Only anchors with two or more different contexts go on.
3. In a bucket of anchors each shard of contexts gets its own transform over 40-byte symbols (a
   context is read at 40 phases, so every byte starts a string), the transforms are merged by
   interleave refinement, and an interval of suffixes that share 5 symbols, 200 bytes, is a
   repeat if its contexts were seen twice or more. The contexts of an anchor with more than
   TOGETHER of them never meet in one task: their strings are dealt out by hash and counted.
4. Repeats become byte ranges of each document and are cut out of the texts in a bitmap of those
   that have any; the other texts never move.

Defined cases: null and empty texts and texts under LENGTH bytes lose nothing; a repeated row
repeats its whole text if that has LENGTH bytes; rows are told apart by doc_id and text, so one
doc_id may have several texts, and a null doc_id is as good as any; an empty table gives an empty
result; extra columns don't matter.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from minuteflow.llm import bwt
from minuteflow.llm.bitmap import bitmap, holds, row_keys
from minuteflow.session import discard, materialize

LENGTH = 200
ANCHOR = 40
#: A symbol of the transforms is so many bytes; LENGTH is a whole number of symbols.
SYMBOL = 40
#: Bytes of contexts in a bucket, and its shards.
BUCKET_BYTES = 250_000
SHARDS = 4
#: Different contexts of one anchor that meet in a bucket; an anchor with more is dealt out by string.
TOGETHER = 4096
#: Bytes of text that a task hashes at once.
CHUNK = 400_000

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def context_runs(data: np.ndarray, valid: np.ndarray, length: int = LENGTH, anchor: int = ANCHOR):
    """(first, count, anchor_hash, context_hash) of the contexts in data; valid marks the starts that count.

    first is the first start of a context, count its number of starts.
    """
    n = len(data)
    forward, backward = _powers(_BASE, n), _powers(_INVERSE, n + 1)
    total = np.append(np.uint64(0), np.cumsum(_BYTE[data] * forward, dtype=np.uint64))
    grams = _mix((total[anchor:] - total[:-anchor]) * backward[: n - anchor + 1])
    # The place in the low bits makes the leftmost of equal hashes the smallest.
    packed = (grams & ~np.uint64(0xFFFFFF)) | np.arange(len(grams), dtype=np.uint64)
    width, span, least = length - anchor + 1, 1, packed
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if width > span:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    at = (least & np.uint64(0xFFFFFF)).astype(np.int64)
    ok = valid[: len(at)]
    cut = np.append(True, (at[1:] != at[:-1]) | ~ok[:-1])
    starts = np.flatnonzero(cut & ok)
    # A context ends before the next cut or the next start that doesn't count.
    stops = np.flatnonzero(np.append((at[1:] != at[:-1]) | ~ok[1:], True) & ok) + 1
    count, place = stops - starts, at[starts]
    whole = (total[stops + length - 1] - total[starts]) * backward[starts]
    context = _mix(whole ^ _mix((place - starts).astype(np.uint64) * np.uint64(512) + count.astype(np.uint64)))
    return starts, count, grams[place], context


def _batched(keys, texts):
    """(keys, texts) of at most CHUNK bytes together; a longer text comes alone."""
    ids, parts, size = [], [], 0
    for key, text in zip(keys, texts):
        raw = (text or "").encode("utf-8", "replace")
        if len(raw) < LENGTH:
            continue
        if ids and size + len(raw) > CHUNK:
            yield ids, parts
            ids, parts, size = [], [], 0
        ids.append(key)
        parts.append(raw)
        size += len(raw)
    if ids:
        yield ids, parts


#: A longer text is read in overlapping pieces of this many bytes.
PIECE = 500_000


def _anchor_rows(frames, keep=None):
    """Rows of anchors(); keep, a bitmap, drops contexts whose anchor it doesn't hold."""
    for frame in frames:
        for ids, parts in _batched(zip(frame["_k"], frame["_v"]), frame["text"]):
            if len(parts) == 1 and len(parts[0]) > PIECE:
                spans = [(ids, [parts[0][at : at + PIECE + LENGTH - 1]], at) for at in range(0, len(parts[0]) - LENGTH + 1, PIECE)]
            else:
                spans = [(ids, parts, 0)]
            for own, texts, offset in spans:
                sizes = np.array([len(t) for t in texts])
                first = np.append(0, np.cumsum(sizes)[:-1])
                data = np.frombuffer(b"".join(texts), dtype=np.uint8)
                valid = np.ones(len(data), dtype=bool)
                for end in (first + sizes).tolist():
                    valid[max(0, end - LENGTH + 1) : end] = False
                starts, count, anchor, context = context_runs(data, valid)
                if keep is not None:
                    held = holds(keep, anchor)
                    starts, count, anchor, context = starts[held], count[held], anchor[held], context[held]
                doc = np.searchsorted(first, starts, side="right") - 1
                keys = np.array(own, dtype=np.int64)[doc]
                yield pd.DataFrame(
                    {
                        "_k": keys[:, 0],
                        "_v": keys[:, 1],
                        "first": (starts - first[doc] + offset).astype(np.int64),
                        "n": count.astype(np.int32),
                        "anchor": anchor.view(np.int64),
                        "context": context.view(np.int64),
                    }
                )


def _anchor_hashes(frames):
    for rows in _anchor_rows(frames):
        anchor, seen = np.unique(rows["anchor"].to_numpy(), return_counts=True)
        yield pd.DataFrame({"anchor": anchor, "seen": seen})


def anchors(keyed: DataFrame, keep=None) -> DataFrame:
    """(_k, _v, first, n, anchor, context) for the contexts of every text; keep, a broadcast bitmap, holds the anchors wanted."""
    return keyed.select("_k", "_v", "text").mapInPandas(lambda frames: _anchor_rows(frames, keep and keep.value), "_k bigint, _v bigint, first bigint, n int, anchor bigint, context bigint")


def _context_bytes(frames):
    """(text, wanted) -> the bytes of each wanted context."""
    for frame in frames:
        rows = []
        for text, wanted in zip(frame["text"], frame["wanted"]):
            raw = text.encode("utf-8", "replace")
            for x in wanted:
                rows.append((x["anchor"], x["context"], x["weight"], x["n"], raw[x["first"] : x["first"] + x["n"] + LENGTH - 1]))
        yield pd.DataFrame(rows, columns=["anchor", "context", "weight", "n", "bytes"])


def _context_strings(frames):
    """Contexts with their bytes -> the hash of each of their LENGTH-byte strings."""
    for frame in frames:
        for anchor, context, weight, n, raw in zip(frame["anchor"], frame["context"], frame["weight"], frame["n"], frame["bytes"]):
            string = np.array([xxhash.xxh3_64_intdigest(raw[k : k + LENGTH]) for k in range(n)], dtype=np.uint64).view(np.int64)
            yield pd.DataFrame({"anchor": anchor, "context": context, "weight": weight, "at": np.arange(n, dtype=np.int32), "string": string})


def _dense(key: np.ndarray) -> np.ndarray:
    """Equal keys get equal numbers from 0."""
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    out = np.empty(len(key), dtype=np.int64)
    out[order] = np.cumsum(np.append(0, ordered[1:] != ordered[:-1])[: len(key)])
    return out


def symbol_codes(data: np.ndarray, symbol: int) -> np.ndarray:
    """A number for the symbol bytes that start at each byte of data; equal numbers for equal bytes."""
    eight = _dense(np.lib.stride_tricks.sliding_window_view(np.append(data, np.zeros(7, dtype=np.uint8)), 8).copy().view(np.uint64).ravel())
    have, codes = 8, eight

    def joined(left: np.ndarray, right: np.ndarray, shift: int) -> np.ndarray:
        follow = np.zeros(len(left), dtype=np.int64)
        follow[: len(left) - shift] = right[shift:] + 1
        return _dense(left * (len(left) + 1) + follow)

    while have * 2 <= symbol:
        codes = joined(codes, codes, have)
        have *= 2
    while have < symbol:
        step = min(8, symbol - have)
        # The last eight bytes may overlap what is there already.
        codes = joined(codes, eight, have + step - 8)
        have += step
    return codes


def repeated_starts(contexts: list[bytes], starts: list[int], weights: list[int], length: int = LENGTH, symbol: int = SYMBOL, shards: int = SHARDS) -> list[np.ndarray]:
    """For each context a flag for each start: does its length-byte string repeat among the contexts?

    A context seen weight times counts so often. Strings are compared by merging the shards' transforms.
    """
    depth = length // symbol
    sizes = np.array([len(c) for c in contexts])
    first = np.append(0, np.cumsum(sizes))
    every = symbol_codes(np.frombuffer(b"".join(contexts), dtype=np.uint8), symbol) + 1
    # A context is one string for each phase: its symbols at phase, phase + symbol, ... and an end.
    owner, codes, place, shard = [], [], [], []
    usable = sizes - symbol + 1
    for phase in range(symbol):
        counts = np.maximum(0, -(-(usable - phase) // symbol))
        total = counts + 1
        ids = np.repeat(np.arange(len(contexts)), total)
        at = np.arange(len(ids)) - np.repeat(np.cumsum(total) - total, total)
        offset = phase + at * symbol
        ends = at == counts[ids]
        code = np.where(ends, 0, every[np.minimum(first[ids] + offset, len(every) - 1)])
        owner.append(ids)
        codes.append(code)
        place.append(np.where(ends, -1, offset))
        shard.append(ids % shards)
    owner, codes, place, shard = map(np.concatenate, (owner, codes, place, shard))
    by_shard = np.argsort(shard.astype(np.uint8), kind="stable")
    owner, codes, place = owner[by_shard], codes[by_shard], place[by_shard]
    bounds = np.append(0, np.cumsum(np.bincount(shard, minlength=shards)))
    shard_codes = [codes[a:b] for a, b in zip(bounds[:-1], bounds[1:]) if b > a]
    orders = [bwt.shard_order(c, depth) for c in shard_codes]
    interleave, common = bwt.merge([bwt.transform(c, o) for c, o in zip(shard_codes, orders)], depth)
    suffix = bwt.merged_suffixes(orders, interleave)
    interval = np.cumsum(common < depth) - 1
    seen = np.bincount(interval, weights=np.asarray(weights, dtype=np.float64)[owner[suffix]])
    hit = suffix[(seen[interval] >= 2) & (place[suffix] >= 0)]
    starts = np.asarray(starts)
    hit = hit[place[hit] < starts[owner[hit]]]
    start_at = np.append(0, np.cumsum(starts))
    flat = np.zeros(int(start_at[-1]), dtype=bool)
    flat[start_at[owner[hit]] + place[hit]] = True
    return [flat[a:b] for a, b in zip(start_at[:-1].tolist(), start_at[1:].tolist())]


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def _merge_bucket(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values(["anchor", "context"])
    flags = repeated_starts(frame["bytes"].tolist(), frame["n"].tolist(), frame["weight"].tolist())
    rows = [(a, c, s, e) for a, c, f in zip(frame["anchor"], frame["context"], flags) for s, e in _runs(f)]
    return pd.DataFrame(rows, columns=["anchor", "context", "low", "high"])


def _wanted(keyed: DataFrame, contexts: DataFrame) -> DataFrame:
    """(text, wanted): the texts that hold the first occurrence of contexts, with those contexts."""
    wanted = contexts.select("at._k", "at._v", F.struct("anchor", "context", "weight", "n", "at.first").alias("x")).groupBy("_k", "_v").agg(F.collect_list("x").alias("wanted"))
    return keyed.select("_k", "_v", "text").join(wanted, ["_k", "_v"]).dropDuplicates(["_k", "_v"]).select("text", "wanted")


def _large_anchors(contexts: DataFrame) -> DataFrame:
    """(anchor, context, low, high) of the strings that repeat under anchors of many contexts, dealt by string."""
    strings = materialize(contexts.mapInPandas(_context_strings, "anchor bigint, context bigint, weight bigint, at int, string bigint"))
    often = materialize(strings.groupBy("anchor", "string").agg(F.sum("weight").alias("seen")).where("seen >= 2").select("anchor", "string"))
    run = F.col("at") - F.row_number().over(Window.partitionBy("anchor", "context").orderBy("at"))
    hits = strings.join(often, ["anchor", "string"], "left_semi").select("anchor", "context", "at", run.alias("run"))
    out = materialize(hits.groupBy("anchor", "context", "run").agg(F.min("at").alias("low"), (F.max("at") + 1).alias("high")).drop("run"))
    discard(strings)
    discard(often)
    return out


def repeated_ranges(keyed: DataFrame, together: int = TOGETHER) -> DataFrame:
    """(_k, _v, ranges): the byte ranges [low, high) of each document to remove, unmerged; documents without any are left out.

    Only tables that a later step reads stay on disk.
    """
    seen = keyed.select("_k", "_v", "text").mapInPandas(_anchor_hashes, "anchor bigint, seen bigint").groupBy("anchor").agg(F.sum("seen").alias("seen"))
    often = materialize(seen.where("seen >= 2").select(F.col("anchor").alias("v")))
    keep = keyed.sparkSession.sparkContext.broadcast(bitmap(often, often.count()))
    discard(often)
    # An anchor held by chance has one context of weight 1, which no later step takes up.
    found = materialize(anchors(keyed, keep))
    distinct = materialize(found.groupBy("anchor", "context").agg(F.count("*").alias("weight"), F.first("n").alias("n"), F.min(F.struct("_k", "_v", "first")).alias("at")))
    several = materialize(distinct.groupBy("anchor").agg(F.count("*").alias("contexts")).where("contexts >= 2"))
    alone = distinct.where("weight >= 2").join(several, "anchor", "left_anti").select("anchor", "context", F.lit(0).alias("low"), F.col("n").alias("high"))
    contexts = materialize(_wanted(keyed, distinct.join(several, "anchor", "left_semi")).mapInPandas(_context_bytes, "anchor bigint, context bigint, weight bigint, n int, bytes binary"))
    size = contexts.agg(F.sum(F.length("bytes"))).first()[0] or 0
    buckets = max(1, -(-size // BUCKET_BYTES))
    many = materialize(several.where(F.col("contexts") > together).select("anchor"))
    large = not many.isEmpty()
    few = contexts.join(many, "anchor", "left_anti") if large else contexts
    merged = few.withColumn("bucket", F.pmod(F.xxhash64("anchor"), F.lit(buckets))).groupBy("bucket").applyInPandas(_merge_bucket, "anchor bigint, context bigint, low int, high int")
    parts = merged.unionByName(alone)
    if large:
        parts = parts.unionByName(_large_anchors(contexts.join(many, "anchor", "left_semi")))
    parts = materialize(parts)
    for table in (contexts, several, distinct):
        discard(table)
    # Merged at every size: the tables grow with the corpus.
    ranges = found.join(parts.hint("merge"), ["anchor", "context"])
    span = F.struct((F.col("first") + F.col("low")).alias("low"), (F.col("first") + F.col("high") + (LENGTH - 1)).alias("high"))
    out = materialize(ranges.select("_k", "_v", span.alias("r")).groupBy("_k", "_v").agg(F.collect_list("r").alias("ranges")))
    discard(found)
    discard(parts)
    return out


def cut(text: str | None, ranges) -> tuple[bytes, int, list[bytes]]:
    """(whole text, number of removed runs, remaining pieces)."""
    raw, kept, spans, last = (text or "").encode("utf-8", "replace"), [], 0, 0
    end = -1
    for low, high in sorted((r["low"], r["high"]) for r in (ranges if ranges is not None else ())):
        if low > end:
            spans += 1
            kept.append(raw[last:low])
        end = max(end, high)
        last = end
    kept.append(raw[last:])
    return raw, spans, kept


def _cut_rows(frames):
    for frame in frames:
        rows = []
        for doc_id, text, ranges in zip(frame["doc_id"], frame["text"], frame["ranges"] if "ranges" in frame else [None] * len(frame)):
            raw, spans, kept = cut(text, ranges)
            digest, left = hashlib.sha256(), 0
            for piece in kept:
                digest.update(piece)
                left += len(piece)
            rows.append((doc_id, len(raw), len(raw) - left, spans, digest.hexdigest()))
        yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _held(frames, words: np.ndarray, wanted: bool):
    """The rows whose key may be in a bitmap, or those whose key surely isn't."""
    for frame in frames:
        yield frame[holds(words, frame["_h"].to_numpy(dtype=np.int64).view(np.uint64)) == wanted]


def op7_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    """The contract's columns for every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    keyed = row_keys(docs)
    ranges = repeated_ranges(keyed, TOGETHER)
    held = spark.sparkContext.broadcast(bitmap(ranges.select(F.xxhash64("_k", "_v").alias("v")), ranges.count()))
    # Only texts that may lose something meet their ranges; the others are hashed where they are read.
    # doc_id goes through Python as text: beside nulls it would become a double.
    rows = keyed.select(F.col("doc_id").cast("string").alias("doc_id"), "_k", "_v", "text", F.xxhash64("_k", "_v").alias("_h"))
    some = rows.mapInPandas(lambda frames: _held(frames, held.value, True), rows.schema).join(ranges.hint("merge"), ["_k", "_v"], "left").select("doc_id", "text", "ranges")
    schema = "doc_id string, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    none = rows.mapInPandas(lambda frames: _cut_rows(_held(frames, held.value, False)), schema)
    return some.mapInPandas(_cut_rows, schema).unionByName(none).withColumn("doc_id", F.col("doc_id").cast("bigint"))
