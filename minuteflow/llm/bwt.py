"""Merging Burrows-Wheeler transforms of several shards of strings by interleave refinement.

The alphabet is any set of integer codes; code 0 ends a string. A shard's transform lists, in the
sorted order of its suffixes, the symbol before each one. The merge never compares suffixes of
different shards: it starts from the shards one after the other and refines the interleave. A
round deals the shard numbers, in their present order, into buckets of the preceding symbols, so
after h rounds the interleave is that of suffixes sorted by h symbols; the positions at which
buckets part in round h have a common prefix of h - 1 symbols with what stands before them.
"""

from __future__ import annotations

import numpy as np


def shard_order(codes: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of one shard's strings (code 0 at each string's end) sorted by at least depth symbols, ties by place."""
    n = len(codes)
    end = np.flatnonzero(codes == 0)
    # What follows a string's end is nothing, whatever string comes next.
    last = end[np.searchsorted(end, np.arange(n))]
    rank, span = codes.astype(np.int64), 1
    while True:
        ahead = np.arange(n) + span
        inside = ahead <= last
        follow = np.zeros(n, dtype=np.int64)
        follow[inside] = rank[ahead[inside]] + 1
        key = rank * (int(follow.max(initial=0)) + 1) + follow
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        span *= 2
        if span >= depth:
            return order
        new = np.empty(n, dtype=np.int64)
        new[order] = np.cumsum(np.append(0, ordered[1:] != ordered[:-1]))
        rank = new


def transform(codes: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The symbol before each suffix; a string's first suffix is preceded by its end."""
    return np.where(order > 0, codes[order - 1], 0)


def radix_order(codes: np.ndarray) -> np.ndarray:
    """Stable order of non-negative codes below 2 ** 32, in two passes of 16 bits."""
    order = np.argsort((codes & 0xFFFF).astype(np.uint16), kind="stable")
    high = (codes >> 16).astype(np.uint16)
    if high.any():
        order = order[np.argsort(high[order], kind="stable")]
    return order


def merge(transforms: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(interleave, common): the shard of each suffix in merged order, and the symbols, at most depth,
    that it has in common with the suffix before it.

    The ends of strings differ from each other, in the order of shards and strings, so a common
    prefix never spans two strings.
    """
    shard = np.repeat(np.arange(len(transforms), dtype=np.uint8), [len(t) for t in transforms])
    symbols = np.concatenate(transforms)
    n, ends = len(symbols), int((symbols == 0).sum())
    common = np.full(n, depth, dtype=np.int32)
    common[:1] = 0
    #: Number of the bucket, by the symbols seen so far, of each place of the interleave.
    block = np.zeros(n, dtype=np.int32)
    for h in range(1, depth + 1):
        # The k-th place that a shard has in the interleave belongs to the k-th entry of its transform.
        preceding = np.empty_like(symbols)
        preceding[np.argsort(shard, kind="stable")] = symbols
        order = radix_order(preceding)
        order[:ends] = order[:ends][np.argsort(shard[order[:ends]], kind="stable")]
        symbol, was = preceding[order], block[order]
        opens = np.append(True, (symbol[1:] != symbol[:-1]) | (was[1:] != was[:-1]))[:n]
        opens[:ends] = True
        common[opens & (common >= h)] = h - 1
        shard = shard[order]
        block = np.cumsum(opens, dtype=np.int32)
        if block[-1:] == n:
            break
    return shard, common


def merged_suffixes(orders: list[np.ndarray], interleave: np.ndarray) -> np.ndarray:
    """The suffix, numbered through all shards, at each place of the interleave."""
    first = np.append(0, np.cumsum([len(o) for o in orders])[:-1])
    out = np.empty(len(interleave), dtype=np.int64)
    out[np.argsort(interleave, kind="stable")] = np.concatenate([o + f for o, f in zip(orders, first)])
    return out
