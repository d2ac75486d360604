"""Merkle manifest of a dataset as a SHA-256 midstate tree.

A row is a leaf; the leaves of a group stand in order of their key, and runs of ARITY consecutive
nodes become their parent until one node, the group's subroot, is left. The subroots make the root
in the same way. A parent keeps a copy of its hash state before each child slot (Parent), so that a
changed child is folded by resuming that state with the replacement and the siblings to its right.

The tree is built and read in pieces of PIECE consecutive nodes, each LEVELS levels high, so no
task holds more than a piece however large a group is: place() numbers the nodes by a range sort
and the counts of its partitions, up() turns pieces into their roots until every tree has one node,
down() hands each node the siblings on its path to the root. A path grows with the tree's height
only, and is kept once for a piece, not for a row.

Defined cases: a null field is "-"; rows without a group are a group of their own, the first; rows
with a null key come first, and rows of one key stand in order of their leaves; repeated rows are
leaves of their own; empty and very long texts are hashed whole; a null key is never tampered with;
an empty table gives an empty result; extra columns don't matter, whatever their names.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from minuteflow.session import materialize

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Children of a parent, levels of a piece, and the nodes it holds.
ARITY, LEVELS = 8, 3
PIECE = ARITY**LEVELS


class Parent:
    """A node over children (hex digests as bytes), with the hash state before each of them."""

    def __init__(self, children: list[bytes]) -> None:
        self.children, self.states, state = children, [], hashlib.sha256()
        for child in children:
            self.states.append(state.copy())
            state.update(child)
        self.digest = state.hexdigest().encode()

    def fold(self, slot: int, replacement: bytes) -> bytes:
        """The digest with another child at slot: its kept state, resumed."""
        state = self.states[slot].copy()
        state.update(replacement)
        for sibling in self.children[slot + 1 :]:
            state.update(sibling)
        return state.hexdigest().encode()


def piece_levels(digests: list[bytes], n: int) -> list[list[Parent]]:
    """The levels of parents over one piece of a tree of n nodes: LEVELS of them, or as many as the whole tree has."""
    levels, nodes = [], digests
    while len(levels) < LEVELS and (n > PIECE or len(nodes) > 1):
        parents = [Parent(nodes[at : at + ARITY]) for at in range(0, len(nodes), ARITY)]
        levels.append(parents)
        nodes = [p.digest for p in parents]
    return levels


def leaf(values: dict[str, Column]) -> Column:
    """The leaf's digest as 32 bytes, from the fields in order."""
    parts = []
    for value in values.values():
        text = value.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def place(nodes: DataFrame, *order: str) -> DataFrame:
    """nodes (tree, ...) with pos, from 0 in each tree, and n, the nodes of the tree.

    Rows are range-sorted by tree and order, so a large tree spreads over many partitions; what is
    counted and windowed is one row for each tree of each partition.
    """
    by = [F.col("tree"), *[F.col(c).asc_nulls_first() for c in order]]
    placed = materialize(nodes.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33).alias("_part")
    earlier = Window.partitionBy("tree").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("tree", part).agg(F.min("_id").alias("_first"), F.count("*").alias("_count"))
    offsets = counts.select("tree", "_part", (F.coalesce(F.sum("_count").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_count").over(Window.partitionBy("tree")).alias("n"))
    return placed.withColumn("_part", F.shiftright("_id", 33)).join(offsets, ["tree", "_part"]).withColumn("pos", F.col("_id") + F.col("_shift")).drop("_id", "_part", "_shift")


def _piece() -> Column:
    return F.floor(F.col("pos") / PIECE).cast("bigint").alias("piece")


def up(nodes: DataFrame) -> DataFrame:
    """nodes (tree, pos, n, digest) -> the roots of their pieces in the same form; a tree of one node keeps it."""

    def root(frame: pd.DataFrame) -> pd.DataFrame:
        frame, n = frame.sort_values("pos"), int(frame["n"].iloc[0])
        levels = piece_levels([d.hex().encode() for d in frame["digest"]], n)
        digest = bytes.fromhex(levels[-1][0].digest.decode()) if levels else frame["digest"].iloc[0]
        return pd.DataFrame({"tree": [frame["tree"].iloc[0]], "pos": [int(frame["pos"].iloc[0]) // PIECE], "n": [-(-n // PIECE)], "digest": [digest]})

    return nodes.select("tree", "pos", "n", "digest").groupBy("tree", _piece()).applyInPandas(root, "tree string, pos bigint, n bigint, digest binary")


def _paths(frame: pd.DataFrame, above: pd.DataFrame) -> tuple[list[list[Parent]], list[bytes], list[bytes]]:
    """A piece's levels, and the siblings to the left and right on the path from its root to the top."""
    levels = piece_levels([d.hex().encode() for d in frame["digest"]], int(frame["n"].iloc[0]))
    return levels, list(above["left"].iloc[0]), list(above["right"].iloc[0])


def _slots(levels: list[list[Parent]], k: int):
    """The parent and slot of the piece's k-th node on each level."""
    for parents in levels:
        yield parents[k // ARITY], k % ARITY
        k //= ARITY


def down(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """(tree, pos, left, right): the siblings of each node on its path, level by level, from those of its piece's root."""

    def path(frame: pd.DataFrame, piece: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("pos")
        levels, left, right = _paths(frame, piece)
        lefts, rights = [], []
        for k in range(len(frame)):
            on = list(_slots(levels, k))
            lefts.append([b"".join(p.children[:slot]) for p, slot in on] + left)
            rights.append([b"".join(p.children[slot + 1 :]) for p, slot in on] + right)
        return pd.DataFrame({"tree": frame["tree"].to_numpy(), "pos": frame["pos"].to_numpy(), "left": lefts, "right": rights})

    pieces = nodes.select("tree", "pos", "n", "digest").groupBy("tree", _piece())
    return pieces.cogroup(above.groupBy("tree", F.col("pos").alias("piece"))).applyInPandas(path, "tree string, pos bigint, left array<binary>, right array<binary>")


def folded(leaves: DataFrame, above: DataFrame) -> DataFrame:
    """(key, digest, proof, folded_root) of each leaf: the digest of its siblings up to the root, and the root that its candidate folds to."""

    def fold(frame: pd.DataFrame, piece: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("pos")
        levels, left, right = _paths(frame, piece)
        siblings = b"".join(part for pair in zip(left, right) for part in pair)
        resumed = [hashlib.sha256(part) for part in left]
        proofs, roots = [], []
        for k, candidate in enumerate(frame["candidate"]):
            proof, node = hashlib.sha256(), candidate.hex().encode()
            for parent, slot in _slots(levels, k):
                for at, child in enumerate(parent.children):
                    if at != slot:
                        proof.update(child)
                node = parent.fold(slot, node)
            proof.update(siblings)
            for state, rest in zip(resumed, right):
                state = state.copy()
                state.update(node)
                state.update(rest)
                node = state.hexdigest().encode()
            proofs.append(proof.hexdigest())
            roots.append(node.decode())
        return pd.DataFrame({"key": frame["key"].to_numpy(), "tree": frame["tree"].to_numpy(), "leaf": [d.hex() for d in frame["digest"]], "proof": proofs, "folded_root": roots})

    pieces = leaves.select("tree", "pos", "n", "digest", "candidate", "key").groupBy("tree", _piece())
    return pieces.cogroup(above.groupBy("tree", F.col("pos").alias("piece"))).applyInPandas(fold, "key string, tree string, leaf string, proof string, folded_root string")


@dataclass
class Manifest:
    """A built manifest: passes[0] are the leaves (tree, key, digest, candidate, pos, n), later ones the roots of pieces."""

    passes: list[DataFrame]
    top: list[DataFrame]
    #: (tree, digest); "0" is the tree of the rows without a group, "1..." that of the group named after the 1.
    subroots: DataFrame
    root: str | None

    def proofs(self) -> DataFrame:
        """(key, leaf, subroot, root, proof, folded_root) of every leaf; a row verifies if folded_root is root."""
        spark = self.subroots.sparkSession
        paths = spark.sql("select '' as tree, 0L as pos, cast(array() as array<binary>) as left, cast(array() as array<binary>) as right")
        for nodes in reversed(self.top[:-1]):
            paths = materialize(down(nodes, paths))
        # The path of a subroot in the top tree is where the paths of its group's tree begin.
        paths = materialize(self.top[0].select("pos", F.col("group").alias("tree")).join(paths.drop("tree"), "pos").withColumn("pos", F.lit(0).cast("bigint")))
        for nodes in reversed(self.passes[1:-1]):
            paths = materialize(down(nodes, paths))
        if len(self.passes) > 1:
            rows = folded(self.passes[0], paths)
        else:
            rows = self.passes[0].select("key", "tree", F.lower(F.hex("digest")).alias("leaf"), F.lit("").alias("proof"), F.lit("").alias("folded_root")).limit(0)
        subroots = self.subroots.select("tree", F.lower(F.hex("digest")).alias("subroot"))
        return rows.join(subroots, "tree").select("key", "leaf", "subroot", F.lit(self.root).cast("string").alias("root"), "proof", "folded_root")


def _passes(nodes: DataFrame) -> list[DataFrame]:
    """nodes, and the roots of pieces of pieces until every tree has one node; at least one pass is made over nodes that aren't empty."""
    passes, largest = [nodes], nodes.agg(F.max("n")).first()[0]
    while largest:
        passes.append(materialize(up(passes[-1])))
        if largest <= PIECE:
            break
        largest = -(-largest // PIECE)
    return passes


def build(docs: DataFrame, key: str = "doc_id", group: str = "lang", fields: tuple[str, ...] = FIELDS, candidate: dict[str, Column] | None = None) -> Manifest:
    """The manifest of docs; candidate gives other values of fields, whose leaf each row folds in proofs()."""
    values = {name: F.col(f"`{name}`") for name in fields}
    tree = F.coalesce(F.concat(F.lit("1"), F.col(f"`{group}`").cast("string")), F.lit("0"))
    own, other = leaf(values), leaf(values | (candidate or {})) if candidate else None
    rows = docs.select(F.col(f"`{key}`").alias("_order"), tree.alias("tree"), own.alias("digest"), (F.lit(None).cast("binary") if other is None else other).alias("_other"), F.monotonically_increasing_id().alias("_row"))
    # Range sorting samples its input, so the digests are written first: texts are read and hashed once.
    placed = place(materialize(rows), "_order", "digest", "_row")
    leaves = materialize(placed.select("tree", F.col("_order").cast("string").alias("key"), "digest", F.coalesce("_other", "digest").alias("candidate"), "pos", "n"))
    passes = _passes(leaves)
    subroots = passes[-1].where("n = 1").select("tree", "digest")
    top = _passes(materialize(place(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("group"), "digest"), "group")))
    last = top[-1].where("n = 1").first()
    return Manifest(passes, top, subroots, last and last["digest"].hex())


def op11_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    """The contract's columns for every document: where 3 divides the checksum of doc_id, its text is tampered with."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*FIELDS)
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = build(docs, candidate={"text": F.when(tampered, lowered).otherwise(F.col("text"))}).proofs()
    return rows.select(F.col("key").cast("bigint").alias("doc_id"), "leaf", "subroot", "root", F.col("proof").alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


#: CRC-32 of a short decimal: a digit is mixed in, then eight shifts, each a -1.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(string_split(doc_id::varchar, ''), lambda ch: [ascii(ch)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda acc, x: case when x >= 0 then xor(acc, x) when acc & 1 = 1 then xor(acc >> 1, 3988292384) else acc >> 1 end))"""


def _leaf_sql(text: str) -> str:
    values = [text if name == "text" else f"{name}::varchar" for name in FIELDS]
    return "sha256(" + " || ".join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in values) + ")"


#: The trees level by level; path has a leaf's position on each level, those of the top tree counting on from its subroot.
ORACLE_SQL = f"""
with recursive base as (
    select doc_id, lang, coalesce('1' || lang, '0') as tree, {_leaf_sql("text")} as leaf,
           case when {_CRC} % 3 = 0 then {_leaf_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} else {_leaf_sql("text")} end as candidate from documents),
d as (select *, row_number() over () as id, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as pos from base),
nodes(tree, level, pos, digest, n) as (
    select tree, 0, pos, leaf, count(*) over (partition by tree) from d
    union all
    select tree, level + 1, pos // 8, sha256(string_agg(digest, '' order by pos)), (any_value(n) + 7) // 8 from nodes where n > 1 group by tree, level, pos // 8),
subroots as (select tree, level as height, digest as subroot, row_number() over (order by tree) - 1 as place from nodes where n = 1),
tops(level, pos, digest, n) as (
    select 0, place, subroot, count(*) over () from subroots
    union all
    select level + 1, pos // 8, sha256(string_agg(digest, '' order by pos)), (any_value(n) + 7) // 8 from tops where n > 1 group by level, pos // 8),
ways as (select d.*, s.height, s.subroot, s.place, (select max(level) from tops) as above from d join subroots s using (tree)),
path as (select id, tree, height, level, case when level < height then pos // (8 ** level)::bigint else place // (8 ** (level - height))::bigint end as spot
         from (select *, unnest(range(0, height + above)) as level from ways)),
near as (
    select p.id, p.level, p.spot, x.pos, x.digest from path p join nodes x on x.tree = p.tree and x.level = p.level and p.level < p.height and x.pos // 8 = p.spot // 8
    union all
    select p.id, p.level, p.spot, x.pos, x.digest from path p join tops x on x.level = p.level - p.height and p.level >= p.height and x.pos // 8 = p.spot // 8),
steps as (select id, level, coalesce(string_agg(digest, '' order by pos) filter (pos < spot), '') as heads, coalesce(string_agg(digest, '' order by pos) filter (pos > spot), '') as tails from near group by id, level),
proofs as (select id, sha256(string_agg(heads || tails, '' order by level)) as proof from steps group by id),
walk(id, level, node) as (
    select id, 0, candidate from d
    union all
    select w.id, w.level + 1, sha256(s.heads || w.node || s.tails) from walk w join steps s on s.id = w.id and s.level = w.level),
ends as (select id, node from walk qualify row_number() over (partition by id order by level desc) = 1)
select w.doc_id, w.leaf, w.subroot, r.digest as root, coalesce(p.proof, sha256('')) as proof_sha256, e.node as folded_root, e.node = r.digest as verified
from ways w join ends e using (id) left join proofs p using (id) cross join (select digest from tops where n = 1) r
"""
