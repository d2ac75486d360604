"""An inverted-file index over vectors: cells of a k-means, packed blocks as Parquet partitions, probed by a cell join.

Every vector is filed in the cell of its nearest centroid. A cell's rows lie in blocks of at most
BLOCK vectors, each one row of the table: the ids, an 8-bit code of each vector's residual from the
centroid, and the vectors. A search joins the cells that each query probes with their blocks, ranks
by codes, which are a quarter of the vectors, and reads vectors only of the blocks that hold one of a
query's candidates, to score these exactly. With exact=True every cell is probed and every vector
scored. A large cell is many blocks, and the queries of a cell come in blocks as well, so that no
task meets more than a block of each, and no pair of rows is ever a row of its own.

The centroids are fitted on at most about SAMPLE vectors; every row is indexed, whatever the sample.
How many cells a search probes is measured, not guessed: about ASKED of the vectors are searched for
exactly, and the fewest nearest cells that hold the target share of what they find are probed. An
upsert rewrites the cells that its ids leave or enter, and no others.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from minuteflow.session import delete, materialize

#: Rows of a block, vectors that the centroids are fitted on, and cells at most.
BLOCK, SAMPLE, MAX_CELLS = 1024, 50_000, 4096
#: Vectors whose distances to all cells a task holds at once.
NEAR = 256
#: Vectors that the probes are measured on, the share of the best TOP that they should find, and candidates for each result that are scored exactly.
ASKED, TOP, RECALL, REFINE = 200, 10, 0.95, 8


def cells_for(n: int) -> int:
    """About as many cells as a cell has rows."""
    return int(min(MAX_CELLS, max(1, round(np.sqrt(n)))))


def _rows(series: pd.Series, dimension: int) -> np.ndarray:
    return np.array(series.to_list(), dtype=np.float32).reshape(len(series), dimension)


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1; zero rows stay."""
    rows = rows.astype(np.float64)
    norms = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0)


def encode(units: np.ndarray, centroid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """8-bit residuals, and the step of each row."""
    residual = units - centroid
    step = np.maximum(np.abs(residual).max(axis=1), 1e-12) / 127
    return np.rint(residual / step[:, None]).astype(np.int8), step.astype(np.float32)


def _packed(parts: Iterator[pd.DataFrame], centroids: np.ndarray, key: str) -> Iterator[pd.DataFrame]:
    """Rows (cell, key, vector), those of a cell together -> blocks; what a block lacks at a batch's end is filled from the next."""
    context, number, kept = TaskContext.get(), 0, None

    def blocks(frame: pd.DataFrame, last: bool):
        nonlocal number, kept
        out, at = [], 0
        cells = frame["cell"].to_numpy()
        ends = np.append(np.flatnonzero(np.diff(cells)) + 1, len(frame))
        for end in ends.tolist():
            while end - at >= BLOCK or (end > at and (last or end < len(frame))):
                piece = frame.iloc[at : min(at + BLOCK, end)]
                rows, cell = _rows(piece["vector"], centroids.shape[1]), int(cells[at])
                codes, steps = encode(unit(rows), centroids[cell])
                out.append((cell, f"{context.taskAttemptId()}-{number}", piece[key].to_list(), codes.tobytes(), steps.tobytes(), rows.tobytes()))
                number, at = number + 1, at + len(piece)
        kept = frame.iloc[at:] if at < len(frame) else None
        return pd.DataFrame(out, columns=["cell", "block", "ids", "codes", "steps", "vectors"])

    for part in parts:
        yield blocks(part if kept is None else pd.concat([kept, part]), False)
    if kept is not None:
        yield blocks(kept, True)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The places of the k greatest scores, equal ones by id, for one query."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= least)
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ids[near], -scores[near]))[:k]]


@dataclass(frozen=True)
class VectorIndex:
    """path: Parquet partitioned by cell; centroids: a row for each cell; key: the name of the ids; probes: cells that a search probes."""

    path: str
    centroids: np.ndarray
    key: str
    key_type: str
    probes: int = 1

    @property
    def dimension(self) -> int:
        return self.centroids.shape[1]

    def blocks(self, spark: SparkSession) -> DataFrame:
        schema = f"block string, ids array<{self.key_type}>, codes binary, steps binary, vectors binary, cell int"
        return spark.read.schema(schema).parquet(self.path)

    def nearest_cells(self, vector: Column, n: int) -> Column:
        """The n nearest cells of each vector, as an array."""
        centroids, dimension, step = self.centroids, self.dimension, NEAR

        @F.pandas_udf("array<int>")
        def nearest(vectors: pd.Series) -> pd.Series:
            # Nearest by distance to the centroid; the vector's own length doesn't matter.
            found, half = [], (centroids * centroids).sum(axis=1) / 2
            for at in range(0, len(vectors), step):
                distance = half - unit(_rows(vectors.iloc[at : at + step], dimension)) @ centroids.T
                found += np.argsort(distance, axis=1, kind="stable")[:, :n].astype(np.int32).tolist()
            return pd.Series(found)

        return nearest(vector)

    def _sound(self, rows: DataFrame, key: str) -> DataFrame:
        return rows.where(F.col(key).isNotNull() & (F.size("vector") == self.dimension) & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x)))

    def _write(self, rows: DataFrame) -> None:
        """rows (cell, key, vector) as blocks; the cells among them are replaced."""
        centroids, key = self.centroids, self.key
        # Rows of a cell come together, and a large cell is split between tasks as the sizes demand.
        dealt = rows.hint("rebalance", "cell").sortWithinPartitions("cell")
        packed = dealt.mapInPandas(lambda parts: _packed(parts, centroids, key), f"cell int, block string, ids array<{self.key_type}>, codes binary, steps binary, vectors binary")
        packed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("cell").parquet(self.path)

    def upsert(self, rows: DataFrame) -> list[int]:
        """rows (key, vector) take the place of those of equal ids; the cells that changed."""
        spark, key = rows.sparkSession, self.key
        fresh = self._sound(rows.select(key, "vector"), key).dropDuplicates([key]).withColumn("cell", self.nearest_cells(F.col("vector"), 1)[0])
        fresh = materialize(fresh.select("cell", key, "vector"))
        stored = self.blocks(spark).select("cell", F.explode("ids").alias(key))
        left = stored.join(fresh.select(key), key, "left_semi").select("cell").distinct()
        changed = sorted(r["cell"] for r in left.union(fresh.select("cell").distinct()).distinct().collect())
        if not changed:
            return []
        rest = self._unpacked(self.blocks(spark).where(F.col("cell").isin(changed))).join(fresh.select(key), key, "left_anti")
        whole = materialize(rest.select("cell", key, "vector").unionByName(fresh))
        self._write(whole)
        kept = {r["cell"] for r in whole.select("cell").distinct().collect()}
        for cell in set(changed) - kept:
            delete(spark, f"{self.path}/cell={cell}")
        return changed

    def _unpacked(self, blocks: DataFrame) -> DataFrame:
        key, dimension = self.key, self.dimension

        def rows(parts):
            for part in parts:
                for cell, ids, vectors in zip(part["cell"], part["ids"], part["vectors"]):
                    yield pd.DataFrame({"cell": cell, key: list(ids), "vector": list(np.frombuffer(vectors, dtype=np.float32).reshape(-1, dimension))})

        return blocks.select("cell", "ids", "vectors").mapInPandas(rows, f"cell int, {key} {self.key_type}, vector array<float>")

    def search(self, queries: DataFrame, k: int = 10, threshold: float | None = None, probes: int | None = None, exact: bool = False, query_key: str = "query_id") -> DataFrame:
        """queries (query_key, vector) -> (query_key, key, score, rank): the k best of each by cosine, equal scores by id.

        Queries without a sound vector have no results; a threshold of None or 0 passes all.
        """
        best = self._search(queries, k, probes or self.probes, exact, query_key)
        if threshold:
            best = best.where(F.col("score") >= threshold)
        return best.select(query_key, self.key, "score", "rank")

    def _search(self, queries: DataFrame, k: int, probes: int, exact: bool, query_key: str) -> DataFrame:
        spark = queries.sparkSession
        dimension, centroids, most = self.dimension, self.centroids, k if exact else k * REFINE
        n = len(centroids) if exact else min(probes, len(centroids))
        sound = self._sound(queries.select(query_key, "vector"), query_key)
        query_type = dict(sound.dtypes)[query_key]
        probed = sound.select(query_key, "vector", F.explode(self.nearest_cells(F.col("vector"), n)).alias("cell"))
        # The queries of a cell in blocks: dealt by their hash, so that a block's size has a bound in expectation.
        n_blocks = max(1, -(-sound.count() // BLOCK))
        dealt = probed.withColumn("deal", F.pmod(F.xxhash64(query_key), F.lit(n_blocks)))
        asked = dealt.groupBy("cell", "deal").agg(F.collect_list(F.struct(F.col(query_key).alias("q"), "vector")).alias("asked"))
        column = ("vectors",) if exact else ("codes", "steps")
        met = self.blocks(spark).select("cell", "block", "ids", *column).join(asked, "cell")

        def ranked(parts):
            for part in parts:
                found = []
                for at in range(len(part)):
                    row = part.iloc[at]
                    ids = np.asarray(row["ids"])
                    rows = unit(_rows(pd.Series([a["vector"] for a in row["asked"]]), dimension))
                    if exact:
                        scores = rows @ unit(np.frombuffer(row["vectors"], dtype=np.float32).reshape(-1, dimension)).T
                    else:
                        codes, steps = np.frombuffer(row["codes"], dtype=np.int8).reshape(-1, dimension), np.frombuffer(row["steps"], dtype=np.float32)
                        scores = (rows @ centroids[int(row["cell"])])[:, None] + (rows.astype(np.float32) @ codes.T.astype(np.float32)) * steps
                    for one, asked in zip(scores, row["asked"]):
                        best = _best(one, ids, most)
                        found.append(pd.DataFrame({query_key: asked["q"], "cell": row["cell"], "block": row["block"], "slot": best, self_key: ids[best], "score": one[best]}))
                if found:
                    yield pd.concat(found)

        self_key = self.key
        # A pair of blocks at a time: a batch of rows would hold thousands of them.
        candidates = met.groupBy("cell", "block", "deal").applyInPandas(lambda pair: pd.concat(ranked([pair])), f"{query_key} {query_type}, cell int, block string, slot int, {self_key} {self.key_type}, score double")
        place = Window.partitionBy(query_key).orderBy(F.desc("score"), self_key)
        best = candidates.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= most)
        if not exact:
            best = self._rescored(best, sound, query_key, query_type).withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
        return best

    def measured(self, rows: DataFrame, n: int, recall: float = RECALL, k: int = TOP) -> VectorIndex:
        """This index with as many probes as it takes to find the share recall of the k best of about ASKED of n rows (key, vector)."""
        modulus = 1_000_003
        sample = rows.where(F.pmod(F.xxhash64(self.key, F.lit("asked")), F.lit(modulus)) <= int(modulus * min(1.0, ASKED / n)))
        asked = materialize(self._sound(sample, self.key).select(F.col(self.key).alias("_q"), "vector"))
        found = self._search(asked, k, 1, True, "_q").select("_q", "cell")
        near = asked.select("_q", self.nearest_cells(F.col("vector"), len(self.centroids)).alias("cells"))
        needed = found.join(near, "_q").groupBy(F.array_position("cells", F.col("cell")).alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect()
        total, seen = sum(r["n"] for r in needed), 0
        for r in needed:
            seen += r["n"]
            if seen >= recall * total:
                return replace(self, probes=int(r["p"]))
        return self

    def _rescored(self, candidates: DataFrame, queries: DataFrame, query_key: str, query_type: str) -> DataFrame:
        """The candidates with exact scores, from the blocks that hold them."""
        dimension, key = self.dimension, self.key
        wanted = candidates.select(query_key, "cell", "block", "slot", key).join(queries, query_key)
        n_blocks = max(1, -(-queries.count() // BLOCK))
        grouped = wanted.groupBy("cell", "block", F.pmod(F.xxhash64(query_key), F.lit(n_blocks)).alias("deal")).agg(F.collect_list(F.struct(F.col(query_key).alias("q"), "slot", F.col(key).alias("k"), "vector")).alias("asked"))
        held = self.blocks(queries.sparkSession).select("cell", "block", "vectors").join(grouped, ["cell", "block"])

        def scored(parts):
            for part in parts:
                found = []
                for vectors, asked in zip(part["vectors"], part["asked"]):
                    rows = np.frombuffer(vectors, dtype=np.float32).reshape(-1, dimension)
                    own = unit(rows[[a["slot"] for a in asked]])
                    given = unit(_rows(pd.Series([a["vector"] for a in asked]), dimension))
                    found.append(pd.DataFrame({query_key: [a["q"] for a in asked], key: [a["k"] for a in asked], "score": (own * given).sum(axis=1)}))
                if found:
                    yield pd.concat(found)

        return held.groupBy("cell", "block", "deal").applyInPandas(lambda pair: pd.concat(scored([pair])), f"{query_key} {query_type}, {key} {self.key_type}, score double")


def build(rows: DataFrame, path: str, key: str = "id", n_cells: int | None = None, recall: float = RECALL, seed: int = 42) -> VectorIndex:
    """rows (key, vector) as an index at path, a new folder that all executors share.

    The dimension is that of most sampled vectors; rows with another, or without an id, are left out
    (vectors.wrong_dimension tells them), rows of one id are one of them. Zero vectors score 0.
    """
    rows = rows.select(key, "vector")
    sizes = rows.where("vector is not null and size(vector) > 0").groupBy(F.size("vector").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").first()
    if sizes is None:
        raise ValueError("there are no vectors to index")
    dimension, n = sizes["size"], sizes["n"]
    typed = VectorIndex(path, np.zeros((1, dimension)), key, dict(rows.dtypes)[key])
    sound = typed._sound(rows, key).dropDuplicates([key])
    wanted = n_cells or cells_for(n)
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    units = sound.where(F.pmod(F.xxhash64(key), F.lit(1_000_003)) <= int(1_000_003 * min(1.0, SAMPLE / n))).withColumn("l", length).where("l > 0")
    features = materialize(units.select(array_to_vector(F.transform("vector", lambda x: x.cast("double") / F.col("l"))).alias("features")))
    if features.isEmpty():
        centroids = np.zeros((1, dimension))
    else:
        model = KMeans(k=max(2, wanted), seed=seed, maxIter=15, initSteps=2).fit(features)
        centroids = np.array(model.clusterCenters(), dtype=np.float64) if wanted > 1 else np.zeros((1, dimension))
    index = VectorIndex(path, centroids, key, typed.key_type)
    index._write(sound.select(index.nearest_cells(F.col("vector"), 1)[0].alias("cell"), key, "vector"))
    return index.measured(rows, n, recall)
