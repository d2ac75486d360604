"""Quality classifier by positive-unlabelled learning with a non-negative unbiased risk.

Trusted positives are labelled rows of quality 1; all texts are the unlabelled ones, whatever their
label, and negative labels are never read. A text becomes FEATURES ratios of its whole bytes and
words; each is cut at quantiles of all texts, so that the model g(x) = w.x is additive over the
cells of its features. With the squared loss (1 - yz)^2 / 4 the unbiased risk

    prior * E_P[loss(+)] + max(0, E_U[loss(-)] - prior * E_P[loss(-)])

depends on the data only through counts: how many texts fall in each pair of cells, over all
unlabelled texts and over all positives. Spark sums these in one pass over the whole table; the risk
is then minimised on the driver over a matrix of bounded size (CELLS cells a feature), with the
non-negative part's own gradient wherever it turns negative. Nothing is sampled.

The class prior is estimated, not taken from labels: the least ratio of unlabelled to positive texts
beyond a threshold of g (best bin, with a margin for chance). Texts are halved by a hash of their
features, so that copies stay together; a model of each half gives g to the other, and histograms of
all texts are gathered so. Model and prior are fitted in turns ROUNDS times. score is the logistic function of 2 g, so score >= 0.5 is the
model's own decision.

Defined cases: null and empty texts have all features 0 and get a score like others; labels for
unknown documents and null ids don't matter; a document whose labels disagree isn't trusted; repeated
rows get the same score, and count each; without any positive every score is 0.5; very long texts are
read whole; an empty table gives an empty result; extra columns don't matter.
"""

from __future__ import annotations

import json
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from minuteflow.llm.op5_quality import STOP_WORDS
from minuteflow.session import materialize

FEATURES = (
    "upper", "digit", "space", "line", "stop", "mark", "symbol", "pipe", "wide", "exclaim", "word_length", "short_words", "long_words", "stop_words",
    "distinct", "again", "top_word", "marked_words", "capital_words", "lines", "same_lines", "log_words",
)
#: Quantiles of all texts at which a feature is cut; the tails matter most.
QUANTILES = (0.01, 0.03, 0.06, 0.1, 0.2, 0.35, 0.5, 0.65, 0.8, 0.9, 0.94, 0.97, 0.99)
CELLS = len(QUANTILES) + 1
ROUNDS, STEPS, BINS, CHANCE = 3, 200, 400, 0.05
#: Weights are shrunk by this much, and more with few positives.
RIDGE, FEW = 3e-4, 8.0
_STOP = frozenset(w.encode() for w in STOP_WORDS)
# Classes of bytes: letters are 0 but for capitals.
_CLASSES = np.zeros(256, dtype=np.int64)
for _k, _bytes in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\v\f", b"\n", b".?", b",;:'\"()-", b"#*$%&<>@^~_=+/\\{}[]`", b"|", bytes(range(128, 256)), b"!"), 1):
    _CLASSES[list(_bytes)] = _k


def features(text: str | None) -> list[float]:
    """FEATURES of a whole text."""
    data = (text or "").encode("utf-8", "replace")
    words = data.split()
    if not words:
        return [0.0] * len(FEATURES)
    classes = np.bincount(_CLASSES[np.frombuffer(data, dtype=np.uint8)], minlength=11)[1:] / len(data)
    n, lengths = len(words), np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    counts = Counter(words)
    again = sum(map(bytes.__eq__, words, words[1:]))
    marked = sum(c for w, c in counts.items() if not w[-1:].isalnum() and w[-1] < 128 and w[-1:] not in b".,")
    capital = sum(c for w, c in counts.items() if w[:2].isupper() and len(w) > 1)
    lines = [line for line in data.split(b"\n") if line.strip()]
    return [
        *classes.tolist(),
        float(lengths.mean()),
        float((lengths <= 3).mean()),
        float((lengths >= 12).mean()),
        sum(c for w, c in counts.items() if w.lower() in _STOP) / n,
        len(counts) / n,
        again / n,
        max(counts.values()) / n,
        marked / n,
        capital / n,
        len(lines) / n,
        1 - len(set(lines)) / len(lines),
        float(np.log1p(n)),
    ]


@F.pandas_udf(T.ArrayType(T.FloatType()))
def features_udf(texts: pd.Series) -> pd.Series:
    return texts.map(features)


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows whose labels are never learned from: the checksum of the id leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


@dataclass(frozen=True)
class Model:
    """Cuts of each feature, weights of their cells (the last is the intercept) and the estimated prior."""

    cuts: tuple[tuple[float, ...], ...]
    weights: tuple[float, ...]
    prior: float

    def decide(self, rows: np.ndarray) -> np.ndarray:
        """g of feature rows."""
        w = np.asarray(self.weights)
        g = np.full(len(rows), w[-1])
        for k, cell in enumerate(cells(rows, self.cuts).T):
            g += w[k * CELLS + cell]
        return g

    def dumps(self) -> str:
        return json.dumps([self.cuts, self.weights, self.prior])

    @staticmethod
    def loads(text: str) -> Model:
        cuts, weights, prior = json.loads(text)
        return Model(tuple(map(tuple, cuts)), tuple(weights), prior)


def cells(rows: np.ndarray, cuts) -> np.ndarray:
    """The cell of each feature of each row."""
    return np.stack([np.searchsorted(np.asarray(c, dtype=np.float32), rows[:, k], side="left") for k, c in enumerate(cuts)], axis=1)


def _matrix(series: pd.Series) -> np.ndarray:
    return np.array(series.to_list(), dtype=np.float32).reshape(len(series), len(FEATURES))


def _cuts(table: DataFrame) -> tuple[tuple[float, ...], ...]:
    """The quantiles of each feature over all texts."""
    found = table.agg(*[F.percentile_approx(F.col("x")[k], list(QUANTILES), 1000).alias(name) for k, name in enumerate(FEATURES)]).first()
    return tuple(tuple(found[name] or [0.0] * len(QUANTILES)) for name in FEATURES)


def _moments(table: DataFrame, cuts) -> np.ndarray:
    """[half, positive or all]: sums of products of cells; the last row and column is the intercept."""
    size = len(FEATURES) * CELLS + 1

    def products(parts):
        total = np.zeros((2, 2, size, size))
        for part in parts:
            rows, positive, half = _matrix(part["x"]), part["positive"].to_numpy(dtype=bool), part["half"].to_numpy()
            for at in range(0, len(rows), 4096):
                own = cells(rows[at : at + 4096], cuts) + np.arange(len(FEATURES)) * CELLS
                hot = np.zeros((len(own), size), dtype=np.float32)
                hot[np.arange(len(own))[:, None], own] = 1
                hot[:, -1] = 1
                for k in (0, 1):
                    mine = half[at : at + 4096] == k
                    total[k, 0] += hot[mine].T @ hot[mine]
                    mine &= positive[at : at + 4096]
                    total[k, 1] += hot[mine].T @ hot[mine]
        half, which, i, j = np.nonzero(np.triu(total))
        yield pd.DataFrame({"half": half, "which": which, "i": i, "j": j, "n": total[half, which, i, j]})

    sums = table.mapInPandas(products, "half int, which int, i int, j int, n double").groupBy("half", "which", "i", "j").agg(F.sum("n").alias("n")).toPandas()
    total = np.zeros((2, 2, size, size))
    total[sums["half"], sums["which"], sums["i"], sums["j"]] = sums["n"]
    return total + np.triu(total, 1).transpose(0, 1, 3, 2)


def minimise(unlabelled: np.ndarray, positive: np.ndarray, prior: float) -> np.ndarray:
    """Weights of least non-negative risk, from sums of products that end with the intercept.

    The unbiased risk is a quadratic, whose minimum is solved for. If its negative-class part comes
    out below zero there, steps follow, preconditioned by the quadratic: where the part is below
    zero they go up its own gradient alone, elsewhere down the whole risk's.
    """
    su, sp = unlabelled / unlabelled[-1, -1], positive / positive[-1, -1]
    mu, mp = su[-1], sp[-1]
    ridge = su + (RIDGE + FEW / positive[-1, -1]) * np.eye(len(su))
    best = w = np.linalg.solve(ridge, 2 * prior * mp - mu)

    def parts(w):
        negative = (1 + 2 * w @ mu + w @ su @ w) / 4 - prior * (1 + 2 * w @ mp + w @ sp @ w) / 4
        return negative, prior * (1 - 2 * w @ mp + w @ sp @ w) / 4

    negative, plus = parts(w)
    if negative >= 0:
        return w
    least = plus
    for step in range(STEPS):
        down = (mu + su @ w) / 2 - prior * (mp + sp @ w) / 2
        gradient = -down if negative < 0 else down + prior * (sp @ w - mp) / 2
        w = w - 2 / (10 + step) * np.linalg.solve(ridge, gradient)
        negative, plus = parts(w)
        if plus + max(0.0, negative) < least:
            best, least = w, plus + max(0.0, negative)
    return best


def estimated_prior(unlabelled: np.ndarray, positive: np.ndarray) -> float:
    """The least ratio of unlabelled to positive texts at or above a bin, from histograms of g; each share is given the margin of its chance error."""
    n, m = unlabelled.sum(), positive.sum()
    above_u, above_p = unlabelled[::-1].cumsum() / n, positive[::-1].cumsum() / m
    margin = np.sqrt(np.log(4 / CHANCE) / 2) * (1 / np.sqrt(n) + 1 / np.sqrt(m))
    good = above_p > margin
    if not good.any():
        return 1.0
    least = np.argmin((above_u[good] + margin) / above_p[good])
    return float(np.clip((above_u[good] / above_p[good])[least], 0.01, 0.99))


def _histograms(table: DataFrame, models: list[Model]) -> tuple[np.ndarray, np.ndarray]:
    """How many texts, and how many positives, have g in each bin of [-2, 2] by the model of the other half."""

    def binned(parts):
        total = np.zeros((2, BINS), dtype=np.int64)
        for part in parts:
            rows, half = _matrix(part["x"]), part["half"].to_numpy()
            g = np.where(half == 0, models[1].decide(rows), models[0].decide(rows))
            at = np.clip((g + 2) * BINS / 4, 0, BINS - 1).astype(np.int64)
            total[0] += np.bincount(at, minlength=BINS)
            total[1] += np.bincount(at[part["positive"].to_numpy(dtype=bool)], minlength=BINS)
        which, k = np.nonzero(total)
        yield pd.DataFrame({"which": which, "k": k, "n": total[which, k]})

    sums = table.mapInPandas(binned, "which int, k int, n bigint").groupBy("which", "k").agg(F.sum("n").alias("n")).toPandas()
    total = np.zeros((2, BINS))
    total[sums["which"], sums["k"]] = sums["n"]
    return total[0], total[1]


def fit(table: DataFrame) -> Model:
    """table (x, positive, half), a row for each text -> a model; without positives all weights are 0."""
    cuts = _cuts(table)
    moments = _moments(table, cuts)
    whole, prior = moments.sum(axis=0), 0.5
    if not moments[:, 1, -1, -1].all():
        # Too few to halve them: even odds stand in for the estimate.
        if not whole[1, -1, -1]:
            return Model(cuts, (0.0,) * len(whole[0]), 1.0)
        return Model(cuts, tuple(minimise(*whole, prior).tolist()), prior)
    for _ in range(ROUNDS):
        prior = estimated_prior(*_histograms(table, [Model(cuts, tuple(minimise(*half, prior).tolist()), prior) for half in moments]))
    return Model(cuts, tuple(minimise(*whole, prior).tolist()), prior)


def trusted(labels: DataFrame) -> DataFrame:
    """(doc_id) of the labelled rows that may be learned from and are of quality 1, once each."""
    return labels.where(~held_out() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(F.coalesce("quality", F.lit(0))).alias("quality")).where("quality = 1").select("doc_id")


def scored(table: DataFrame, model: Model) -> DataFrame:
    """table with score and predicted."""

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        return pd.Series(1 / (1 + np.exp(-2 * model.decide(_matrix(x))))) if len(x) else pd.Series([], dtype="float64")

    # The score stands on an exploded column, so that it is computed once.
    return table.withColumn("score", F.explode(F.array(score("x")))).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def classify(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, Model]:
    """(doc_id, held_out, score, predicted) of every row of docs (doc_id, text), and the model."""
    rows = materialize(docs.select("doc_id", features_udf("text").alias("x")))
    known = trusted(labels).withColumn("positive", F.lit(True))
    table = materialize(rows.join(known, "doc_id", "left").select("x", F.coalesce("positive", F.lit(False)).alias("positive"), F.xxhash64("x").bitwiseAND(F.lit(1)).cast("int").alias("half")))
    model = fit(table)
    return scored(rows, model).select("doc_id", held_out().alias("held_out"), "score", "predicted"), model


def op12_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """The contract's columns for every document."""
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"))[0]
