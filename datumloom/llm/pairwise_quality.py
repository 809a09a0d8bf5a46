"""A quality classifier by Bradley-Terry pairwise ranking.

A document's strength is w . x for a few dozen statistics x of its text, and the
chance that one document is preferred to another is the logistic function of the
difference of their strengths. Preference pairs are (a document labelled good, one
labelled bad); w minimises the logistic loss on the pairs' feature differences.

Strengths are known only up to a constant, so a score quantile sets the threshold:
the quantile of the training strengths that leaves below it the share of documents
labelled bad. The reported score is a logistic function of the strength, scaled to
the training labels and shifted so that this threshold lies at ``cut``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datumloom.llm.common import pick, shared_folder
from datumloom.llm.labelled import held_out, labelled_sample

#: Characters whose number for each word is a feature.
MARKS = "|%$&*#!<>{}=_~@.,;:?"
N_FEATURES = 11 + len(MARKS)
#: Rows that are learned from in one piece, about; values that strengths are rounded to while pairs are summed.
BLOCK, BINS = 20_000, 512


def capitals(text: str) -> int:
    """How many characters differ from their own lower case."""
    lower = text.lower()
    if len(lower) != len(text):  # some character's lower case is longer
        return sum(c != c.lower() for c in text)
    return len(text) - sum(map(str.__eq__, text, lower))


def features(text: str) -> list[float]:
    """Statistics of a whole text; an empty text gives finite values too."""
    words = text.split()
    lines = [line for line in text.split("\n") if line.strip()]
    n, m = max(1, len(text)), max(1, len(words))
    letters = sum(map(len, words))
    return [
        math.log1p(len(words)),
        letters / m,
        capitals(text) / n,
        sum(map(str.isdigit, text)) / n,
        len(set(words)) / m,
        math.log1p(len(set(words))),
        1 - len(set(lines)) / max(1, len(lines)),
        sum(map(str.__eq__, words, words[1:])) / m,
        sum(len(w) <= 3 for w in words) / m,
        len(lines) / m,
        max(map(len, words), default=0) ** 0.5,
        *(text.count(c) / m for c in MARKS),
    ]


@dataclass(frozen=True)
class Model:
    """Feature scaling, pairwise weights, and the map from strength to score."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    slope: float
    cut: float

    def strengths(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights

    def scores(self, strengths: np.ndarray) -> np.ndarray:
        z = self.slope * (strengths - self.threshold) + math.log(self.cut / (1 - self.cut))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def descend(gradient, size: int, steps: int = 400, rate: float = 0.1) -> np.ndarray:
    """Adam from zero, over all rows at each step."""
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for step in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return w


def standing(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.clip((x - mean) / scale, -8, 8)


def pair_weights(z: np.ndarray, y: np.ndarray, ridge: float) -> np.ndarray:
    """Weights that minimise the loss over all pairs of a good and a bad row.

    At each step strengths are rounded to one of ``BINS`` values between the least and
    the greatest, so that all pairs are summed by convolving the two counts.
    """
    good = y == 1
    pairs = float(good.sum()) * float((~good).sum())

    def gradient(w: np.ndarray) -> np.ndarray:
        s = z @ w
        width = (s.max() - s.min()) / (BINS - 1) or 1.0
        at = np.rint((s - s.min()) / width).astype(int)
        lost = 1 / (1 + np.exp(-np.clip(np.arange(1 - BINS, BINS) * width, -500, 500)))  # by bin of the bad row less that of the good one
        n_good, n_bad = (np.bincount(at[rows], minlength=BINS) for rows in (good, ~good))
        of_good = np.convolve(n_bad, lost[::-1])[BINS - 1 : 2 * BINS - 1]
        of_bad = np.convolve(n_good, lost)[BINS - 1 : 2 * BINS - 1]
        return ridge * w + (np.where(good, -of_good[at], of_bad[at]) / pairs) @ z

    return descend(gradient, z.shape[1])


def slope_of(s: np.ndarray, good: np.ndarray, bad: np.ndarray, threshold: float, cut: float) -> float:
    """The slope of the logistic function from strengths and the numbers of good and bad rows at each."""
    n = good + bad
    total = n.sum()
    middle = (n * s).sum() / total
    spread = float(np.sqrt((n * (s - middle) ** 2).sum() / total)) or 1.0
    t = (s - threshold) / spread

    def gradient(a: np.ndarray) -> np.ndarray:
        p = 1 / (1 + np.exp(-np.clip(a[0] * t + math.log(cut / (1 - cut)), -500, 500)))
        return np.array([((n * p - good) * t).sum() / total + 1e-3 * a[0]])

    return max(float(descend(gradient, 1)[0]), 0.1) / spread


def unlearned(cut: float) -> Model:
    return Model(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(N_FEATURES), 0.0, 1.0, cut)


def fit_pairs(x: np.ndarray, y: np.ndarray, cut: float = 0.3, ridge: float = 1e-3) -> Model:
    """Learn from features and labels of all rows. Without both labels all strengths are 0 and all scores ``cut``."""
    if not len(x) or y.min() == y.max():
        return unlearned(cut)
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = standing(x, mean, scale)
    weights = pair_weights(z, y, ridge)
    s = z @ weights
    # Halfway between the neighbours of the quantile, so that neither lies on the threshold.
    ordered = np.sort(s)
    n_bad = int((y == 0).sum())
    threshold = float((ordered[n_bad - 1] + ordered[min(n_bad, len(s) - 1)]) / 2)
    return Model(mean, scale, weights, threshold, slope_of(s, (y == 1).astype(float), (y == 0).astype(float), threshold, cut), cut)


def ranked(values: DataFrame, rank: int) -> float:
    """The value ``s`` of a rank from 0, exactly: counts in ranges until the range that holds it has few rows."""
    low, high, n = values.agg(F.min("s"), F.max("s"), F.count("*")).first()
    while n > BLOCK and low < high:
        part = F.least(F.floor((F.col("s") - low) / (high - low) * BINS), F.lit(BINS - 1))
        found = values.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.min("s").alias("low"), F.max("s").alias("high")).orderBy("part").collect()
        for r in found:
            if rank < r.n:
                break
            rank -= r.n
        low, high, n = r.low, r.high, r.n
        values = values.where(F.col("s").between(low, high))
    if low == high:
        return low
    return sorted(r.s for r in values.select("s").collect())[rank]


def fit_blocks(rows: DataFrame, n: int, cut: float, ridge: float = 1e-3) -> Model:
    """Learn from any number of rows (key, label, x): in blocks of about ``BLOCK`` by a hash of the key, each over all of its pairs.

    The scaling is that of all rows; the weights are the blocks' means, by their numbers
    of pairs. Threshold and slope are found from the strengths of all rows.
    """
    dealt = rows.withColumn("block", F.pmod("key", F.lit(-(-n // BLOCK))))

    def arrays(block: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        block = block.sort_by("key")  # the order of arrival must not matter
        return np.array(block.column("x").to_pylist(), dtype=float).reshape(-1, N_FEATURES), np.array(block.column("label").to_pylist(), dtype=int)

    def moments(block: pa.Table) -> pa.Table:
        x, y = arrays(block)
        mean = x.mean(0)
        return pa.table({"block": block.column("block")[:1], "n": [len(y)], "n_bad": [int((y == 0).sum())], "mean": [mean.tolist()], "squares": [((x - mean) ** 2).sum(0).tolist()]})

    found = dealt.groupBy("block").applyInArrow(moments, "block long, n long, n_bad long, mean array<double>, squares array<double>").toArrow().sort_by("block")
    sizes = np.array(found.column("n").to_pylist(), dtype=float)
    n_bad = sum(found.column("n_bad").to_pylist())
    if n_bad in (0, n):
        return unlearned(cut)
    means = np.array(found.column("mean").to_pylist())
    mean = sizes @ means / n
    scale = np.sqrt((np.array(found.column("squares").to_pylist()).sum(0) + sizes @ (means - mean) ** 2) / n) + 1e-6

    def learn(block: pa.Table) -> pa.Table:
        x, y = arrays(block)
        pairs = int((y == 1).sum()) * int((y == 0).sum())
        w = pair_weights(standing(x, mean, scale), y, ridge) if pairs else np.zeros(N_FEATURES)
        return pa.table({"block": block.column("block")[:1], "pairs": [pairs], "w": [w.tolist()]})

    learned = dealt.groupBy("block").applyInArrow(learn, "block long, pairs long, w array<double>").toArrow().sort_by("block")
    pairs = np.array(learned.column("pairs").to_pylist(), dtype=float)
    if not pairs.any():
        raise ValueError("no block of labelled rows has both labels")
    weights = pairs @ np.array(learned.column("w").to_pylist()) / pairs.sum()

    def strong(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = standing(np.array(batch.column(1).to_pylist(), dtype=float).reshape(-1, N_FEATURES), mean, scale)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array((z * weights).sum(1))], names=["label", "s"])

    strengths = rows.select("label", "x").mapInArrow(strong, "label int, s double")
    threshold = (ranked(strengths, n_bad - 1) + ranked(strengths, n_bad)) / 2
    low, high = strengths.agg(F.min("s"), F.max("s")).first()
    width = (high - low) / (BINS - 1) or 1.0
    counts = strengths.groupBy(F.round((F.col("s") - low) / width).cast("int").alias("at")).agg(F.count_if(F.col("label") == 1).alias("good"), F.count_if(F.col("label") == 0).alias("bad")).orderBy("at").toArrow()
    at, good, bad = (np.array(counts.column(c).to_pylist(), dtype=float) for c in ("at", "good", "bad"))
    return Model(mean, scale, weights, threshold, slope_of(low + at * width, good, bad, threshold, cut), cut)


def fit(docs: DataFrame, labels: DataFrame, cut: float = 0.3, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Learn from all labelled documents that aren't held out.

    Their features are kept in the shared folder. Up to ``BLOCK`` documents' come to the
    driver (31 numbers each, 5 MB); more are learned from in blocks.
    """
    labelled = labelled_sample(docs, labels, label_col, None, id_col, text_col)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(x, pa.list_(pa.float64()))], names=["key", "label", "x"])

    spark, path = docs.sparkSession, shared_folder(docs.sparkSession, "features")
    labelled.select("text", F.xxhash64(id_col, "text").alias("key"), "label").mapInArrow(measure, "key long, label int, x array<double>").write.parquet(path)
    rows = spark.read.schema("key long, label int, x array<double>").parquet(path)
    n = rows.count()
    if n > BLOCK:
        return fit_blocks(rows, n, cut)
    found = rows.toArrow().sort_by("key")  # the order of arrival must not matter
    x = np.array(found.column("x").to_pylist(), dtype=float).reshape(-1, N_FEATURES)
    return fit_pairs(x, np.array(found.column("label").to_pylist(), dtype=int), cut)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Score every row: id, carried columns, held_out, score (0 to 1), predicted (1 if score >= cut), strength.

    - A null or empty text is scored like any other, by the features of an empty text.
    - A null id stays null and isn't held out. Repeated rows get equal scores.
    - Extra columns are ignored; an empty table gives an empty result.
    """
    carry = tuple(c for c in carry if c not in (id_col, "score", "strength", "predicted", "held_out"))
    rows = pick(docs, id_col, text_col, carry=carry)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t or "") for t in batch.column(1).to_pylist()], dtype=float).reshape(-1, N_FEATURES)
            s = model.strengths(x)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.scores(s)), pa.array(s)], names=[*batch.schema.names, "score", "strength"])

    scored = rows.mapInArrow(apply, f"{fields}, score double, strength double")
    return scored.select(
        *dict.fromkeys((id_col, *carry)),
        held_out(F.col(id_col)).alias("held_out"),
        "score",
        (F.col("score") >= model.cut).cast("int").alias("predicted"),
        "strength",
    )


def quality_scores(docs: DataFrame, labels: DataFrame, cut: float = 0.3) -> DataFrame:
    """Fit on all labelled documents that aren't held out, then score all documents."""
    return score(docs, fit(docs, labels, cut))
