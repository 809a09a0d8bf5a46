"""Toxicity by cumulative-link ordinal regression.

A document's severity grade is 0 (not toxic) to 3. With one weight vector w for
all grades and ordered thresholds t1 < t2 < t3, the chance of a grade of at least k
is the logistic function of w . x - t_k, and the expected severity is the sum of
these chances over k. x is sparse: 1 + log(count) for the words and word beginnings
of a learned vocabulary. Beginnings (4 to 7 letters) carry over to inflected forms
that no training document has.

The labels only say toxic or not, so the training grades of toxic documents are
made: a document's load is its number of words that have a feature which sets toxic
documents apart, and terciles of the load split those with any into grades 1 to 3. A
document labelled toxic without any such word has grade 1.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datumloom.llm.common import pick
from datumloom.llm.labelled import labelled_sample
from datumloom.llm.pairwise_quality import descend

GRADES = 3
PREFIXES = (4, 5, 6, 7)
WORD = re.compile(r"[^\W\d_]+")
#: The same words in Spark's regular expressions.
SPLIT = r"[^\p{L}\p{Nl}\p{No}]+"


def parts(word: str) -> list[str]:
    """The features of a word: itself, marked by its end, and its beginnings."""
    return [f"{word}$", *(word[:n] for n in PREFIXES if len(word) > n)]


def sparse_features(text: str, vocabulary: dict[str, int]) -> tuple[list[int], list[float]]:
    """Indices and values of the vocabulary's entries in a whole text."""
    get = vocabulary.get
    found: Counter[int] = Counter()
    for word, n in Counter(WORD.findall(text.lower())).items():
        for part in parts(word):
            if (i := get(part)) is not None:
                found[i] += n
    return list(found), [1 + math.log(n) for n in found.values()]


def load(text: str, marks: frozenset[str]) -> int:
    """How many words of a text have one of the features ``marks``."""
    return sum(n for word, n in Counter(WORD.findall(text.lower())).items() if not marks.isdisjoint(parts(word)))


@dataclass(frozen=True)
class Model:
    """Vocabulary, shared weights and ordered thresholds; rejected from ``cut`` on."""

    vocabulary: dict[str, int]
    weights: np.ndarray
    thresholds: np.ndarray
    cut: float

    def at_least(self, strengths: np.ndarray) -> np.ndarray:
        """The chances of grades of at least 1, 2 and 3, a row for each document."""
        return 1 / (1 + np.exp(-np.clip(strengths[:, None] - self.thresholds[None, :], -500, 500)))


def fit_ordinal(rows: list[list[int]], values: list[list[float]], grades: np.ndarray, size: int, ridge: float = 1e-4, steps: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of greatest likelihood, with a ridge on the weights.

    The first threshold is free and the others are it plus positive steps, so the
    order of the thresholds always holds.
    """
    lengths = np.array([len(r) for r in rows])
    doc = np.repeat(np.arange(len(rows)), lengths)
    word = np.array([i for r in rows for i in r], dtype=int)
    value = np.array([v for r in values for v in r], dtype=float)
    n = len(rows)

    def unpack(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return p[:size], p[size] + np.concatenate([[0.0], np.cumsum(np.exp(p[size + 1 :]))])

    def gradient(p: np.ndarray) -> np.ndarray:
        w, t = unpack(p)
        s = np.bincount(doc, weights=w[word] * value, minlength=n)
        upper = np.hstack([np.ones((n, 1)), 1 / (1 + np.exp(-np.clip(s[:, None] - t, -500, 500))), np.zeros((n, 1))])
        rows_ = np.arange(n)
        chance = np.maximum(upper[rows_, grades] - upper[rows_, grades + 1], 1e-12)
        slope = upper * (1 - upper)  # of P(grade >= k) in s; 0 at both ends
        by_s = -(slope[rows_, grades] - slope[rows_, grades + 1]) / chance / n
        by_t = np.zeros((n, GRADES + 2))
        by_t[rows_, grades] += slope[rows_, grades] / chance / n
        by_t[rows_, grades + 1] -= slope[rows_, grades + 1] / chance / n
        t_grad = by_t[:, 1 : GRADES + 1].sum(0)
        out = np.zeros_like(p)
        out[:size] = np.bincount(word, weights=by_s[doc] * value, minlength=size) + ridge * w
        out[size] = t_grad.sum()
        out[size + 1 :] = np.cumsum(t_grad[::-1])[::-1][1:] * np.exp(p[size + 1 :])
        return out

    return unpack(descend(gradient, size + GRADES, steps, 0.1))


def vocabulary_of(sample: DataFrame, n_docs: int, n_toxic: int, max_words: int, min_docs: int) -> dict[str, float]:
    """The words and beginnings whose share among toxic documents differs most from chance, with their z-scores."""
    words = F.filter(F.array_distinct(F.split(F.lower("text"), SPLIT)), lambda w: w != "")

    def begun_by(n: int):  # a second parameter of these lambdas would be the element's place
        return F.transform(F.filter(words, lambda w: F.length(w) > n), lambda w: F.substring(w, 1, n))

    begun = [begun_by(n) for n in PREFIXES]
    entries = F.array_distinct(F.concat(F.transform(words, lambda w: F.concat(w, F.lit("$"))), *begun))
    words = sample.select("label", F.explode(entries).alias("word"))
    share = n_toxic / n_docs
    counts = words.groupBy("word").agg(F.count("*").alias("n"), F.sum("label").alias("toxic")).where(F.col("n") >= min_docs)
    z = (F.col("toxic") - F.col("n") * share) / F.sqrt(F.col("n") * share * (1 - share))
    found = counts.select("word", z.alias("z"), (F.col("toxic") / F.col("n")).alias("pure")).orderBy(F.abs("z").desc(), "word").limit(max_words)
    return most_general({r["word"]: (r["z"], r["pure"]) for r in found.collect()})


def most_general(entries: dict[str, tuple[float, float]], slack: float = 0.02) -> dict[str, float]:
    """The entries without those of which a beginning is in as well, points the same way and is as pure.

    Otherwise a stem's weight is spread over its many forms, and a new form gets little of it.
    """
    out: dict[str, float] = {}
    for entry in sorted(entries, key=lambda e: (len(e), e)):
        z, pure = entries[entry]
        beginnings = (out.get(entry[:n]) is not None and entries[entry[:n]] for n in PREFIXES if n < len(entry))
        if not any(b and b[0] * z > 0 and (b[1] >= pure - slack if z > 0 else b[1] <= pure + slack) for b in beginnings):
            out[entry] = z
    return out


def fit(
    docs: DataFrame,
    labels: DataFrame,
    max_rows: int = 8_000,
    max_words: int = 4_000,
    min_docs: int = 5,
    cut: float = 0.3,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
) -> Model:
    """Learn from ``max_rows`` labelled documents at most, none held out.

    Of them only counts of ``max_words`` words come to the driver. Without both
    labels the model finds nothing toxic. A word takes part if ``min_docs`` of the
    sample's documents have it, or one in a thousand if that is more.
    """
    sample = labelled_sample(docs, labels, label_col, max_rows, id_col, text_col)
    # Labels of copies agree or not, but a group of copies must not make its words a sign of anything: each text counts once.
    sample = sample.groupBy("text").agg(F.max("label").alias("label"))
    seen = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    total = sum(seen.values())
    nothing = Model({}, np.zeros(0), np.array([10.0, 11.0, 12.0]), cut)
    if len(seen) < 2:
        return nothing
    z = vocabulary_of(sample, total, seen[1], max_words, max(min_docs, total // 1000))
    if not z:
        return nothing
    vocabulary = {w: i for i, w in enumerate(z)}
    # An entry marks toxic documents if it is far more frequent there than chance allows.
    marks = frozenset(w for w, v in z.items() if v >= max(4, 0.3 * max(z.values())))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            found = [sparse_features(t, vocabulary) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(1),
                    batch.column(2),
                    pa.array([f[0] for f in found], pa.list_(pa.int32())),
                    pa.array([f[1] for f in found], pa.list_(pa.float64())),
                    pa.array([load(t, marks) for t in texts], pa.int64()),
                ],
                names=["key", "label", "words", "values", "load"],
            )

    rows = sample.select("text", F.xxhash64("text").alias("key"), "label").mapInArrow(count, "key long, label int, words array<int>, values array<double>, load long").toArrow().sort_by("key")
    words, values = rows.column("words").to_pylist(), rows.column("values").to_pylist()
    toxic = np.array(rows.column("label").to_pylist(), dtype=int)
    loads = np.array(rows.column("load").to_pylist(), dtype=int)
    some = loads[(toxic == 1) & (loads > 0)]
    cuts = np.quantile(some, [1 / 3, 2 / 3]) if len(some) else np.array([np.inf, np.inf])
    grades = np.where(toxic == 1, 1 + (loads > cuts[0]) + (loads > cuts[1]), 0)
    weights, thresholds = fit_ordinal(words, values, grades, len(vocabulary))
    return Model(vocabulary, weights, thresholds, cut)


def grade(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Grade every row: id, carried columns, p_toxic, expected_severity (0 to 3), severity (most likely grade), toxic, kept.

    - A document is toxic if the chance of grade 1 or more reaches the model's cut.
    - A null text counts as empty: no features, graded by the thresholds alone.
    - A null id stays null. Repeated rows get equal grades.
    - Extra columns are ignored; an empty table gives an empty result.
    """
    made = ("p_toxic", "expected_severity", "severity", "toxic", "kept")
    carry = tuple(c for c in carry if c not in (id_col, *made))
    rows = pick(docs, id_col, text_col, carry=carry)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sparse_features(t or "", model.vocabulary) for t in batch.column(1).to_pylist()]
            s = np.array([float(np.dot(model.weights[f[0]], f[1])) if f[0] else 0.0 for f in found])
            upper = model.at_least(s)
            each = -np.diff(np.hstack([np.ones((len(s), 1)), upper, np.zeros((len(s), 1))]), axis=1)
            toxic = upper[:, 0] >= model.cut
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(upper[:, 0]), pa.array(upper.sum(1)), pa.array(each.argmax(1).astype("int32")), pa.array(toxic.astype("int32")), pa.array(~toxic)],
                names=[*batch.schema.names, *made],
            )

    graded = rows.mapInArrow(apply, f"{fields}, p_toxic double, expected_severity double, severity int, toxic int, kept boolean")
    return graded.select(*dict.fromkeys((id_col, *carry)), *made)


def toxicity_grades(docs: DataFrame, labels: DataFrame, max_rows: int = 8_000) -> DataFrame:
    """Fit on a bounded sample of the labelled documents, then grade all of them."""
    return grade(docs, fit(docs, labels, max_rows))
