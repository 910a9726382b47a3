"""Document quality by Bradley-Terry pairwise ranking.

Labelled documents give preference pairs (one of label 1 over one of label 0). A linear score is learned by logistic loss on
the difference of the two feature vectors; the label-0 share of the labelled sample is the score quantile that becomes the
threshold. Only the text is an input of a score.

Defined cases: a null text counts as empty; empty texts have zero features and get a finite score; repeated rows are scored
each; documents with a null id are scored but never learned from; labels that are null count as no label; a document labelled
both ways takes part on both sides; of rows that repeat a labelled id the smallest text is learned from; without labels of both kinds every weight is zero and every score 0.5; empty tables give
empty results; other columns are passed through by ``classify`` and ignored by the query.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probity.llm.common import slices, table

FEATURES = (
    "log_bytes", "upper", "digit", "space", "newline", "exclaim", "symbol", "bar", "stop", "comma", "other_ascii", "wide",
    "log_words", "mean_word", "distinct", "adjacent", "long_words", "words_upper", "words_symbol", "words_bar", "distinct_lines", "top_word",
)
_MARKS = re.compile(r"[#$%&*!^~]{2,}")


def features(text: str) -> list[float]:
    """Counts and shares of bytes, words and lines of the whole text."""
    raw = text.encode("utf-8", "surrogatepass")
    n = max(1, len(raw))
    h = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    upper, lower, digit = h[65:91].sum(), h[97:123].sum(), h[48:58].sum()
    space, newline, symbol = h[32] + h[9] + h[13], h[10], h[35:39].sum() + h[42] + h[94] + h[126]
    known = upper + lower + digit + space + newline + symbol + h[33] + h[124] + h[46] + h[44]
    ascii_all = h[:128].sum()
    words = text.split()
    m = max(1, len(words))
    different = set(words)
    lines = text.split("\n")
    top = max(Counter(words).values(), default=0) / m
    marked = len(_MARKS.findall(text))
    return [
        np.log1p(len(raw)), upper / max(1, upper + lower), digit / n, space / n, newline / n, h[33] / n, symbol / n, h[124] / n, h[46] / n, h[44] / n,
        (ascii_all - known) / n, (len(raw) - ascii_all) / n,
        np.log1p(len(words)), len(text) / m, len(different) / m, sum(map(eq, words, words[1:])) / m, sum(len(w) > 20 for w in different) / max(1, len(different)),
        sum(map(str.isupper, different)) / max(1, len(different)), marked / m, words.count("|") / m, len(set(lines)) / len(lines), top,
    ]


def feature_rows(texts: list[str | None]) -> np.ndarray:
    return np.array([features(t or "") for t in texts], dtype=np.float64).reshape(-1, len(FEATURES))


@dataclass(frozen=True)
class PairwiseModel:
    """A linear score over standardised features; ``threshold`` is the quantile of the labelled scores."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float

    def score(self, x: np.ndarray) -> np.ndarray:
        margin = np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights - self.threshold
        return 1.0 / (1.0 + np.exp(-np.clip(margin, -500, 500)))


def fit_pairs(x: np.ndarray, y: np.ndarray, pairs: int = 30_000, ridge: float = 1e-3, rounds: int = 30, seed: int = 7) -> PairwiseModel:
    """Newton's method on the mean logistic loss of ``pairs`` preference pairs."""
    width = x.shape[1]
    won, lost = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(won) or not len(lost):
        return PairwiseModel(np.zeros(width), np.ones(width), np.zeros(width), 0.0)
    mean, scale = x.mean(0), x.std(0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    z = np.clip((x - mean) / scale, -8, 8)
    random = np.random.default_rng(seed)
    d = z[random.choice(won, pairs)] - z[random.choice(lost, pairs)]
    w = np.zeros(width)
    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(np.clip(d @ w, -500, 500)))  # the chance given to the wrong order
        gradient = -(d * p[:, None]).mean(0) + ridge * w
        hessian = (d * (p * (1 - p))[:, None]).T @ d / len(d) + ridge * np.eye(width)
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    scores = np.sort(z @ w)
    cut = len(lost)  # the quantile: as many of the labelled lie below it as have label 0
    return PairwiseModel(mean, scale, w, float((scores[cut - 1] + scores[cut]) / 2))


def labelled_sample(labels: DataFrame, rows: int, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """At most ``rows`` labelled ids, drawn by a hash of the id: a bound of the fit, stated and documented."""
    known = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__label")).where("__id is not null and __label in (0, 1)").distinct()
    return known.orderBy(F.xxhash64("__id"), "__id", "__label").limit(rows)


def fit(docs: DataFrame, labels: DataFrame, *, sample_rows: int = 12_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> PairwiseModel:
    """Learn from one text of each of at most ``sample_rows`` labelled ids; the driver gets their feature vectors only."""
    sample = labelled_sample(labels, sample_rows, id_col, label_col)
    texts = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text")).join(F.broadcast(sample), "__id")
    found = texts.groupBy("__id", "__label").agg(F.min("__text").alias("__text"))  # as many rows as the sample has, whatever repeats

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            x = feature_rows(part.column("__text").to_pylist())
            yield pa.record_batch({"id": part.column("__id").cast(pa.string()), "label": part.column("__label"), "x": pa.array(list(x), pa.list_(pa.float64()))})

    rows = found.mapInArrow(extract, "id string, label int, x array<double>").toPandas().sort_values(["id", "label"], kind="stable")
    x = np.array(rows["x"].tolist(), dtype=np.float64).reshape(-1, len(FEATURES))
    return fit_pairs(x, rows["label"].to_numpy())


def score(docs: DataFrame, model: PairwiseModel, *, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with ``score_col``: one pass over the whole texts, no shuffle."""
    schema = docs.drop(score_col).schema
    keep = list(schema.names)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            values = model.score(feature_rows(part.column(text_col).to_pylist()))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(values)], names=[*keep, score_col])

    return docs.drop(score_col).mapInArrow(apply, schema.add(score_col, "double"))


def held_out(id_col: str = "doc_id"):
    """True where crc32 of the id as text leaves 1 when divided by 3; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, *, sample_rows: int = 12_000, score_col: str = "score", predicted_col: str = "predicted") -> DataFrame:
    """``docs`` with a score and a prediction, learned from the labels that are not held out; columns of the same names are replaced."""
    model = fit(docs, labels.where(~held_out()), sample_rows=sample_rows)
    return score(docs, model, score_col=score_col).withColumn(predicted_col, (F.col(score_col) >= 0.5).cast("int"))


def op1_quality_pairwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels").where(~held_out()))
    scored = score(docs, model).select("doc_id", held_out().alias("held_out"), "score")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
