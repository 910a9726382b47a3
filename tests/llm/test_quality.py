import zlib

import numpy as np
import pytest

from probity.llm import quality


def test_newton_separates_and_cuts_at_the_quantile():
    rng = np.random.default_rng(1)
    x = np.r_[rng.normal(0, 1, (300, 22)), rng.normal(2, 1, (700, 22))]
    y = np.r_[np.zeros(300), np.ones(700)].astype(int)
    model = quality.fit_pairs(x, y, pairs=3000)
    p = model.score(x)
    assert ((p >= 0.5) == y).mean() > 0.97
    assert (p < 0.5).sum() == 300


@pytest.mark.parametrize("y", [[], [1, 1], [0, 0, 0]])
def test_without_both_labels_everything_scores_one_half(y):
    x = np.ones((len(y), len(quality.FEATURES)))
    model = quality.fit_pairs(x, np.array(y))
    assert (model.score(np.zeros((3, len(quality.FEATURES)))) == 0.5).all()


def test_features_are_finite_for_odd_texts(prose):
    x = quality.feature_rows([*prose, None])
    assert x.shape == (len(prose) + 1, len(quality.FEATURES)) and np.isfinite(x).all()


def test_held_out_is_crc32_modulo_three(spark, docs):
    for r in docs.select("doc_id", quality.held_out().alias("h")).collect():
        assert r["h"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)


def test_classify_keeps_rows_and_columns(spark, docs):
    labels = spark.createDataFrame([(i, int(i % 2 == 0), 0) for i in range(60)] + [(None, 1, 0), (5, None, 0), (6, 0, 0)], "doc_id long, quality int, toxic int")
    out = quality.classify(docs, labels)
    rows = out.collect()
    assert len(rows) == docs.count() and {"lang", "source", "score", "predicted"} <= set(out.columns)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)


def test_empty_tables(spark, no_docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.classify(no_docs, labels).count() == 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    found = {r["doc_id"]: r for r in quality.op1_quality_pairwise(spark, sf).collect()}
    labels = [r for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if found[r["doc_id"]]["held_out"]]
    assert np.mean([found[r["doc_id"]]["predicted"] == r["quality"] for r in labels]) >= 0.95


def test_top_word_counts_every_word():
    text = " ".join(f"w{i} fill fill fill fill fill fill fill fill fill" for i in range(40))
    assert quality.features(text)[quality.FEATURES.index("top_word")] == 0.9
