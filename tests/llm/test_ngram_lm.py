import math
import re
from collections import Counter

import pytest

from probity.llm import ngram_lm


def brute(rows, order, alpha, least):
    split = [(i, re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) for i, t in rows]
    c = Counter(tuple(w[i : i + k]) for _, w in split for k in range(1, order + 1) for i in range(len(w) - k + 1))
    n = sum(len(w) for _, w in split)
    out = []
    for doc, w in split:
        total = backoff = 0
        for i in range(len(w)):
            k, penalty = min(order, i + 1), 0
            while k > 1 and c[tuple(w[i - k + 1 : i + 1])] < least:
                k, penalty = k - 1, penalty + 1
            g = tuple(w[i - k + 1 : i + 1])
            total += math.log(c[g] / (c[g[:-1]] if k > 1 else n)) + penalty * math.log(alpha)
            backoff += penalty > 0
        out.append((doc, len(w), backoff, total))
    return out


@pytest.mark.parametrize("order,tokens,bits", [(1, 50, 18), (2, 50, 3), (2, 10**6, 18), (3, 400, 18), (3, 400, 2), (4, 10**6, 18)])
def test_as_by_brute_force(docs, monkeypatch, order, tokens, bits):
    """With few words that have numbers, too: then most n-grams are known by their hashes."""
    monkeypatch.setattr(ngram_lm, "BOOK", 1 << bits)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    expected = sorted(brute(rows, order, 0.4, 2), key=key)
    found = sorted(((r["doc_id"], r["n_tokens"], r["n_backoff"], r["log_score"]) for r in ngram_lm.score_documents(docs, order=order, batch_tokens=tokens).collect()), key=key)
    assert [f[:3] for f in found] == [e[:3] for e in expected]
    assert all(math.isclose(f[3], e[3], rel_tol=1e-9, abs_tol=1e-9) for f, e in zip(found, expected))


def test_many_tables_give_the_same(docs, monkeypatch):
    whole = {r["doc_id"]: r["log_score"] for r in ngram_lm.score_documents(docs).collect()}
    monkeypatch.setattr(ngram_lm, "TABLE_BYTES", 500)
    assert {r["doc_id"]: r["log_score"] for r in ngram_lm.score_documents(docs).collect()} == pytest.approx(whole)


def test_empty_texts_and_tables(spark, no_docs):
    rows = ngram_lm.score_documents(spark.createDataFrame([(1, ""), (2, None)], "doc_id long, text string")).collect()
    assert [(r["n_tokens"], r["log_score"], r["mean_log_score"]) for r in rows] == [(0, 0.0, None)] * 2
    assert ngram_lm.score_documents(no_docs).count() == 0


def test_ids_of_any_type(spark):
    rows = spark.createDataFrame([("a", "x y x y"), (None, "x y"), ("b", None)], "doc_id string, text string")
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_backoff"]) for r in ngram_lm.score_documents(rows).collect()) == [("None", 2, 0), ("a", 4, 2), ("b", 0, 0)]
