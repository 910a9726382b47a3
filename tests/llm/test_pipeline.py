"""The stages against their definitions, one by one, each on what the one before kept."""

import hashlib
import re

import duckdb
import pytest

import __spark_entry__
import corpus_pipeline
from probity.llm import bpe, decontaminate, quality, registry
from tests.llm.test_lines import brute_all
from tests.llm.test_simhash import slow_fingerprint


@pytest.fixture(scope="module")
def stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = [docs]
    for _, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, found[-1], sf).collect(), stage(spark, found[-1], sf).schema)
        found.append(docs)
    return sf, found


def test_names_and_columns(stages):
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    _, found = stages
    assert all(df.columns == found[0].columns and df.dtypes == found[0].dtypes for df in found[1:-1])


def test_each_stage_decides_as_defined(spark, stages):
    sf, (docs, good, clean, unique, left, tokens) = stages
    rows = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}
    accepted = quality.classify(docs, spark.read.parquet(f"{sf}/labels.parquet")).where("predicted = 1")
    assert rows(good) == rows(accepted)
    tidy = lambda texts: {i: "\n".join(" ".join(x.split()) for x in t.split("\n")) for i, t in texts.items()}
    assert tidy(rows(clean)) == tidy(brute_all(sorted(rows(good).items())))
    assert set(rows(unique)) == firsts(rows(clean))
    bench = decontaminate.Benchmark([(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()])
    dirty = {i for i, t in rows(unique).items() if any(m >= decontaminate.MIN_COVERAGE * n for _, m, n, _, _ in bench.hits(t))}
    assert dirty and set(rows(left)) == set(rows(unique)) - dirty
    codec = bpe.Codec(bpe.Vocabulary.parse(open(bpe.default_vocabulary(), encoding="utf-8").read()))
    texts = rows(left)
    got = {r["doc_id"]: r for r in tokens.collect()}
    assert set(got) == set(texts)
    for i, t in texts.items():
        assert got[i]["ids"] == codec.encode(t) and got[i]["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()


def firsts(texts):
    """The smallest id of each group of texts with a five-word Jaccard of 0.8 or more, or fingerprints within three bits."""
    fp = {i: slow_fingerprint(t) for i, t in texts.items()}
    split = {i: re.sub("[A-Z]", lambda m: m[0].lower(), t).split() for i, t in texts.items()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for i, w in split.items()}

    def near(a, b):
        same = len(sets[a] & sets[b])
        return (fp[a] ^ fp[b]).bit_count() <= 3 or sets[a] == sets[b] or 5 * same >= 4 * (len(sets[a]) + len(sets[b]) - same)

    out, left = set(), sorted(texts)
    while left:
        out.add(left[0])
        queue, left = [left[0]], left[1:]
        while queue:
            at = queue.pop()
            found = [i for i in left if near(at, i)]
            queue += found
            left = [i for i in left if i not in set(found)]
    return out


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_rows(spark, docs, no_docs, stage):
    """Null ids and texts, repeated rows, columns named like the operators' own, and no rows at all."""
    sf, run = "/root/testdata/sf0.001", dict(corpus_pipeline.STAGES)[stage]
    odd = docs.selectExpr("*", "1 as n_lines", "'x' as n_dropped", "2 as row_key", "3 as predicted", "4 as component_id", "5 as fingerprint", "6 as coverage", "7 as ids")
    out = run(spark, odd, sf)
    if stage != corpus_pipeline.STAGES[-1][0]:
        assert out.dtypes == odd.dtypes and all((r["row_key"], r["predicted"], r["n_dropped"], r["ids"]) == (2, 3, "x", 7) for r in out.collect())
    assert out.count() <= odd.count() and run(spark, no_docs, sf).count() == 0


def test_run_is_the_stages_in_order(spark, stages):
    sf, found = stages
    assert {tuple(r) for r in corpus_pipeline.run(spark, sf).select("doc_id", "ids_sha256").collect()} == {tuple(r) for r in found[-1].select("doc_id", "ids_sha256").collect()}


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_oracle_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "embeddings"):
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    df = __spark_entry__.queries()[name](spark, sf)
    found = con.sql(registry.ORACLE_SQL[name])
    names = sorted(df.columns)
    assert names == sorted(found.columns)
    show = lambda v: f"{v + 0.0:.9g}" if isinstance(v, float) else str(v)
    assert sorted(tuple(show(r[c]) for c in names) for r in df.collect()) == sorted(tuple(show(dict(zip(found.columns, r))[c]) for c in names) for r in found.fetchall())


def test_all_eleven_are_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11))
