import random

import numpy as np
import pytest

import corpus_pipeline
from probity.llm import copies, simhash


def _texts():
    rng = random.Random(3)
    words = [f"w{rng.randrange(5000)}" for _ in range(200)]
    near, far = list(words), list(words)
    for at in (20, 90, 160):
        near[at] = "changed"
    for at in range(0, 200, 8):
        far[at] = "other"
    return [" ".join(x) for x in (words, near, far)]


def _jaccard(a, b):
    a, b = (set(zip(*(t.split()[k:] for k in range(5)))) for t in (a, b))
    return len(a & b) / len(a | b)


def test_near_copies_beyond_three_bits_are_cut_to_one(spark):
    a, b, c = _texts()
    assert _jaccard(a, b) >= 0.8 > _jaccard(a, c)
    assert (simhash.fingerprint(a) ^ simhash.fingerprint(b)).bit_count() > simhash.MAX_BITS
    docs = spark.createDataFrame([(5, a), (3, b), (9, c)], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.keep_one_of_each_group(spark, docs, "").collect()) == [3, 9]


def test_jaccard_is_exact_and_chains_are_followed(monkeypatch):
    base = np.arange(100, dtype=np.uint64)
    sets = [base, base + np.uint64(11), base + np.uint64(22), base + np.uint64(34)]
    assert copies._groups(sets).tolist() == [0, 0, 0, 3]


@pytest.mark.parametrize("held", [0, 150, 600, copies.HELD])
def test_groups_do_not_depend_on_the_shingles_held(spark, monkeypatch, held):
    """One bucket of two chains, in which each text is near the next one only, and a text by itself."""
    monkeypatch.setattr(copies, "HELD", held)
    words = [[f"{c}{k}" for k in range(300)] for c in "ab"]
    texts = [" ".join(w[11 * k : 11 * k + 104]) for k in range(12) for w in words] + ["quite another text of seven words"]
    marked = spark.createDataFrame([(7 * k % 25, [1], t) for k, t in enumerate(texts)], "key long, bands array<long>, text string")
    root = {7 * k % 25: 7 * k % 25 for k in range(25)}

    def find(k):
        return k if root[k] == k else find(root[k])

    for a, b in copies.links(marked).collect():
        root[find(a)] = find(b)
    groups = {}
    for k in range(25):
        groups.setdefault(find(7 * k % 25), set()).add(k)
    assert sorted(map(sorted, groups.values())) == [list(range(0, 24, 2)), list(range(1, 24, 2)), [24]]


def test_groups_in_pieces_are_those_of_the_whole_bucket():
    rng = np.random.default_rng(4)
    for size in (1, 2, 40):
        base = rng.integers(0, 2**63, (3, 60), np.uint64)
        sets = [np.unique(base[rng.integers(3)][rng.random(60) < 0.88]) for _ in range(size)]
        whole = copies._groups(sets)
        for held in (0, 100, 333, 2000, 10**6):
            bucket = copies.Bucket(held)
            for key, found in enumerate(sets):
                bucket.add(key, found)
            assert bool(bucket.pieces) == (sum(map(len, sets)) > held // 2 and size > 1)
            first = np.arange(size)
            a, b = bucket.edges()
            first[b] = a
            assert len(set(zip(first.tolist(), whole.tolist()))) == len(set(first.tolist())) == len(set(whole.tolist()))


def test_groups_without_ids_and_with_repeated_ids_keep_one_row(spark):
    a, b, c = _texts()
    docs = spark.createDataFrame([(None, a), (None, a), (None, b), (7, c), (7, c), (7, c)], "doc_id long, text string")
    assert sorted(r["text"] for r in copies.keep_one_of_each(docs).collect()) in (sorted([a, c]), sorted([b, c]))


def test_contaminated_rows_go_by_row_and_not_by_id(spark, sf):
    item = next(r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect() if len(r["text"].split()) >= 10)
    docs = spark.createDataFrame([(None, item), (None, "clean without an id"), (4, item), (4, "clean with the same id"), (5, None)], "doc_id long, text string")
    kept = corpus_pipeline.drop_contaminated(spark, docs, sf).collect()
    assert sorted(str(r["text"]) for r in kept) == ["None", "clean with the same id", "clean without an id"]
