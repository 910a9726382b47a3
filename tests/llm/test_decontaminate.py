import random
import time

from probity.llm import decontaminate as d
from tests.llm.conftest import WORDS


def greedy(a, b, k):
    """Greedy string tiling by looking at every pair of places; the share of b that is marked."""
    used_a, used_b = [False] * len(a), [False] * len(b)
    tiles = []
    while True:
        best, where = 0, None
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and not used_a[i + n] and not used_b[j + n]:
                    n += 1
                if n > best:
                    best, where = n, (i, j)
        if best < k or where is None:
            return tiles
        i, j = where
        used_a[i : i + best] = [True] * best
        used_b[j : j + best] = [True] * best
        tiles.append(best)


def test_tiles_as_by_brute_force():
    rng = random.Random(4)
    for _ in range(150):
        alphabet = WORDS[: rng.choice([2, 4, 12])]
        a = [rng.choice(alphabet) for _ in range(rng.randint(0, 40))]
        b = [rng.choice(alphabet) for _ in range(rng.randint(1, 20))]
        if rng.random() < 0.6:
            at = rng.randint(0, len(b) - 1)
            a[3:3] = b[at:] + b[:at]
        found = {i: rest for i, *rest in d.Benchmark([(0, " ".join(b))]).hits(" ".join(a))}
        expected = greedy(a, b, min(5, len(b)))
        got = found.get(0, [0, len(b), 0, 0])
        # ties between equal longest matches may be broken either way; the longest tile never depends on it
        assert got[3] == max(expected, default=0)
        if len(set(a)) > 6:
            assert got[0] == sum(expected) and got[2] == len(expected)


def test_reordered_passages_are_caught_and_clean_texts_are_not(spark, docs, prose):
    rng = random.Random(9)
    item = " ".join(f"{rng.choice(WORDS)}{n}" for n in range(40))
    words = item.split()
    moved = "Some start. " + " ".join(words[20:]).upper() + " middle " + " ".join(words[:20]) + "!"
    table = docs.select("doc_id", "text").union(spark.createDataFrame([(5001, moved), (5002, "x " + item), (5003, " ".join(words[:15])), (5004, None)], "doc_id long, text string"))
    bench = spark.createDataFrame([(1, item, "z"), (2, item, "z"), (3, "", "z"), (4, None, "z"), (None, "never seen anywhere at all today", "z"), (6, "tiny item", "z")], "item_id long, text string, doc_id string")
    rows = d.contamination(table, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == {(5001, 1), (5001, 2), (5002, 1), (5002, 2)}
    assert all(r["coverage"] == 1.0 for r in rows) and {r["tiles"] for r in rows if r["doc_id"] == 5001} == {2}


def test_chunks_leave_no_item_out(spark, docs, monkeypatch):
    bench = spark.createDataFrame([(i, r["text"]) for i, r in enumerate(docs.collect())], "item_id long, text string")
    whole = {tuple(r) for r in d.contamination(docs, bench).collect()}
    monkeypatch.setattr(d, "CHUNK_WORDS", 2000)
    assert {tuple(r) for r in d.contamination(docs, bench).collect()} == whole and whole


def test_empty_tables(spark, docs, no_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert d.contamination(docs, none).count() == 0
    assert d.contamination(no_docs, none.union(spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string"))).count() == 0


def test_repeated_words_take_seconds():
    """A hundred thousand times one word, or two in turn, against items of such."""
    began = time.perf_counter()
    bench = d.Benchmark([(0, "same " * 800), (1, "on off " * 400), (2, "same " * 3)])
    assert {i: rest for i, *rest in bench.hits("same " * 100_000)} == {0: [800, 800, 1, 800], 2: [3, 3, 1, 3]}
    assert {i: rest for i, *rest in bench.hits("on off " * 50_000)} == {1: [800, 800, 1, 800]}
    assert time.perf_counter() - began < 20


def test_the_whole_query_as_by_brute_force(spark):
    rng = random.Random(21)
    items = [" ".join(rng.choice(WORDS) for _ in range(rng.choice([3, 8, 20]))) for _ in range(12)]
    texts = []
    for n in range(40):
        words = [rng.choice(WORDS) for _ in range(rng.randint(0, 30))]
        for item in rng.sample(items, rng.randint(0, 2)):
            own = item.split()
            cut = rng.randrange(len(own))
            at = rng.randint(0, len(words))
            words[at:at] = own[cut:] + [rng.choice(WORDS)] * rng.randint(0, 1) + own[:cut]
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {(r["doc_id"], r["item_id"]): (r["matched_words"], r["tiles"]) for r in d.contamination(docs, spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()}
    expected = {}
    for i, text in enumerate(texts):
        for k, item in enumerate(items):
            tiles = greedy(text.split(), item.split(), min(d.SEED_WORDS, len(item.split())))
            if sum(tiles) >= d.MIN_COVERAGE * len(item.split()):
                expected[i, k] = (sum(tiles), len(tiles))
    assert found == expected and len(found) > 10
