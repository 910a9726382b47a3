import numpy as np
import pytest

from probity.llm import ann


def exact(vectors, queries, k, kind=np.float32):
    out = set()
    for q_id, q in queries:
        best = {}
        for c_id, c in vectors:
            if c_id != q_id and len(c) == len(q):
                s = 0.0
                for a, b in zip(q, c):
                    s += float(kind(a)) * float(kind(b))
                best[c_id] = max(s, best.get(c_id, -np.inf))
        for rank, (c_id, s) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k], 1):
            out.add((q_id, rank, c_id, s))
    return out


def vectors_of(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, score double, rank int")


@pytest.mark.parametrize("block", [3, 17, 4096])
def test_as_by_brute_force(spark, block):
    rng = np.random.default_rng(2)
    good = [(i, rng.normal(size=16).astype(np.float32).tolist()) for i in range(120)]
    good += [(200 + i, good[5][1]) for i in range(40)] + [(300 + i, (np.float32(1e-3) * rng.normal(size=16)).astype(np.float32).tolist()) for i in range(10)]
    good += [(7, good[9][1]), (11, good[11][1]), (400, [1.0, 2.0]), (420, [2.0, 1.0]), (440, [1e30] + [0.0] * 15), (460, [-1.0] * 16)]
    bad = [(500, None), (520, [0.0] * 16), (540, [float("nan")] + [1.0] * 15), (560, [float("inf")] * 16), (580, [None] + [1.0] * 15), (600, []), (None, [1.0] * 16)]
    table = vectors_of(spark, [(i, v, 0.5, 1) for i, v in good + bad])
    queries = [(i, v) for i, v in good if i % 20 == 0]
    found = ann.nearest(table, table.where("vec_id % 20 = 0"), 20, block=block).collect()
    got = {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found}
    assert len(got) == len(found) and got == exact(good, queries, 20)


def test_every_cell_of_the_grid(spark, monkeypatch):
    """More rows and columns of cells than one: the same result as by brute force."""
    monkeypatch.setattr(ann, "ROW_BLOCKS", 2)
    rng = np.random.default_rng(4)
    good = [(i, rng.normal(size=8).round(1).tolist()) for i in range(400)]
    table = vectors_of(spark, [(i, v, 0.0, 0) for i, v in good]).repartition(5)
    found = {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.nearest(table, table.where("vec_id % 5 = 0"), 7, block=6).collect()}
    assert found == exact(good, [(i, v) for i, v in good if i % 5 == 0], 7)


def test_quantisation_error_is_within_its_bound():
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(50, 32)), rng.normal(size=(60, 32)) * rng.uniform(0.01, 100, (60, 1))
    (qx, sx, nx, rx), (qy, sy, ny, ry) = ann.quantise(x), ann.quantise(y)
    approx = (qx.astype(float) @ qy.astype(float).T) * sx[:, None] * sy[None, :]
    bound = nx[:, None] * ry[None, :] + rx[:, None] * (ny + ry)[None, :]
    assert (np.abs(x @ y.T - approx) <= bound + 1e-9).all()


def test_fewer_candidates_than_k_and_none(spark):
    table = vectors_of(spark, [(0, [1.0, 0.0], 0.0, 0), (1, [0.5, 0.5], 0.0, 0)])
    assert [(r["query_id"], r["vec_id"]) for r in ann.nearest(table, table.where("vec_id = 0")).collect()] == [(0, 1)]
    alone = table.where("vec_id = 0")
    assert ann.nearest(alone, alone).count() == 0
    assert ann.nearest(table.limit(0), table.limit(0)).count() == 0


def test_doubles_are_not_rounded_to_floats(spark):
    """Forty vectors that differ beyond single precision."""
    good = [(i, [1.0 + i * 1e-12, 0.5]) for i in range(41)]
    table = spark.createDataFrame(good, "vec_id long, embedding array<double>")
    found = ann.nearest(table, table.where("vec_id = 0"), 3).collect()
    assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found} == exact(good, good[:1], 3, float)
    assert [r["vec_id"] for r in sorted(found, key=lambda r: r["rank"])] == [40, 39, 38]


def test_vectors_of_any_length(spark):
    rng = np.random.default_rng(6)
    good = [(i, rng.normal(size=1536).astype(np.float32).tolist()) for i in range(60)]
    table = vectors_of(spark, [(i, v, 0.0, 0) for i, v in good])
    found = {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.nearest(table, table.where("vec_id % 20 = 0"), 5, block=7).collect()}
    assert found == exact(good, [(i, v) for i, v in good if i % 20 == 0], 5)
    codes = np.full((2, 5000), 127, np.int8)
    assert (ann.code_products(codes, codes) == 127 * 127 * 5000).all()
