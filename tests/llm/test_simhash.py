import random
import re
from collections import defaultdict

import numpy as np
import xxhash

from probity.llm import simhash as s


def slow_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps):
    parent = {f: f for f in fps}

    def find(f):
        while parent[f] != f:
            f = parent[f]
        return f

    fps = list(parent)
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 3:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {f: find(f) for f in fps}


def test_fingerprints(prose, monkeypatch):
    assert [s.fingerprint(t) for t in prose] == [slow_fingerprint(t) for t in prose]
    monkeypatch.setattr(s, "_HASHES", 7)
    assert [s.fingerprint(t) for t in prose[-8:]] == [slow_fingerprint(t) for t in prose[-8:]]


def test_manhattan_is_a_lower_bound():
    rng = np.random.default_rng(1)
    a, b = (rng.integers(0, 2**64, 2000, dtype=np.uint64) for _ in range(2))
    segments = lambda x: np.stack([np.bitwise_count((x >> np.uint64(2 * k)) & np.uint64(3)) for k in range(32)]).astype(int)
    expected = np.abs(segments(a) - segments(b)).sum(0)
    found = s.manhattan(s.popcounts(a), s.popcounts(b))
    assert (found == expected).all() and (found <= np.bitwise_count(a ^ b)).all()


def test_near_pairs_share_a_cell():
    rng = random.Random(2)
    for _ in range(500):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randint(0, 3)):
            b ^= 1 << bit
        keys, exact = s.cells(np.array([a, b], np.uint64))
        assert (keys[0] == keys[1]).any() and (exact[0] == exact[1]).any()


def cluster(rng, n):
    """Chains and stars of near fingerprints, and others."""
    out = [rng.getrandbits(64) for _ in range(n)]
    for _ in range(n * 4):
        f = rng.choice(out)
        for bit in rng.sample(range(64), rng.randint(1, 4)):
            f ^= 1 << bit
        out.append(f)
    return out


def test_links_span_all_components(spark, monkeypatch):
    rng = random.Random(3)
    fps = sorted(set(cluster(rng, 60)))
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    expected = components(fps)
    for whole in (2048, 2):
        monkeypatch.setattr(s, "WHOLE_CELL", whole)
        edges = s.links(spark.createDataFrame(signed, "fp long"))
        pairs = [(r["a"] % 2**64, r["b"] % 2**64) for r in edges.collect()]
        groups = {f: f for f in fps}

        def find(f):
            while groups[f] != f:
                f = groups[f]
            return f

        for a, b in pairs:
            x, y = find(a), find(b)
            groups[max(x, y)] = min(x, y)
        assert {f: find(f) for f in fps} == expected


def test_cut_cells_span_the_same_components(monkeypatch):
    """The threshold is read in this process here, not by Python workers."""
    fps = cluster(random.Random(5), 60)
    fps += [f ^ 3 << k for f in fps for k in (0, 20, 62) if f >> k & 3 in (1, 2)]  # popcounts alike, bits not
    fps = np.array(sorted(set(fps)), np.uint64)
    keys, exact = (x.ravel() for x in s.cells(fps))
    every = np.repeat(fps, 20)
    order = np.lexsort((every, exact, keys))
    expected, counts = components(fps.tolist()), []
    for whole in (2048, 2):
        monkeypatch.setattr(s, "WHOLE_CELL", whole)
        a, b = (np.concatenate(x).tolist() for x in s._edges_of(keys[order], exact[order], every[order]))
        root = {f: f for f in fps.tolist()}

        def find(f):
            return f if root[f] == f else find(root[f])

        for x, y in zip(a, b):
            x, y = find(x), find(y)
            root[max(x, y)] = min(x, y)
        assert {f: find(f) for f in fps.tolist()} == expected
        counts.append(len(a))
    assert counts[0] > counts[1]


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100)] + [(500, i) for i in range(501, 560)] + [(700, 700)]
    found = {r["node"]: r["root"] for r in s.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(found[i] == 0 for i in range(1, 101)) and all(found[i] == 500 for i in range(501, 560))


def test_documents(docs, no_docs):
    rows = docs.collect()
    found = s.near_duplicates(docs).collect()
    assert len(found) == len(rows)
    fp = {(r["doc_id"], r["text"]): slow_fingerprint(r["text"]) for r in rows}
    root = components(set(fp.values()))
    least = defaultdict(lambda: None)
    for (i, _), f in fp.items():
        if i is not None:
            least[root[f]] = i if least[root[f]] is None else min(i, least[root[f]])
    expected = sorted(((-1 if r["doc_id"] is None else r["doc_id"]), f"{fp[r['doc_id'], r['text']]:016x}", least[root[fp[r["doc_id"], r["text"]]]] or 0) for r in rows)
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["fingerprint"], r["component_id"] or 0) for r in found) == expected
    assert s.near_duplicates(no_docs).count() == 0
