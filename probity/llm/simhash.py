"""Near-duplicate documents by SimHash, found through segment popcounts.

A fingerprint's 64 bits are cut into 32 segments of two bits; the vector of their popcounts is an embedding whose Manhattan
distance never exceeds the Hamming distance. At most three bits differ, so of six blocks of segments at least three have
distance zero: each fingerprint goes to the grid cells that three of the six blocks span (20 cells), every linked pair meets in
at least one, and pairs that meet are held to the Manhattan bound and then to the exact bits.

A cell passes on at most one edge a member (to the first member of its part of the cell), never all pairs, so large groups of
copies cost no more than their size. Cells are sorted by the exact bits of their blocks; one with more than ``WHOLE_CELL``
members is compared only within equal bits, which loses no link: a linked pair has three blocks that are equal bit for bit, and
meets in that cell within equal bits. Components come from alternating large-star and small-star steps over written tables.

Defined cases: null texts count as empty; texts without words have fingerprint zero and are linked like any other; repeated
rows give a row each; a null doc_id keeps its row and counts for links, but is never a component's smallest id, which is null
only if all its members' ids are; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probity.llm.common import checkpointed, partitions_for, slices, table

MAX_BITS, SHINGLE, SEED = 3, 3, 42
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_SPACE = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")
_TABLE = bytes(_LOWER[b] if 65 <= b < 91 else _SPACE[b] for b in range(256))
#: Bits of the six blocks, in whole segments of two.
_BLOCKS = [((1 << width) - 1) << start for width, start in ((12, 0), (12, 12), (10, 24), (10, 34), (10, 44), (10, 54))]
_LOW = 0x5555555555555555
_STEP, _MIX = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9
#: A cell of up to so many members is compared as a whole; see above.
WHOLE_CELL = 2048
_HASHES = 65_536


def fingerprint(text: str) -> int:
    """The SimHash of the word shingles of a whole text, in bounded memory whatever its length."""
    words = text.encode("utf-8", "surrogatepass").translate(_TABLE).split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < SHINGLE:
        return digest(b" ".join(words), SEED)
    total, n = np.zeros(64, np.int64), len(words) - SHINGLE + 1
    for start in range(0, n, _HASHES):
        part = words[start : start + _HASHES + SHINGLE - 1]
        h = np.array([digest(b"%b %b %b" % t, SEED) for t in zip(part, part[1:], part[2:])], "<u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id and its fingerprint as a signed 64-bit integer."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = source.select("doc_id").schema.add("fp", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = np.array([fingerprint(t or "") for t in part.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found)], names=["doc_id", "fp"])

    return source.mapInArrow(run, schema)


def popcounts(fp: np.ndarray) -> np.ndarray:
    """The embedding, packed: each two-bit segment holds its own popcount."""
    low = np.uint64(_LOW)
    return (fp & low) + ((fp >> np.uint64(1)) & low)


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Manhattan distance of two packed embeddings, by segment: |0-1|, |1-2| are 1 and |0-2| is 2."""
    low = np.uint64(_LOW)
    x = a ^ b
    odd, two = x & low, (x >> np.uint64(1)) & low
    # 0^1 = 01, 1^2 = 11, 0^2 = 10: the low bit says distance one, the high bit alone distance two
    return (np.bitwise_count(odd) + 2 * np.bitwise_count(two & ~odd)).astype(np.int64)


def cells(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of the 20 choices of three blocks: a cell key from their popcounts, and the exact bits."""
    embedded = popcounts(fp)
    keys, exact = [], []
    for number, blocks in enumerate(combinations(_BLOCKS, 3)):
        mask = np.uint64(blocks[0] | blocks[1] | blocks[2])
        keys.append(((embedded & mask) + np.uint64(number * _STEP % (1 << 64))) * np.uint64(_MIX))
        exact.append(fp & mask)
    return np.stack(keys, 1), np.stack(exact, 1)


def _linked(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    near = manhattan(popcounts(a), popcounts(b)) <= MAX_BITS
    near[near] = np.bitwise_count(a[near] ^ b[near]) <= MAX_BITS
    return near


def _roots(fp: np.ndarray) -> np.ndarray:
    """For each of a run's fingerprints the smallest index linked to it through the run: breadth first, one row at a time."""
    n = len(fp)
    root, open_ = np.full(n, -1, np.int64), np.arange(n)
    embedded = popcounts(fp)
    while len(open_):
        first = open_[0]
        root[first] = first
        frontier, open_ = [first], open_[1:]
        while frontier and len(open_):
            at = frontier.pop()
            near = manhattan(embedded[open_], embedded[at]) <= MAX_BITS
            near[near] = np.bitwise_count(fp[open_[near]] ^ fp[at]) <= MAX_BITS
            found = open_[near]
            root[found] = first
            frontier.extend(found.tolist())
            open_ = open_[~near]
    return root


def _edges_of(key: np.ndarray, exact: np.ndarray, fp: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Edges of whole cells, sorted by (key, exact): each member to the first of its part."""
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    lengths = np.diff(np.r_[starts, len(key)])
    a, b = [], []
    pairs = starts[lengths == 2]
    if len(pairs):
        near = _linked(fp[pairs], fp[pairs + 1])
        a.append(fp[pairs[near]])
        b.append(fp[pairs[near] + 1])
    for start, length in zip(starts[lengths > 2].tolist(), lengths[lengths > 2].tolist()):
        run = fp[start : start + length]
        if length > WHOLE_CELL:
            bits = exact[start : start + length]
            cut = np.r_[np.flatnonzero(np.r_[True, bits[1:] != bits[:-1]]), length]
        else:
            cut = [0, length]
        for lo, hi in zip(cut[:-1], cut[1:]):
            if hi - lo > 1:
                part = run[lo:hi]
                root = _roots(part)
                other = np.flatnonzero(root != np.arange(len(part)))
                a.append(part[root[other]])
                b.append(part[other])
    return a, b


def links(distinct: DataFrame) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that span the same components as all links."""
    spark = distinct.sparkSession

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 16_384):
            fp = part.column("fp").to_numpy().view(np.uint64)
            keys, exact = cells(fp)
            flat = [keys.ravel().view(np.int64), exact.ravel().view(np.int64), np.repeat(fp, keys.shape[1]).view(np.int64)]
            yield pa.record_batch(dict(zip(("cell", "exact", "fp"), map(pa.array, flat))))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None  # the last cell so far, which may go on in the next batch

        def out(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            a, b = _edges_of(*columns)
            if a and sum(map(len, a)):
                yield pa.record_batch({"a": pa.array(np.concatenate(a).view(np.int64)), "b": pa.array(np.concatenate(b).view(np.int64))})

        for batch in batches:
            now = [batch.column(c).to_numpy().view(np.uint64) for c in ("cell", "exact", "fp")]
            if rest is not None:
                now = [np.concatenate(x) for x in zip(rest, now)]
            if not len(now[0]):
                continue
            cut = int(np.flatnonzero(np.r_[True, now[0][1:] != now[0][:-1]])[-1])
            yield from out([x[:cut] for x in now]) if cut else ()
            rest = [x[cut:].copy() for x in now]
        if rest is not None:
            yield from out(rest)

    spread_out = distinct.mapInArrow(spread, "cell long, exact long, fp long")
    sorted_ = spread_out.repartition(partitions_for(spark), "cell").sortWithinPartitions("cell", "exact", "fp")
    return sorted_.mapInArrow(compare, "a long, b long").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): for every node of ``edges`` (a, b) the smallest node of its component, by large-star and small-star steps."""

    def star(e: DataFrame, large: bool) -> DataFrame:
        """Large: every greater neighbour of a node is tied to its least neighbour. Small: so are the node and its lesser ones."""
        if large:
            e = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        else:
            e = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = e.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        joined = e.join(least, "a")
        if large:
            return joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()

    now = checkpointed(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    mark = None
    for _ in range(max_rounds):
        now = checkpointed(star(star(now, True), False))
        found = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(found) == mark:
            break
        mark = tuple(found)
    else:
        raise RuntimeError(f"components have not settled after {max_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id that links reach."""
    marked = checkpointed(fingerprints(docs, id_col, text_col))
    distinct = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = components(links(distinct.select("fp")))
    roots = distinct.join(found, distinct["fp"] == found["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    classes = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = roots.select("fp", "root").join(classes, "root").select("fp", "component_id")
    return marked.join(of_fp, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
