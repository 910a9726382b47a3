"""Near-duplicate rows for the pipeline: five-word shingles with a Jaccard similarity of 0.8 or more, or SimHash links.

Texts with equal sets of shingles are one node. Sixty minimum hashes in ``BANDS`` bands of ``BAND`` put nodes into buckets; a pair at
0.8 misses all of them with probability (1 - 0.8^3)^20 = 6e-7, a closer one less often. Within a bucket the Jaccard similarity is
counted over the whole sets, breadth first, and one edge a member is passed on. Buckets with the same members are compared once.
A bucket of more than ``HELD`` shingles is compared in pieces, each with every earlier one, which waits in a file of the task; only
pieces that are one group already are not compared again. So the groups are those of the whole bucket, whatever its size.

Groups are the components of these edges together with those of ``simhash.links``. Each group keeps one row: the one with the
smallest id, rows without an id last. Null texts count as empty; texts without words are one group; other columns are kept.
"""

from __future__ import annotations

import tempfile
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from probity.llm import simhash
from probity.llm.common import checkpointed, partitions_for, slices

WORDS, BANDS, BAND, SEED = 5, 20, 3, 42
#: Shingles that a task compares at a time: 32 MB of hashes, and a few times that while they are compared.
HELD = 4_000_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
_DRAWN = np.random.default_rng(SEED).integers(0, 2**64, (2, BANDS * BAND), np.uint64)
_XOR, _TIMES = _DRAWN[0], _DRAWN[1] | np.uint64(1)
_CHUNK = 16_384


def shingles(text: str) -> np.ndarray:
    """The distinct hashes of the runs of five words, sorted; a shorter text is one run."""
    words = text.encode("utf-8", "surrogatepass").translate(simhash._TABLE).split()
    if not words:
        return np.zeros(0, np.uint64)
    of_words = np.array([xxhash.xxh64_intdigest(w, SEED) for w in words], np.uint64)
    size = min(WORDS, len(words))
    found = np.zeros(len(words) - size + 1, np.uint64)
    for k in range(size):
        found = (found + of_words[k : len(words) - size + 1 + k]) * _MIX
        found ^= found >> np.uint64(29)
    return np.unique(found)


def bands(found: np.ndarray) -> np.ndarray:
    """The buckets of a set of shingles, one for each band."""
    least = np.full(BANDS * BAND, 2**64 - 1, np.uint64)
    for start in range(0, len(found), _CHUNK):
        h = (found[start : start + _CHUNK, None] ^ _XOR) * _TIMES
        h ^= h >> np.uint64(31)
        least = np.minimum(least, (h * _MIX).min(0))
    out = np.arange(BANDS, dtype=np.uint64)
    for part in least.reshape(BANDS, BAND).T:
        out = (out + part) * _MIX
        out ^= out >> np.uint64(32)
    return out


def _groups(sets: list[np.ndarray], known: np.ndarray | None = None) -> np.ndarray:
    """For each set the first one that links of 0.8 or more reach, breadth first; sets of one number in ``known`` are linked already."""
    root, open_ = np.full(len(sets), -1, np.int64), np.arange(len(sets))
    sizes = np.array([len(s) for s in sets])
    known = open_ if known is None else known
    while len(open_):
        first, flat = open_[0], None
        near = known[open_] == known[first]
        root[open_[near]] = first
        frontier, open_ = open_[near].tolist(), open_[~near]
        while frontier and len(open_):
            at = sets[frontier.pop()]
            if flat is None:
                flat = np.concatenate([sets[k] for k in open_])
                begin = np.r_[0, np.cumsum(sizes[open_])[:-1]]
            place = np.minimum(np.searchsorted(at, flat), len(at) - 1)
            common = np.add.reduceat((at[place] == flat).astype(np.int64), begin)
            near = 5 * common >= 4 * (sizes[open_] + len(at) - common)
            if near.any():
                near = np.isin(known[open_], known[open_[near]])
                root[open_[near]] = first
                frontier.extend(open_[near].tolist())
                open_, flat = open_[~near], None
    return root


class Bucket:
    """The members of a bucket and their groups, with ``held`` shingles or two members in memory at a time."""

    def __init__(self, held: int):
        self.half = held // 2
        self.keys, self.root = array("q"), np.zeros(0, np.int64)
        self.sets: list[np.ndarray] = []
        self.size = 0
        self.pieces: list[tuple[int, np.ndarray]] = []
        self.file = None

    def add(self, key: int, found: np.ndarray) -> None:
        if self.sets and self.size + len(found) > self.half:
            self._compare()
            self.file = self.file or tempfile.TemporaryFile()
            self.file.seek(0, 2)
            self.pieces.append((self.file.tell(), np.array([len(s) for s in self.sets])))
            for s in self.sets:
                self.file.write(s.tobytes())
            self.sets, self.size = [], 0
        self.keys.append(key)
        self.sets.append(found)
        self.size += len(found)

    def _compare(self) -> None:
        """Link the sets in memory to each other and to those of every earlier piece."""
        own = np.arange(len(self.root), len(self.keys))
        self.root = np.r_[self.root, own]
        if not self.pieces:
            self._link(self.sets, own)
        begin = 0
        for at, sizes in self.pieces:
            both = np.r_[begin : begin + len(sizes), own]
            begin += len(sizes)
            if (self.root[both] != self.root[both[0]]).any():
                self.file.seek(at)
                earlier = np.frombuffer(self.file.read(8 * int(sizes.sum())), np.uint64)
                self._link(np.split(earlier, np.cumsum(sizes)[:-1]) + self.sets, both)

    def _link(self, sets: list[np.ndarray], places: np.ndarray) -> None:
        known = self.root[places]
        to = np.arange(len(self.root))
        to[known] = known[_groups(sets, known)]
        self.root = to[self.root]

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """Each member that is not the first of its group, with one of the group: (that one, the member)."""
        self._compare()
        if self.file:
            self.file.close()
        keys, other = np.array(self.keys, np.int64), np.flatnonzero(self.root != np.arange(len(self.root)))
        return keys[self.root[other]], keys[other]


def links(marked: DataFrame) -> DataFrame:
    """Edges (a, b) between the keys of ``marked`` (key, bands, text) that span the components of all links found."""
    spark, held = marked.sparkSession, HELD
    nodes = marked.select("key", "bands").dropDuplicates(["key"])
    places = checkpointed(nodes.select("key", F.explode("bands").alias("bucket")))
    buckets = places.groupBy("bucket").agg(F.count("*").alias("n"), F.bit_xor("key").alias("x"), F.bit_xor(F.xxhash64("key")).alias("y")).where("n > 1")
    chosen = buckets.groupBy("n", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket")
    crowded = checkpointed(places.join(chosen, "bucket"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            yield pa.record_batch({"key": part.column("key"), "hashes": pa.array([shingles(t or "").tobytes() for t in part.column("text").to_pylist()], pa.binary())})

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, members = None, Bucket(held)

        def out() -> Iterator[pa.RecordBatch]:
            a, b = members.edges()
            if len(a):
                yield pa.record_batch({"a": pa.array(a), "b": pa.array(b)})

        for part in slices(batches):
            for bucket, key, hashes in zip(*(part.column(c).to_pylist() for c in ("bucket", "key", "hashes"))):
                if bucket != now:
                    yield from out()
                    now, members = bucket, Bucket(held)
                members.add(key, np.frombuffer(hashes, np.uint64))
        yield from out()

    texts = marked.select("key", "text").join(crowded.select("key").distinct(), "key", "left_semi").dropDuplicates(["key"])
    gathered = crowded.join(texts.mapInArrow(read, "key long, hashes binary"), "key").select("bucket", "key", "hashes")
    dealt = gathered.repartition(partitions_for(spark), "bucket").sortWithinPartitions("bucket", "key")
    return dealt.mapInArrow(compare, "a long, b long").distinct()


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one for each group of near-duplicates."""
    numbered = docs.withColumn("__row", F.monotonically_increasing_id())
    schema = StructType([*numbered.schema.fields]).add("__fp", "long").add("__key", "long").add("__bands", ArrayType(LongType()))
    where = docs.columns.index(text_col)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            fps, keys, of_bands = [], [], []
            for text in part.column(where).to_pylist():
                found = shingles(text or "")
                fps.append(simhash.fingerprint(text or ""))
                keys.append(xxhash.xxh64_intdigest(found.tobytes(), SEED))
                of_bands.append(bands(found).view(np.int64).tolist() if len(found) else [])
            more = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (fps, keys)]
            yield pa.RecordBatch.from_arrays([*part.columns, *more, pa.array(of_bands, pa.list_(pa.int64()))], names=schema.names)

    rows = checkpointed(numbered.mapInArrow(mark, schema))
    marked = rows.select(F.col("__row").alias("row"), F.col(id_col).alias("doc_id"), F.col("__fp").alias("fp"), F.col("__key").alias("key"), F.col("__bands").alias("bands"), F.col(text_col).alias("text"))
    near = simhash.links(marked.select("fp").distinct())
    same = marked.select(F.col("fp").alias("a"), F.col("key").alias("b")).distinct()
    found = simhash.components(near.union(links(marked)).union(same))
    roots = marked.select("row", "doc_id", "key").join(found, F.col("key") == F.col("node"), "left").withColumn("root", F.coalesce("root", "key"))
    least = roots.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key", "row")).alias("kept"))
    return rows.join(least.select(F.col("kept.row").alias("__row")), "__row", "left_semi").select(docs.columns)
