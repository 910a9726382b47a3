"""Benchmark decontamination by greedy string tiling.

Benchmark items are cut into seeds of ``SEED_WORDS`` words; a running Karp-Rabin hash over a document's words finds where it
shares seeds with items. Among the words around them the longest match of unmarked words is found and marked again and again, down to
the length of a seed; hashes of windows decide, and words confirm. The marked share of an item's words is its coverage, which
does not depend on the order of the passages, so reordered ones are caught too.

The benchmark is held in memory in chunks of at most ``CHUNK_WORDS`` words; a larger one takes one pass over the documents per
chunk, so its size is bounded in every pass and no item is left out. Documents are not shuffled.

Defined cases: words that repeat without end match as often as the item has them; null texts count as empty; items without words match nothing; items shorter than a seed must occur whole; repeated rows and
repeated items give a row each; null ids are kept; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict, deque
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probity.llm.common import slices, table

SEED_WORDS, MIN_COVERAGE = 5, 0.5
#: Words of the benchmark in memory at a time: about 100 MB in a worker.
CHUNK_WORDS = 1_000_000
_BASE = 0x100000001B3
_words = re.compile(r"[^\W_]+").findall


def words_of(text: str | None) -> list[str]:
    return _words((text or "").lower())


def rolling(ids: np.ndarray, k: int) -> np.ndarray:
    """Karp-Rabin hashes, modulo 2**64, of all windows of ``k`` ids."""
    n = len(ids) - k + 1
    h = np.zeros(max(0, n), np.uint64)
    for j in range(k if n > 0 else 0):
        h = h * np.uint64(_BASE) + ids[j : j + n]
    return h


class Benchmark:
    """The items of a chunk: their words as numbers, and their seeds by hash."""

    def __init__(self, items: list[tuple[object, str | None]], k: int = SEED_WORDS):
        self.ids = [i for i, _ in items]
        self.vocabulary: dict[str, int] = {}
        self.words = [np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(t)], np.uint64) for _, t in items]
        self.seeds: dict[int, dict[int, list[int]]] = {}
        self.hashes = [np.zeros(0, np.uint64)] * len(self.words)
        for number, words in enumerate(self.words):
            if len(words):
                length = min(k, len(words))
                at = self.seeds.setdefault(length, {})
                self.hashes[number] = np.unique(rolling(words, length))
                for h in self.hashes[number].tolist():
                    at.setdefault(h, []).append(number)
        self.sorted = {length: np.sort(np.fromiter(at, np.uint64, len(at))) for length, at in self.seeds.items()}

    def hits(self, text: str | None) -> Iterator[tuple[int, int, int, int, int]]:
        """(item, matched words, words, tiles, longest) of every item that shares a seed."""
        get = self.vocabulary.get
        ids = np.array([get(w, 0) for w in words_of(text)], np.uint64)
        for length, known in self.sorted.items():
            h = rolling(ids, length)
            if not len(h):
                continue
            inside = np.cumsum(np.r_[0, ids == 0])
            places = np.flatnonzero(inside[length:] == inside[:-length])
            h = h[places]
            shared = known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h
            places, h = places[shared], h[shared]
            for item in sorted({item for value in np.unique(h).tolist() for item in self.seeds[length][value]}):
                own = places[np.isin(h, self.hashes[item])]
                tiles = tile(*_around(ids, own, length), self.words[item], length)
                if tiles:
                    yield item, sum(tiles), len(self.words[item]), len(tiles), max(tiles)


def _around(ids: np.ndarray, places: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of a text that windows of ``k`` words at ``places`` cover, with a word of no item between them; and the places there."""
    covered = np.zeros(len(ids) + 1, bool)
    for j in range(k):
        covered[places + j] = True
    kept = covered.copy()
    kept[1:] |= covered[:-1]
    return np.where(covered, np.r_[ids, np.uint64(0)], np.uint64(0))[kept], (np.cumsum(kept) - 1)[places]


def _windows(words: np.ndarray, free: np.ndarray, places: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the windows of ``n`` words that begin at ``places`` and are free throughout."""
    taken = np.cumsum(np.r_[0, ~free])
    places = places[places + n <= len(words)]
    places = places[taken[places + n] == taken[places]]
    if not len(places):
        return places, np.zeros(0, np.uint64)
    # hashes of all windows by doubling: those of 2k words are made of two of k
    out, done, at = np.zeros(len(places), np.uint64), 0, words
    size, power = 1, _BASE
    while True:
        if n & size:
            out = out * np.uint64(power) + at[places + done]
            done += size
        if 2 * size > n:
            return places, out
        at = at[:-size] * np.uint64(power) + at[size:]
        size, power = 2 * size, power * power % (1 << 64)


def tile(text: np.ndarray, places: np.ndarray, item: np.ndarray, k: int) -> list[int]:
    """Lengths of the tiles that greedy string tiling marks, from the places in the text of seeds of ``k`` words.

    The longest match of unmarked words is found by bisection: windows of one length are compared by their Karp-Rabin hashes. All
    matches of that length are marked from left to right where they are still free, and the search goes on with shorter ones. No
    pairs of places are listed, so texts of one repeated word cost no more than others.
    """
    free_text, free_item = np.ones(len(text), bool), np.ones(len(item), bool)
    every = np.arange(len(item))

    def common(n: int) -> np.ndarray:
        return np.intersect1d(_windows(text, free_text, places, n)[1], _windows(item, free_item, every, n)[1])

    tiles: list[int] = []
    longest = len(item)
    while True:
        low, high = k - 1, longest  # a match of low words is known, or low < k
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if len(common(middle)) else (low, middle - 1)
        if low < k:
            return tiles
        longest = low
        at, h = _windows(text, free_text, places, low)
        both = np.isin(h, common(low))
        waiting: dict[int, deque[int]] = defaultdict(deque)
        for q, value in zip(*(x.tolist() for x in _windows(item, free_item, every, low))):
            waiting[value].append(q)
        marked = False
        for p, value in zip(at[both].tolist(), h[both].tolist()):
            if not free_text[p : p + low].all():
                continue
            queue = waiting[value]
            while queue and not free_item[queue[0] : queue[0] + low].all():
                queue.popleft()
            if queue and (text[p : p + low] == item[queue[0] : queue[0] + low]).all():
                q = queue.popleft()
                free_text[p : p + low] = free_item[q : q + low] = False
                tiles.append(low)
                marked = True
        if not marked:  # only hashes that meet by chance are left at this length
            longest = low - 1


def _chunks(benchmark: DataFrame) -> Iterator[list[tuple[object, str | None]]]:
    """The items in chunks of about ``CHUNK_WORDS`` words; each chunk is read by itself."""
    sized = benchmark.select("item_id", "text", F.size(F.split(F.coalesce("text", F.lit("")), r"\s+")).alias("n"))
    total = sized.agg(F.sum("n")).first()[0] or 0
    count = -(-total // CHUNK_WORDS)
    for c in range(count):
        part = sized if count == 1 else sized.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == c)
        yield sorted(((r["item_id"], r["text"]) for r in part.select("item_id", "text").collect()), key=lambda x: (x[0] is None, x[0], x[1] or ""))


def contamination(docs: DataFrame, benchmark: DataFrame, *, seed_words: int = SEED_WORDS, min_coverage: float = MIN_COVERAGE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, coverage, matched_words, item_words, tiles, longest_tile) of every pair with enough coverage."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text"))
    schema = source.select("doc_id").schema.add("item_id", "long").add("coverage", "double").add("matched_words", "integer").add("item_words", "integer").add("tiles", "integer").add("longest_tile", "integer")
    names = list(schema.names)

    def one(chunk: list[tuple[object, str | None]]) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(chunk)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = Benchmark(shared.value, seed_words)
            for part in slices(batches):
                at, rows = [], []
                for k, text in enumerate(part.column("text").to_pylist()):
                    for item, matched, words, tiles, longest in known.hits(text):
                        if matched >= min_coverage * words:
                            at.append(k)
                            rows.append((known.ids[item], matched / words, matched, words, tiles, longest))
                if rows:
                    kinds = (pa.int64(), pa.float64(), *[pa.int32()] * 4)
                    yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(zip(*rows), kinds))], names=names)

        return source.mapInArrow(run, schema)

    found = [one(chunk) for chunk in _chunks(items)]
    return reduce(DataFrame.union, found) if found else docs.sparkSession.createDataFrame([], schema)


def op7_greedy_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
