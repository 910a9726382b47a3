"""Nearest neighbours by inner product: a block matrix join with int8 tiles and exact recomputation.

Vectors are quantised to int8, once, with a scale of their own and packed into blocks; every block of queries meets every block of
candidates in a tile. The product of the int8 blocks gives every inner product up to an error that the vectors' norms and residual
norms bound (Cauchy-Schwarz). It is a sum of integers: panels of ``PANEL`` components, whose sums single precision holds exactly,
so that fast matrix kernels can be used, are added up as 64-bit integers, for vectors of any length. Pairs whose upper bound reaches the
k-th largest lower bound known so far survive, are computed again in double precision from the original vectors (of floats or doubles), and heaps merge
the lists of tiles and cells. The result is exact: no index, sample or cap.

The tiles are dealt over a grid, as for a product of matrices: a row of the grid has ``ROW_BLOCKS`` blocks of queries, which fit in
a worker whatever the input, and a column a share of the candidates' blocks. A cell keeps its queries and streams its candidates,
so a block of queries is sent once for each column and a block of candidates once for each row; no key is shared by all blocks.

Defined cases: vectors that are null, empty, zero, or hold a null or non-finite component take no part, nor do rows with a null id;
vectors are compared only with those of the same length; ties go to the smaller vec_id; rows that repeat a vec_id stand for one
candidate, with its largest score; equal vectors, however many, count by their smallest ids; with fewer candidates than k all
are returned; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from probity.llm.common import partitions_for, slices, table

K, QUERY_EVERY = 20, 20
#: Vectors and components of a block, and blocks of queries that a cell keeps.
BLOCK, BLOCK_NUMBERS, ROW_BLOCKS = 4096, 2_000_000, 8
PANEL = 1040  # 127 * 127 * 1040 < 2 ** 24
#: Components at a time in exact products.
_PAIR_NUMBERS = 4_000_000


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales, norms and residual norms of the rows of ``x`` (double)."""
    scale = np.abs(x).max(1) / 127.0
    scale = np.where(scale > 0, scale, 1.0)
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    approx = codes * scale[:, None]
    return codes, scale, np.sqrt((x * x).sum(1)), np.sqrt(((x - approx) ** 2).sum(1))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products row by row, in double precision, added from the first component to the last."""
    total = np.zeros(len(a))
    for j in range(a.shape[1]):
        total += a[:, j].astype(np.float64) * b[:, j].astype(np.float64)
    return total


@dataclass
class Block:
    """Vectors of one length: ids, the original components, int8 codes, and for each vector its scale, norm and residual norm."""

    ids: np.ndarray
    data: np.ndarray
    codes: np.ndarray
    figures: np.ndarray

    @staticmethod
    def of(ids: np.ndarray, data: np.ndarray, k: int | None = None) -> Block:
        """With ``k`` a block of candidates: in order, without repeated rows, and of equal vectors the k + 1 smallest ids only."""
        if k is not None:
            order = np.lexsort((ids, *data.T[::-1])) if len(ids) > 1 else np.arange(len(ids))
            ids, data = ids[order], data[order]
            new = np.r_[True, (data[1:] != data[:-1]).any(1)]
            start = np.maximum.accumulate(np.where(new, np.arange(len(ids)), 0))
            again = np.r_[False, ~new[1:] & (ids[1:] == ids[:-1])]
            ids, data, start = ids[~again], data[~again], start[~again]
            keep = np.arange(len(ids)) - np.searchsorted(start, start) <= k
            ids, data = ids[keep], data[keep]
        codes, *figures = quantise(data.astype(np.float64))
        return Block(ids, data, codes, np.stack(figures))

    def packed(self) -> dict[str, list]:
        """As a row: (dim, wide, ids, data, codes, figures)."""
        wide = self.data.dtype.itemsize == 8
        return {"dim": [self.data.shape[1]], "wide": [wide], "ids": [self.ids.astype("<i8").tobytes()], "data": [self.data.astype("<f8" if wide else "<f4").tobytes()], "codes": [self.codes.tobytes()], "figures": [self.figures.astype("<f8").tobytes()]}

    @staticmethod
    def unpacked(row: dict[str, object]) -> Block:
        ids, dim = np.frombuffer(row["ids"], "<i8"), row["dim"]
        return Block(ids, np.frombuffer(row["data"], "<f8" if row["wide"] else "<f4").reshape(-1, dim), np.frombuffer(row["codes"], np.int8).reshape(-1, dim), np.frombuffer(row["figures"], "<f8").reshape(3, -1))


def code_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The integer products of all rows of ``a`` with all rows of ``b``, both int8."""
    total = np.zeros((len(a), len(b)), np.int64)
    for at in range(0, a.shape[1], PANEL):
        total += (a[:, at : at + PANEL].astype(np.float32) @ b[:, at : at + PANEL].T.astype(np.float32)).astype(np.int64)
    return total


def search_tile(asked: Block, known: Block, k: int, least: np.ndarray | None = None) -> Iterator[tuple[int, list[tuple[float, int]]]]:
    """(row, [(score, vec_id)]) of each query row: its k nearest candidates of the tile, ties to smaller ids.

    ``least`` holds for each row a score that k candidates are known to reach; what is certainly lower may be left out.
    """
    q_ids, q, c_ids, c = asked.ids, asked.data, known.ids, known.data
    (qs, qn, qr), (cs, cn, cr) = asked.figures, known.figures
    spare = len(c_ids) - len(np.unique(c_ids))
    wide = min(k + 1 + spare, len(c))  # the query's own row and repeated ids may take places
    # |xy - x'y'| <= |x| |y - y'| + |x - x'| |y'|, and rounding
    approx_norm = cn + cr
    for at in range(0, len(q), 256):
        rows = slice(at, at + 256)
        dot = code_products(asked.codes[rows], known.codes) * qs[rows, None] * cs[None, :]
        error = qn[rows, None] * cr[None, :] + qr[rows, None] * approx_norm[None, :]
        error += 1e-9 * (qn[rows, None] * cn[None, :]) + 1e-300
        low = np.partition(dot - error, len(c) - wide, axis=1)[:, len(c) - wide]
        if least is not None:
            low = np.maximum(low, least[rows])
        i, j = np.nonzero(dot + error >= low[:, None])
        own = q_ids[at + i] == c_ids[j]
        i, j = i[~own], j[~own]
        pairs = max(1, _PAIR_NUMBERS // c.shape[1])
        exact = np.concatenate([products(q[at + i[s : s + pairs]], c[j[s : s + pairs]]) for s in range(0, len(i), pairs)] or [np.zeros(0)])
        order = np.lexsort((c_ids[j], -exact, i))
        i, j, exact = i[order], j[order], exact[order]
        bounds = np.searchsorted(i, np.arange(len(q[rows]) + 1))
        for r in range(len(q[rows])):
            best: dict[int, float] = {}
            for s in range(bounds[r], bounds[r + 1]):
                best.setdefault(int(c_ids[j[s]]), float(exact[s]))
                if len(best) == k:
                    break
            yield at + r, [(score, vec) for vec, score in best.items()]


def merge(lists: list[list[tuple[float, int]]], k: int) -> list[tuple[float, int]]:
    """The k best of several lists by a heap; each vec_id once."""
    best: dict[int, float] = {}
    for score, vec in heapq.merge(*(sorted(x, key=lambda p: (-p[0], p[1])) for x in lists), key=lambda p: (-p[0], p[1])):
        best.setdefault(vec, score)
        if len(best) == k:
            break
    return [(score, vec) for vec, score in best.items()]


_ROW = "dim int, wide boolean, ids binary, data binary, codes binary, figures binary"
_ROW_ARROW = pa.schema([("dim", pa.int32()), ("wide", pa.bool_()), ("ids", pa.binary()), ("data", pa.binary()), ("codes", pa.binary()), ("figures", pa.binary())])


def _pack(vectors: DataFrame, block: int, k: int | None = None) -> DataFrame:
    """Blocks of about ``block`` vectors of the same length, fewer where they are long; rows that take no part are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[int, list[tuple[np.ndarray, np.ndarray]]] = defaultdict(list)

        def out(dim: int) -> pa.RecordBatch:
            return pa.record_batch(Block.of(*(np.concatenate(x) for x in zip(*open_.pop(dim))), k).packed(), _ROW_ARROW)

        for part in slices(batches, block):
            ids, lists = part.column("id").to_numpy(zero_copy_only=False), part.column("v")
            values = lists.flatten().to_numpy(zero_copy_only=False)
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(sizes)
            for dim in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == dim)
                data = values[((ends[rows] - dim)[:, None] + np.arange(dim)[None, :])]
                good = np.isfinite(data).all(1) & (data != 0).any(1)
                open_[dim].append((ids[rows][good], data[good]))
                if sum(len(i) for i, _ in open_[dim]) >= max(1, min(block, BLOCK_NUMBERS // dim)):
                    yield out(dim)
        for dim in list(open_):
            if sum(len(i) for i, _ in open_[dim]):
                yield out(dim)

    clean = vectors.where("id is not null and v is not null and size(v) > 0 and not exists(v, x -> x is null)")
    return clean.mapInArrow(run, _ROW)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, *, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest of ``vectors`` other than itself."""
    spark = vectors.sparkSession
    width = partitions_for(spark)

    def prepared(df: DataFrame) -> DataFrame:
        kind = "array<float>" if isinstance(df.schema[vector_col].dataType.elementType, FloatType) else "array<double>"
        return df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(kind).alias("v"))

    # few even partitions of queries make full blocks; ROW_BLOCKS of them are a row of the grid
    asked = prepared(queries)
    size = asked.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("longest")).first()
    block = max(1, min(block, BLOCK_NUMBERS // max(1, size["longest"] or 1)))
    blocks = max(1, -(-size["n"] // block))
    rows = -(-blocks // ROW_BLOCKS)
    columns = max(1, -(-2 * width // rows))  # two cells a task, so that tasks even out
    grid_row = F.floor(F.spark_partition_id() / ROW_BLOCKS).cast("int")
    parts = [c.split()[0] for c in _ROW.split(", ")]
    asked_blocks = _pack(asked.repartition(blocks), block).select(F.lit(0).alias("side"), F.least(grid_row, F.lit(rows - 1)).alias("row"), F.explode(F.sequence(F.lit(0), F.lit(columns - 1))).alias("column"), *parts)
    known_blocks = _pack(prepared(vectors), block, k).select(F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0), F.lit(rows - 1))).alias("row"), F.pmod(F.xxhash64("ids"), F.lit(columns)).cast("int").alias("column"), *parts)
    cells = asked_blocks.unionByName(known_blocks).repartition(width, "row", "column").sortWithinPartitions("row", "column", "side")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Cell by cell: the queries are kept, every block of candidates is met once, and each query's list leaves at the end."""
        cell, held = None, []

        def out() -> Iterator[pa.RecordBatch]:
            for asked, best, _ in held:
                found = [(i, x) for i, x in zip(asked.ids.tolist(), best) if x]
                yield pa.record_batch({"query_id": pa.array([i for i, _ in found], pa.int64()), "scores": pa.array([[s for s, _ in x] for _, x in found], pa.list_(pa.float64())), "vec_ids": pa.array([[v for _, v in x] for _, x in found], pa.list_(pa.int64()))})

        for part in slices(batches, 1):
            place = {name: part.column(name)[0].as_py() for name in ("side", "row", "column", *parts)}
            if (place["row"], place["column"]) != cell:
                yield from out()
                cell, held = (place["row"], place["column"]), []
            now = Block.unpacked(place)
            if place["side"] == 0:
                held.append((now, [[] for _ in now.ids], np.full(len(now.ids), -np.inf)))
                continue
            for asked, best, least in held:
                if asked.data.shape[1] != now.data.shape[1]:
                    continue
                for r, found in search_tile(asked, now, k, least):
                    if found:
                        best[r] = merge([best[r], found], k)
                        if len(best[r]) == k:
                            least[r] = best[r][-1][0]
        yield from out()

    lists = cells.mapInArrow(search, "query_id long, scores array<double>, vec_ids array<long>")

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(query: int, kept: list[tuple[float, int]]) -> pa.RecordBatch:
            return pa.record_batch({"query_id": pa.array([query] * len(kept), pa.int64()), "rank": pa.array(range(1, len(kept) + 1), pa.int32()), "vec_id": pa.array([v for _, v in kept], pa.int64()), "score": pa.array([s for s, _ in kept], pa.float64())})

        query, kept = None, []
        for part in slices(batches):
            for q, scores, ids in zip(part.column("query_id").to_pylist(), part.column("scores").to_pylist(), part.column("vec_ids").to_pylist()):
                if q != query and query is not None:
                    yield out(query, kept)
                    kept = []
                query, kept = q, merge([kept, list(zip(scores, ids))], k)
        if query is not None:
            yield out(query, kept)

    by_query = lists.repartition(width, "query_id").sortWithinPartitions("query_id")
    return by_query.mapInArrow(merged, "query_id long, rank int, vec_id long, score double")


def op6_block_matrix_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where(F.col("vec_id") % QUERY_EVERY == 0))


ORACLE_SQL = f"""
with v as (select vec_id, embedding::double[] as e from embeddings
  where embedding is not null and vec_id is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
s as (select q.vec_id as query_id, c.vec_id, list_inner_product(q.e, c.e) as score from v q join v c on q.vec_id % {QUERY_EVERY} = 0 and q.vec_id <> c.vec_id and len(q.e) = len(c.e)),
r as (select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score from s)
select query_id, rank, vec_id, score from r where rank <= {K}
"""
