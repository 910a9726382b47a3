"""Language-model scores by stupid backoff, from n-gram counts over all documents.

The plan is a relational join whose rows are packed. (1) Of the words that a batch holds ``FREQUENT`` times or more the most frequent, at
most ``BOOK``, get numbers by which n-grams are written in little room: a code, which changes no count. (2) Documents are read in batches of about ``BATCH_TOKENS``
words; the distinct n-grams of a batch go to count tables partitioned by a hash of the n-gram, as sorted keys with counts.
(3) Each table adds up its rows and sends every batch the total counts of the n-grams that it asked for, in its order, so keys
travel once. (4) A batch joins the counts with the n-grams of its documents and sums the scores per document.

A frequent n-gram is one entry per batch, so no table grows with a word's frequency; the number of tables grows with the input (``TABLE_BYTES`` of text each), so a table fits in a worker at any size. N-grams that hold a
word without a number, or more than three words, are known by 63 bits of hash.

score(w | h) = C(hw) / C(h) where C(hw) >= ``min_count``, else ``ALPHA`` times the score given h without its first word; with no
history C(w) / N. Words are what stands between [\\x20\\x09-\\x0D], with A-Z lower-cased; n-grams do not cross documents.

Defined cases: null texts count as empty; texts without words have no n-grams, a log score of 0 and a null mean; repeated rows
count and are scored each; ids may be of any type, null ones are kept; a text longer than a batch is a batch of its own; empty tables
give empty results; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probity.llm.common import byte_slices, bytes_of, checkpointed, partitions_for, slices, table
from probity.llm.words import lowered, mixed, words_in

ORDER, ALPHA, MIN_COUNT = 3, 0.4, 2
BATCH_TOKENS, TABLE_BYTES, LEAST_BITS = 1_000_000, 16_000_000, 6
#: Words with numbers, 16 bytes each on the driver and in a worker.
BOOK_BITS, FREQUENT = 18, 4
BOOK = 1 << BOOK_BITS
_A, _B, _HASHED = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(1 << 63)
_KEYS = "kind int, part long, batch long, keys binary, counts binary"
_KINDS = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
_NAMES = ("kind", "part", "batch", "keys", "counts")


def _zip(x: np.ndarray) -> bytes:
    """Integers by planes of their bytes, compressed: small ones and small steps take little room."""
    head = len(x).to_bytes(8, "little")
    if not len(x):
        return head
    raw = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes()
    return head + pa.compress(raw, codec="zstd", asbytes=True)


def _unzip(data: bytes, kind: type) -> np.ndarray:
    n, width = int.from_bytes(data[:8], "little"), np.dtype(kind).itemsize
    if not n:
        return np.zeros(0, kind)
    raw = pa.decompress(data[8:], decompressed_size=n * width, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, n).T).view(kind).ravel()


def _hashed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the words of some texts, and for each text the number of words up to its end."""
    data, offsets = bytes_of(texts)
    starts, _, hashes = words_in(lowered(data), offsets)
    return hashes, np.searchsorted(starts, offsets[1:])


class Book:
    """Words with numbers, by falling count."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray):
        self.hashes = hashes[np.lexsort((hashes, -counts))]
        self.number = np.argsort(self.hashes)
        self.sorted = self.hashes[self.number]

    def codes(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each word its number, or ``BOOK`` and its place among the others; and the hashes of the others."""
        if not len(hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        different, place = np.unique(hashes, return_inverse=True)
        at = np.minimum(np.searchsorted(self.sorted, different), max(0, len(self.sorted) - 1))
        known = self.sorted[at] == different if len(self.sorted) else np.zeros(len(different), bool)
        code = np.empty(len(different), np.int64)
        code[known] = self.number[at[known]]
        code[~known] = BOOK + np.arange((~known).sum())
        return code[place], different[~known]


def grams(codes: np.ndarray, others: np.ndarray, book: np.ndarray, ends: np.ndarray, order: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For k = 1 .. order: the keys of all k-grams, and the place of the last word of each."""
    n = len(codes)
    position = np.arange(n) - np.repeat(np.r_[0, ends[:-1]], np.diff(np.r_[0, ends])) if n else np.zeros(0, np.int64)
    outside = codes >= BOOK
    hashes = np.empty(n, np.uint64)
    hashes[outside] = others[codes[outside] - BOOK]
    hashes[~outside] = book[codes[~outside]]
    places, keys = [np.arange(n)], [np.where(outside, hashes | _HASHED, codes.astype(np.uint64))]
    rolled, packed, odd = hashes, codes.astype(np.uint64), outside
    for k in range(2, order + 1):
        if n < k:
            keys.append(np.zeros(0, np.uint64))
            places.append(np.zeros(0, np.int64))
            continue
        last = slice(k - 1, None)
        rolled = (rolled[:-1] * _A + hashes[last]) * _B
        rolled ^= rolled >> np.uint64(29)
        odd = odd[:-1] | outside[last]
        packed = (packed[:-1] << np.uint64(BOOK_BITS)) | codes[last].astype(np.uint64)
        inside = position[last] >= k - 1
        key = np.where(odd, rolled | _HASHED, packed | np.uint64(k - 1 << 61)) if k <= 3 else rolled | _HASHED
        keys.append(key[inside])
        places.append(np.flatnonzero(inside) + k - 1)
    return keys, places


def _by_table(different: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of sorted keys by table, then by key; and the tables in that order.

    A hash says its table by its first bits, so that the hashes of a table lie close together and their steps take less room.
    """
    spread = np.where(different & _HASHED != 0, different << np.uint64(1), mixed(different * _A))
    tables = (spread >> np.uint64(64 - bits)).astype(np.int64)
    order = np.argsort(tables, kind="stable")
    return order, tables[order]


def _batches(parts: Iterator[pa.RecordBatch], least: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(ids, hashes of the words, ends of the texts) of about ``least`` words each."""
    held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []

    def out() -> tuple[pa.Array, np.ndarray, np.ndarray]:
        ids, hashes, ends = zip(*held)
        base = np.cumsum([0, *map(len, hashes)])
        held.clear()
        return pa.concat_arrays(ids), np.concatenate(hashes), np.concatenate([e + b for e, b in zip(ends, base)])

    for part in byte_slices(parts, "text", limit=max(1, 4 * least)):
        held.append((part.column("doc_id"), *_hashed(part.column("text"))))
        if sum(len(h) for _, h, _ in held) >= least:
            yield out()
    if held:
        yield out()


def count_words(source: DataFrame) -> DataFrame:
    """(word, n): the hash of every word that a batch holds ``FREQUENT`` times or more, and how often such batches hold it."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, hashes, _ in _batches(parts, BATCH_TOKENS):
            different, counts = np.unique(hashes, return_counts=True)
            often = counts >= FREQUENT
            yield pa.record_batch({"word": pa.array(different[often].view(np.int64)), "n": pa.array(counts[often].astype(np.int64))})

    return source.mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(source: DataFrame) -> Book:
    """The words whose count reaches the least power of two that at most ``BOOK`` words reach."""
    counted = checkpointed(count_words(source))
    by_size = {r["size"]: r["words"] for r in counted.groupBy(F.floor(F.log2("n")).cast("int").alias("size")).agg(F.count("*").alias("words")).collect()}  # at most 64 rows
    total, size = 0, 63
    while size >= 0 and total + by_size.get(size, 0) <= BOOK:
        total += by_size.get(size, 0)
        size -= 1
    rows = counted.where(F.floor(F.log2("n")) > size).toPandas()
    return Book(rows["word"].to_numpy(np.int64).view(np.uint64), rows["n"].to_numpy(np.int64))


def score_documents(docs: DataFrame, *, order: int = ORDER, alpha: float = ALPHA, min_count: int = MIN_COUNT, id_col: str = "doc_id", text_col: str = "text", batch_tokens: int = BATCH_TOKENS) -> DataFrame:
    """(doc_id, n_tokens, n_backoff, log_score, mean_log_score); n_backoff counts words scored without their full history."""
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(LEAST_BITS, math.ceil(math.log2(max(1, size / TABLE_BYTES))))
    width = partitions_for(spark)
    book = spark.sparkContext.broadcast(frequent_words(source))  # at most BOOK words, 16 bytes each
    out_schema = source.select("doc_id").schema.add("n_tokens", "long").add("n_backoff", "long").add("n_bare", "long").add("part_score", "double")

    def ask(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per batch: its documents as numbers of words (kind 1), and its distinct n-grams for each table (kind 0)."""
        base = TaskContext.get().partitionId() << 32
        for number, (known, hashes, ends) in enumerate(_batches(parts, batch_tokens)):
            codes, others = book.value.codes(hashes)
            del hashes
            keys, counts = np.unique(np.concatenate(grams(codes, others, book.value.hashes, ends, order)[0]), return_counts=True)
            place, tables = _by_table(keys, bits)
            keys, counts = keys[place], counts[place]
            del place
            batch = base + number
            sink = pa.BufferOutputStream()
            row = pa.record_batch({"doc_id": known, "end": pa.array(ends.astype(np.int64))})
            with pa.ipc.new_stream(sink, row.schema) as writer:
                writer.write_batch(row)
            document = _zip(codes.astype(np.uint32))
            rows = [(1, batch, batch, len(document).to_bytes(8, "little") + document + _zip(np.diff(others, prepend=np.uint64(0))), sink.getvalue().to_pybytes())]
            cuts = np.flatnonzero(np.r_[True, tables[1:] != tables[:-1]]) if len(keys) else np.zeros(0, np.int64)
            for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(keys)]):
                steps = np.diff(keys[lo:hi], prepend=np.uint64(0))
                rows.append((0, int(tables[lo]), batch, _zip(steps), _zip(counts[lo:hi].astype(np.uint32))))
            for at in range(0, len(rows), 64):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at : at + 64]), _KINDS)], names=_NAMES)

    def add_up(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per table: the total count of every n-gram, sent to each batch that asked, in the order in which it asked."""
        open_: list[tuple[int, np.ndarray, np.ndarray]] = []
        now = None

        def flush() -> Iterator[pa.RecordBatch]:
            if not open_:
                return
            keys, place = np.unique(np.concatenate([k for _, k, _ in open_]), return_inverse=True)
            total = np.zeros(len(keys), np.int64)
            np.add.at(total, place, np.concatenate([c for _, _, c in open_]).astype(np.int64))
            at = 0
            for batch, k, _ in open_:
                reply = total[place[at : at + len(k)]]
                at += len(k)
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((0, now, batch, b"", _zip(reply.astype(np.uint64))), _KINDS)], names=_NAMES)
            open_.clear()

        for part in slices(parts, 32):
            for k in range(part.num_rows):
                if part.column("kind")[k].as_py() == 1:
                    yield part.slice(k, 1)
                    continue
                if (table_number := part.column("part")[k].as_py()) != now:
                    yield from flush()
                    now = table_number
                open_.append((part.column("batch")[k].as_py(), np.cumsum(_unzip(part.column("keys")[k].as_py(), np.uint64), dtype=np.uint64), _unzip(part.column("counts")[k].as_py(), np.uint32)))
        yield from flush()

    def sum_up(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per batch: the counts joined with the n-grams of its documents, and the sums without the terms in log N."""
        now, document, replies = None, None, []

        def flush() -> Iterator[pa.RecordBatch]:
            if now is None:
                return
            packed, about = document
            cut = 8 + int.from_bytes(packed[:8], "little")
            codes, others = _unzip(packed[8:cut], np.uint32).astype(np.int64), np.cumsum(_unzip(packed[cut:], np.uint64), dtype=np.uint64)
            row = pa.ipc.open_stream(about).read_all()
            ends = row.column("end").to_numpy()
            keys, places = grams(codes, others, book.value.hashes, ends, order)
            different, place = np.unique(np.concatenate(keys), return_inverse=True)
            del keys
            found = np.concatenate([_unzip(r, np.uint64) for r in replies] or [np.zeros(0, np.uint64)])
            replies.clear()
            if len(found) != len(different):
                raise RuntimeError(f"batch {now}: {len(found)} counts for {len(different)} n-grams")
            totals = np.empty(len(different))
            totals[_by_table(different, bits)[0]] = found
            del different, found
            logs = np.log(np.maximum(totals, 1.0))
            n = len(codes)
            begin = np.r_[0, ends[:-1]] if len(ends) else np.zeros(0, np.int64)
            position = np.arange(n) - np.repeat(begin, np.diff(np.r_[0, ends])) if n else np.zeros(0, np.int64)
            fullest = np.minimum(position + 1, order)
            alone = logs[place[:n]]  # log C of each word
            value = alone + (fullest - 1) * math.log(alpha)
            whole, bare = fullest == 1, np.ones(n)
            at, history = n, alone  # log C of the history that is one word shorter than the n-gram
            for k, p in enumerate(places[1:], start=2):
                here = place[at : at + len(p)]
                at += len(p)
                enough = totals[here] >= min_count
                value[p[enough]] = logs[here][enough] - history[p[enough] - 1] + (fullest[p[enough]] - k) * math.log(alpha)
                bare[p[enough]] = 0
                whole[p[enough]] = fullest[p[enough]] == k
                history = np.zeros(n)
                history[p] = logs[here]

            def per_document(x: np.ndarray) -> np.ndarray:
                return np.diff(np.r_[0.0, np.cumsum(x)][np.r_[0, ends]]) if len(ends) else np.zeros(0)

            # sums per document, each added up by itself: no difference of long running totals
            sums = np.array([value[a:b].sum() for a, b in zip(begin.tolist(), ends.tolist())])
            yield pa.record_batch({
                "doc_id": row.column("doc_id").combine_chunks(), "n_tokens": pa.array(ends - begin, pa.int64()),
                "n_backoff": pa.array(per_document(~whole).round().astype(np.int64)), "n_bare": pa.array(per_document(bare).round().astype(np.int64)), "part_score": pa.array(sums, pa.float64()),
            })

        for part in slices(parts, 32):
            for k in range(part.num_rows):
                batch = part.column("batch")[k].as_py()
                if batch != now:
                    yield from flush()
                    now, document, replies = batch, None, []
                if part.column("kind")[k].as_py() == 1:
                    document = (part.column("keys")[k].as_py(), part.column("counts")[k].as_py())
                else:
                    replies.append(part.column("counts")[k].as_py())
        yield from flush()

    asked = source.mapInArrow(ask, _KEYS).repartition(width, "kind", "part").sortWithinPartitions("kind", "part", "batch")
    replied = asked.mapInArrow(add_up, _KEYS).repartition(width, "batch").sortWithinPartitions("batch", "kind", "part")
    sums = checkpointed(replied.mapInArrow(sum_up, out_schema))
    total = sums.agg(F.sum("n_tokens")).first()[0] or 1
    score = F.col("part_score") - F.col("n_bare") * math.log(max(1, total))
    return sums.select("doc_id", "n_tokens", "n_backoff", score.alias("log_score")).withColumn("mean_log_score", F.when(F.col("n_tokens") > 0, F.col("log_score") / F.col("n_tokens")))


def op10_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_documents(table(spark, sf_dir, "documents"))
    return scored.select("doc_id", "n_tokens", "n_backoff", F.round("log_score", 6).alias("log_score"), F.round("mean_log_score", 6).alias("mean_log_score"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORACLE_SQL = f"""
with d as (select row_number() over () as k, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents),
e as (select k, unnest(w) as w, unnest(range(1, len(w) + 1)) as i from d),
p as (select e.*, lag(w) over (partition by k order by i) as h, lag(w, 2) over (partition by k order by i) as g from e),
one as (select w, count(*) as c from p group by w),
two as (select h, w, count(*) as c from p where h is not null group by h, w),
three as (select g, h, w, count(*) as c from p where g is not null group by g, h, w),
n as (select count(*) as n from p),
s as (select p.k, case when three.c >= {MIN_COUNT} then ln(three.c) - ln(gh.c)
    when two.c >= {MIN_COUNT} then ln(two.c) - ln(b.c) + case when p.g is null then 0 else ln({ALPHA}) end
    else ln(a.c) - ln(n.n) + case when p.h is null then 0 when p.g is null then ln({ALPHA}) else 2 * ln({ALPHA}) end end as s,
  case when p.h is null or p.g is null and two.c >= {MIN_COUNT} or three.c >= {MIN_COUNT} then 0 else 1 end as backoff
  from p cross join n join one a on a.w = p.w left join one b on b.w = p.h left join two on two.h = p.h and two.w = p.w
  left join two gh on gh.h = p.g and gh.w = p.h left join three on three.g = p.g and three.h = p.h and three.w = p.w),
t as (select k, sum(s) as s, sum(backoff) as backoff from s group by k)
select doc_id, cast(len(w) as bigint) as n_tokens, cast(coalesce(backoff, 0) as bigint) as n_backoff, round(coalesce(s, 0.0), 6) as log_score, round(case when len(w) > 0 then s / len(w) end, 6) as mean_log_score from d left join t using (k)
"""
