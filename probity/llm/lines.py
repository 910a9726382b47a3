"""Line dedup by a log-template tree of fixed depth.

A line's path in the tree is its number of tokens, its leading tokens, and which of ``BANDS`` pieces of the rest is the
variable field; the leaf is the template: the tokens outside that piece. Tokens with digits, addresses and urls are variable
anywhere, unless they are over half of the line. Lines too short to spare a piece have one template, all their tokens. So lines
with the same template differ in one stretch of tokens at most. A template that ``MIN_DOCS`` documents share is recurring; its
lines are dropped from all documents but the first (smallest id), so every text stays in one place. A line of ``RUN`` words and
more also has a template of its exact tokens, which recurs from ``RUN_DOCS`` documents on.

The paths are hashed and counted by partial aggregation, so one very common line is one row per task; the join that carries the
counts back can be split by adaptive execution, because nothing above it needs a template's rows together. Half-runs (below) are
counted and joined with them: the texts are read once to count and once to join.

What the lines leave is searched for runs: ``RUN`` words in a row, anywhere within a line, that ``RUN_DOCS`` documents share are cut
out of all documents but the first. From every ``RUN`` words the half-runs of least hash are taken (winnowing), so a shared run
always has a shared half-run. One that different lines share is a hit; only around hits, in lines that are still there, are whole
runs hashed, counted and cut. Equal lines are a matter of templates, so copies of a document put no run into a shuffle. Runs do not
go on from line to line.

Tokens, templates, half-runs and runs are hashed by prefix sums over whole slices of a batch (polynomials modulo 2**64).

Defined cases: null texts count as empty and stay null; lines of fewer than ``MIN_TOKENS`` tokens are never dropped if
they have fewer than ``LEAST_BYTES`` bytes without spaces; a line
repeated within one document only is kept; repeated rows count as documents of their own, but rows of the smallest id keep their
lines; lines of rows with a null id are dropped where a recurring template has another document; the same holds for runs; a line
that a run was cut from counts as dropped, and goes if no word is left; a document may end up empty, and stays; other columns stay
as they are, but for those named as the two counts; empty tables give empty results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from probity.llm.common import byte_slices, bytes_of, checkpointed, table
from probity.llm.words import Sums, mixed, words_in

MIN_DOCS, MIN_TOKENS, LEADING, BANDS, LEAST_BAND = 3, 3, 2, 3, 4
#: Bytes from which a line of fewer than ``MIN_TOKENS`` tokens has a template: text written without spaces is one token a line.
LEAST_BYTES = 24
RUN, HALF, RUN_DOCS = 50, 25, 2
#: Hit lines (in all documents) up to which they are broadcast to the texts, about 50 MB; beyond, the texts are shuffled to them.
BROADCAST_HITS = 500_000
_VARIABLE, _JOIN = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93))


class Parsed:
    """The lines of a slice of texts that hold tokens: of which text, which line of it, from which token on, how many."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.starts, self.ends, self.tokens = words_in(data, offsets)
        breaks = np.flatnonzero(data == 10)
        of_text = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(self.starts, offsets)))
        before = np.bincount(np.searchsorted(self.starts, breaks), minlength=len(self.starts) + 1)
        self.line_of = np.cumsum(before[:-1]) + of_text  # counted through all texts
        self.first = np.flatnonzero(np.diff(self.line_of, prepend=-1))
        self.n = np.diff(np.append(self.first, len(self.starts)))
        self.text = of_text[self.first]
        self.number = self.line_of[self.first] - np.searchsorted(breaks, offsets[self.text]) - self.text
        self.variable = np.zeros(len(self.starts), bool)
        marks = np.flatnonzero((data - np.uint8(48) < 10) | (data == 64))  # digits and @
        self.variable[np.searchsorted(self.starts, marks, "right") - 1] = True
        scheme = np.flatnonzero(data[:-2] == 58)
        scheme = scheme[(data[scheme + 1] == 47) & (data[scheme + 2] == 47)]
        at = np.searchsorted(self.starts, scheme, "right") - 1
        self.variable[at[scheme + 2 < self.ends[at]]] = True

    def templates(self, sums: Sums | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(line, template): the last bit of a template says that it is the exact one of a long line."""
        n, first, line = self.n, self.first, np.arange(len(self.n))
        last = first + n
        if not len(n):
            return line, np.zeros(0, np.uint64)
        exact = sums or Sums(self.tokens)
        variable = np.add.reduceat(self.variable.astype(np.int64), first)
        masked = (n >= MIN_TOKENS) & (variable > 0) & (2 * variable <= n)
        sums = exact
        if masked.any():
            sums = Sums(np.where(self.variable & np.repeat(masked, n), _VARIABLE, self.tokens))
        size = np.add.reduceat(self.ends - self.starts, first)
        short = n < LEADING + BANDS * LEAST_BAND
        whole = short & ((n >= MIN_TOKENS) | (size >= LEAST_BYTES))
        a, b, m = first[whole], last[whole], n[whole].astype(np.uint64)
        lines, found = [line[whole]], [mixed(sums.between(a, b) + m) & ~np.uint64(1)]
        a, b, m = first[~short], last[~short], n[~short]
        cuts = [a + LEADING + (m - LEADING) * k // BANDS for k in range(BANDS + 1)]
        for k in range(BANDS):
            head = mixed(sums.between(a, cuts[k]) + (m * BANDS + k).astype(np.uint64))
            lines.append(line[~short])
            found.append(mixed(head * _JOIN + sums.between(cuts[k + 1], b)) & ~np.uint64(1))
        long = n >= RUN
        lines.append(line[long])
        found.append(self.exact(exact)[long] | np.uint64(1))
        return np.concatenate(lines), np.concatenate(found)

    def exact(self, sums: Sums | None = None) -> np.ndarray:
        """The hash of each line's tokens."""
        sums = sums or Sums(self.tokens)
        return mixed(sums.between(self.first, self.first + self.n) + self.n.astype(np.uint64))

    def least(self, sums: Sums) -> tuple[np.ndarray, np.ndarray]:
        """(place, least hash of a half-run) of each run of ``RUN`` tokens within a line."""
        if len(self.tokens) < RUN:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        low, width = sums.all_of(HALF), 1
        while 2 * width <= RUN - HALF + 1:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        rest = RUN - HALF + 1 - width
        low = np.minimum(low[: len(low) - rest], low[rest:])
        at = np.flatnonzero(self.line_of[: len(low)] == self.line_of[RUN - 1 :])
        return at, low[at]


def templates(line: bytes) -> list[int]:
    """Hashes of the templates of a line; none if it is too short."""
    return Parsed(np.frombuffer(line, np.uint8), np.array([0, len(line)])).templates()[1].tolist()


def _signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(F.col(id_col), text).alias("row_key"))


def _hashes(keyed: DataFrame, places: bool) -> DataFrame:
    """The templates of all lines and the least half-runs of long ones, of one pass over the texts.

    With ``places`` a row for each in its line (hash, doc_id, row_key, line), the lines of half-runs as -1 - line. Else a row for each
    template of a document (hash, doc_id), and one for each half-run of a line (hash, own), where ``own`` is the hash of the line.
    """
    schema = StructType().add("hash", "long").add("doc_id", keyed.schema["doc_id"].dataType)
    schema = schema.add("row_key", "long").add("line", "integer") if places else schema.add("own", "long")
    names = list(schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in byte_slices(batches, "text"):
            parsed = Parsed(*bytes_of(part.column("text")))
            sums = Sums(parsed.tokens)
            line, found = parsed.templates(sums)
            at, low = parsed.least(sums)
            long = np.searchsorted(parsed.first, at, "right") - 1
            new = np.r_[True, (low[1:] != low[:-1]) | (long[1:] != long[:-1])] if len(low) else np.zeros(0, bool)
            long, low = long[new], low[new]
            text = parsed.text[line]
            if places:
                number = np.concatenate([parsed.number[line], -1 - parsed.number[long]]).astype(np.int32)
                take = pa.array(np.concatenate([text, parsed.text[long]]))
                columns = [part.column("doc_id").take(take), part.column("row_key").take(take), pa.array(number)]
            else:
                order = np.lexsort((found, text))
                text, found = text[order], found[order]
                new = np.r_[True, (text[1:] != text[:-1]) | (found[1:] != found[:-1])] if len(text) else np.zeros(0, bool)
                text, found = text[new], found[new]
                half = np.r_[np.zeros(len(found), bool), np.ones(len(low), bool)]
                own = np.concatenate([np.zeros(len(found), np.uint64), parsed.exact(sums)[long]]).view(np.int64)
                columns = [part.column("doc_id").take(pa.array(np.concatenate([text, long]), mask=half)), pa.array(own, mask=~half)]
            yield pa.RecordBatch.from_arrays([_signed(np.concatenate([found, low])), *columns], names=names)

    return keyed.mapInArrow(run, schema)


def found_in(keyed: DataFrame, min_docs: int = MIN_DOCS, run_docs: int = RUN_DOCS) -> DataFrame:
    """(doc_id, row_key, line, half): the lines that recurring templates drop, half null, and the half-runs that different lines share.

    A template recurs if ``min_docs`` documents share it, or ``run_docs`` if it is a long line's own.
    """
    counted = _hashes(keyed, False).groupBy("hash").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"), F.min("own").alias("low"), F.max("own").alias("high"))
    # half-runs have no doc_id here, so a first one is a template's
    recurs = F.col("first_doc").isNotNull() & (F.col("n") >= F.when(F.col("hash") % 2 == 0, min_docs).otherwise(run_docs))
    often = F.coalesce(F.col("low") != F.col("high"), F.lit(False))
    known = counted.where(recurs | often).select("hash", F.when(recurs, F.col("first_doc")).alias("first_doc"), often.alias("often"))
    met = _hashes(keyed, True).join(known, "hash").where("if(line < 0, often, first_doc is not null and not (doc_id <=> first_doc))")
    return met.selectExpr("doc_id", "row_key", "if(line < 0, -1 - line, line) as line", "if(line < 0, hash, null) as half").distinct()


def _runs(keyed: DataFrame, halves: DataFrame, drops: DataFrame, run_docs: int) -> DataFrame:
    """(doc_id, row_key, line, start): the runs around ``halves`` to cut from the lines that are not among ``drops`` (doc_id, row_key, line)."""
    schema = keyed.select("doc_id", "row_key").schema

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in byte_slices(batches, "text"):
            parsed = Parsed(*bytes_of(part.column("text")))
            sums = Sums(parsed.tokens)
            at, low = parsed.least(sums)
            line = np.searchsorted(parsed.first, at, "right") - 1
            text, number = parsed.text[line], parsed.number[line]
            hits = part.column("hits")
            of = np.repeat(np.arange(part.num_rows), hits.value_lengths().to_numpy(zero_copy_only=False))
            flat = hits.flatten()
            wanted = flat.field("half").to_numpy().view(np.uint64)
            there = set(zip(of.tolist(), flat.field("line").to_pylist(), wanted.tolist()))
            known = np.isin(low, wanted)
            at, line, text, number, low = at[known], line[known], text[known], number[known], low[known]
            good = np.array([t in there for t in zip(text.tolist(), number.tolist(), low.tolist())], bool)
            at, line, text, number = at[good], line[good], text[good], number[good]
            run = sums.all_of(RUN)[at] if len(at) else np.zeros(0, np.uint64)
            # a row for each run of a line, however often the line repeats it
            order = np.lexsort((at, run, line))
            at, line, text, number, run = at[order], line[order], text[order], number[order], run[order]
            new = np.flatnonzero(np.r_[True, (run[1:] != run[:-1]) | (line[1:] != line[:-1])]) if len(run) else at
            take = pa.array(text[new])
            starts = pa.ListArray.from_arrays(pa.array(np.append(new, len(at)).astype(np.int32)), pa.array((at - parsed.first[line]).astype(np.int32)))
            columns = [part.column("doc_id").take(take), part.column("row_key").take(take), _signed(run[new]), pa.array(number[new].astype(np.int32)), starts]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "row_key", "run", "line", "starts"])

    gone = drops.select(F.col("doc_id").alias("__i"), F.col("row_key").alias("__k"), F.col("line").alias("__l"))
    left = halves.join(gone, (F.col("row_key") == F.col("__k")) & (F.col("line") == F.col("__l")) & F.col("doc_id").eqNullSafe(F.col("__i")), "left_anti")
    held = checkpointed(left.groupBy(F.col("doc_id").alias("i"), F.col("row_key").alias("k")).agg(F.collect_set(F.struct("line", "half")).alias("hits")))
    total = held.agg(F.sum(F.size("hits"))).first()[0] or 0
    held = F.broadcast(held) if total <= BROADCAST_HITS else held
    texts = keyed.join(held, (F.col("row_key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("i")))
    found = texts.select("doc_id", "row_key", "text", "hits").mapInArrow(whole, StructType([*schema.fields]).add("run", "long").add("line", "integer").add("starts", ArrayType(IntegerType())))
    runs = checkpointed(found)
    once = runs.select("run", "row_key", "doc_id").distinct()
    shared = once.groupBy("run").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).where(F.col("n") >= run_docs).select("run", "first_doc")
    return runs.join(shared, "run").where("first_doc is not null and not (doc_id <=> first_doc)").select("doc_id", "row_key", "line", F.explode("starts").alias("start"))


def cut_runs(text: str, cuts: list[tuple[int, int]]) -> tuple[str, int]:
    """The text without the runs of ``RUN`` words that begin at (line, word), or the whole line where word is -1, and the number of these lines."""
    lines = text.encode("utf-8", "surrogatepass").split(b"\n")
    of_line: dict[int, list[int]] = {}
    for line, start in cuts:
        of_line.setdefault(line, []).append(start)
    for number, starts in of_line.items():
        if min(starts) < 0:
            lines[number] = None
            continue
        line, spans = lines[number], [m.span() for m in re.finditer(rb"\S+", lines[number])]
        kept, end, reach = [], 0, -1
        for start in sorted(starts):
            if start > reach:
                kept.append(line[end : spans[start][0]])
            reach = max(reach, start + RUN)
            end = spans[reach][0] if reach < len(spans) else len(line)
        out = b"".join([*kept, line[end:]])
        lines[number] = out if out.split() else None
    return b"\n".join(x for x in lines if x is not None).decode("utf-8", "surrogatepass"), len(of_line)


def drop_recurring_lines(docs: DataFrame, *, min_docs: int = MIN_DOCS, run_docs: int = RUN_DOCS, id_col: str = "doc_id", text_col: str = "text", lines_col: str = "n_lines", dropped_col: str = "n_dropped") -> DataFrame:
    """``docs`` with the recurring lines taken out of ``text_col``, and two counts, which replace columns of the same name."""
    keyed = _keyed(docs, id_col, text_col)
    found = checkpointed(found_in(keyed, min_docs, run_docs))
    whole = found.where("half is null").select("doc_id", "row_key", "line")
    both = whole.withColumn("start", F.lit(-1)).union(_runs(keyed, found.where("half is not null"), whole, run_docs))
    drops = both.groupBy(F.col("doc_id").alias("__drop_id"), F.col("row_key").alias("__drop_key")).agg(F.collect_set(F.struct("line", "start")).alias("__drops"))
    source = docs.drop(lines_col, dropped_col)
    keyed_docs = source.withColumn("__row_key", F.xxhash64(F.col(id_col), F.coalesce(F.col(text_col), F.lit(""))))
    # the id belongs to the key: hashes alone would meet by chance in a very large table
    joined = keyed_docs.join(drops, (F.col("__row_key") == F.col("__drop_key")) & F.col(id_col).eqNullSafe(F.col("__drop_id")), "left")
    names, where = source.columns, source.columns.index(text_col)
    schema = StructType([*source.schema.fields]).add(lines_col, "integer").add(dropped_col, "integer")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in byte_slices(batches, text_col):
            texts, drops = part.column(where), part.column(len(names))
            counts = pc.fill_null(pc.add(pc.count_substring(texts, "\n"), pa.scalar(1, pa.int32())), 0)
            hit = drops.is_valid().to_numpy(zero_copy_only=False)
            gone, at = np.zeros(len(hit), np.int32), np.flatnonzero(hit)
            if len(at):
                cuts = [cut_runs(t, [(d["line"], d["start"]) for d in own]) for t, own in zip(texts.take(pa.array(at)).to_pylist(), drops.take(pa.array(at)).to_pylist())]
                gone[at] = [n for _, n in cuts]
                texts = pc.replace_with_mask(texts, pa.array(hit), pa.array([t for t, _ in cuts], texts.type))
            columns = [texts if k == where else part.column(k) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([*columns, counts, pa.array(gone)], names=[*names, lines_col, dropped_col])

    return joined.select(*names, "__drops").mapInArrow(cut, schema)


def op8_template_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_recurring_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
