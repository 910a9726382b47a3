"""What the operators share: table access, checkpoints, and slices of Arrow batches."""

from __future__ import annotations

import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows handled at a time inside a Python worker: bounds memory when texts are long.
SLICE_ROWS = 256
#: Bytes of text handled at a time where whole slices are arrays of numbers; a longer text is a slice of its own.
SLICE_BYTES = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of ``sf_dir``, in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_of(column: str) -> Column:
    """The text of a column; null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def slices(batches: Iterable[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most ``rows`` rows."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def byte_slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of about ``limit`` bytes of a text column, one row at least."""
    for part in slices(batches):
        sizes = np.diff(bytes_of(part.column(column))[1])
        start, held = 0, 0
        for k, n in enumerate(sizes.tolist()):
            if held + n > limit and k > start:
                yield part.slice(start, k - start)
                start, held = k, 0
            held += n
        if part.num_rows > start:
            yield part.slice(start)


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text array and where each text begins, with the end of the last. A null has none."""
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, ends, data = texts.buffers()
    if not len(texts) or ends is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    offsets = np.frombuffer(ends, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder that all executors share, so that lost executors cost nothing.

    The folder is the session's ``spark.checkpoint.dir``. Where that is unset a temporary one is made on a local master, as in
    tests; on a cluster its absence is an error, for executors share no local folder.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="probity-checkpoint-"))
    return df.checkpoint(eager=True)


def partitions_for(spark: SparkSession, least: int = 1) -> int:
    """The session's number of shuffle partitions, at least ``least``."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
