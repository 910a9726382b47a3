"""Byte-level BPE encoding and decoding with a segment tree over adjacent pair ranks.

Each piece of the pre-tokenizer starts as its bytes. The leaves of a segment tree hold ``rank * width + place`` of every
adjacent pair, so the root is the lowest rank and, among equal ranks, the leftmost place. The pair at the root is merged, the
leaves of its neighbours are updated in logarithmic time, and this goes on until no pair has a rank.

Defined cases: a null text counts as empty and has no tokens; repeated rows are encoded each; empty tables give empty results;
lone surrogates cannot occur in Spark strings; texts of any length are encoded whole; ids outside the vocabulary are refused
by ``decode``; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from probity.llm.common import slices, table

#: Pieces kept with their ids in a worker; beyond this the store starts anew, which changes no result.
CACHE_PIECES = 500_000
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
_NONE = 1 << 62


def _byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write the 256 bytes: printable ones themselves, the rest from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    rest = (b for b in range(256) if b not in set(plain))
    return letters | {chr(256 + k): b for k, b in enumerate(rest)}


@dataclass(frozen=True)
class Vocabulary:
    """Merges by pair of ids, the bytes of each id, the id of each byte, and the added tokens."""

    merges: dict[tuple[int, int], tuple[int, int]]
    pieces: dict[int, bytes]
    bytes_to_id: list[int]
    added: dict[str, int]

    @staticmethod
    def parse(document: str) -> Vocabulary:
        j = json.loads(document)
        letters, ids = _byte_letters(), j["model"]["vocab"]
        pieces = {k: bytes(letters[c] for c in t) for t, k in ids.items()}
        merges = {}
        for rank, pair in enumerate(j["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            merges[ids[a], ids[b]] = (rank, ids[a + b])
        added = {t["content"]: t["id"] for t in j.get("added_tokens", [])}
        pieces |= {k: t.encode() for t, k in added.items()}
        by_byte = {b: ids[c] for c, b in letters.items()}
        return Vocabulary(merges, pieces, [by_byte[b] for b in range(256)], added)


def merge_piece(tokens: list[int], merges: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """The ids of one piece after all merges, lowest rank first and leftmost among equals."""
    n = len(tokens)
    if n < 2:
        return tokens
    get = merges.get
    width = 1 << (n - 2).bit_length() if n > 2 else 1
    tree = [_NONE] * (2 * width)
    for i in range(n - 1):
        if found := get((tokens[i], tokens[i + 1])):
            tree[width + i] = found[0] * width + i
    for k in range(width - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    if tree[1] == _NONE:
        return tokens
    tokens = list(tokens)
    following, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def put(place: int, value: int) -> None:
        k = width + place
        if tree[k] == value:
            return
        tree[k] = value
        while k > 1:
            k >>= 1
            a, b = tree[2 * k], tree[2 * k + 1]
            low = a if a < b else b
            if tree[k] == low:
                return
            tree[k] = low

    while tree[1] != _NONE:
        i = tree[1] % width
        j = following[i]
        tokens[i] = get((tokens[i], tokens[j]))[1]
        after = following[j]
        following[i] = after
        tokens[j] = -1
        if after < n:
            before[after] = i
            put(j, _NONE)
            found = get((tokens[i], tokens[after]))
            put(i, found[0] * width + i if found else _NONE)
        else:
            put(i, _NONE)
            if j < n - 1:
                put(j, _NONE)
        p = before[i]
        if p >= 0:
            found = get((tokens[p], tokens[i]))
            put(p, found[0] * width + p if found else _NONE)
    return [t for t in tokens if t >= 0]


class Codec(dict):
    """Encodes texts to ids and back. As a dict it maps pieces to their ids, packed as little-endian 32-bit integers."""

    def __init__(self, vocabulary: Vocabulary, cache: int = CACHE_PIECES):
        super().__init__()
        self.vocabulary, self.cache = vocabulary, cache
        self.find = regex.compile(_PIECES).findall
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(vocabulary.added, key=len, reverse=True))) + ")").split if vocabulary.added else None

    def __missing__(self, piece: str) -> bytes:
        start = self.vocabulary.bytes_to_id
        packed = np.array(merge_piece([start[b] for b in piece.encode()], self.vocabulary.merges), "<u4").tobytes()
        if len(piece) <= 64:
            if len(self) >= self.cache:
                self.clear()
            self[piece] = packed
        return packed

    def encode_packed(self, text: str) -> bytes:
        added = self.vocabulary.added
        if self.split is None or not any(t in text for t in added):
            return b"".join(map(self.__getitem__, self.find(text)))
        return b"".join(added[part].to_bytes(4, "little") if part in added else b"".join(map(self.__getitem__, self.find(part))) for part in self.split(text))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text), "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        """The text of the ids; bytes that are not UTF-8 become U+FFFD."""
        return b"".join(map(self.vocabulary.pieces.__getitem__, ids)).decode("utf-8", "replace")


_CODECS: dict[str, Codec] = {}


def codec_of(document: str) -> Codec:
    """The codec of a vocabulary document; a worker keeps the last one between tasks."""
    key = hashlib.sha256(document.encode()).hexdigest()
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(Vocabulary.parse(document))
    return _CODECS[key]


def encode(docs: DataFrame, vocabulary_path: str, *, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Per row of ``docs``: the id, n_tokens, digests of ids and of the decoded text, and the ids themselves if ``with_ids``.

    The vocabulary file is read once, on the driver, and broadcast: its size is that of a fixed published file, whatever the input.
    """
    spark = docs.sparkSession
    with open(vocabulary_path, encoding="utf-8") as file:
        shared = spark.sparkContext.broadcast(file.read())
    source = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    schema = source.select("doc_id").schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    if with_ids:
        schema = schema.add("ids", T.ArrayType(T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(shared.value)
        pieces = codec.vocabulary.pieces.__getitem__
        for part in slices(batches):
            counts, of_ids, of_text, ids = [], [], [], []
            for text in part.column("text").to_pylist():
                packed = codec.encode_packed(text or "")
                found = np.frombuffer(packed, "<u4").tolist()
                decoded = b"".join(map(pieces, found)).decode("utf-8", "replace")
                counts.append(len(found))
                of_ids.append(hashlib.sha256(packed).hexdigest())
                of_text.append(hashlib.sha256(decoded.encode()).hexdigest())
                if with_ids:
                    ids.append(found)
            columns = [part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(ids, pa.list_(pa.int32()))] * with_ids, names=schema.names)

    return source.mapInArrow(run, schema)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op2_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), default_vocabulary(), with_ids=False)
