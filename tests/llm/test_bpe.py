import hashlib
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from probity.llm import bpe

tokenizers = pytest.importorskip("tokenizers")
PATH = bpe.default_vocabulary()
LIBRARY = tokenizers.Tokenizer.from_file(PATH)
CODEC = bpe.Codec(bpe.Vocabulary.parse(open(PATH, encoding="utf-8").read()))


def library(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_any_text_as_the_library(text):
    assert CODEC.encode(text) == library(text)
    assert CODEC.decode(library(text)) == LIBRARY.decode(library(text), skip_special_tokens=False) == text


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab 'st\n\t<|endoftext|>1.é", max_size=60))
def test_dense_alphabet_as_the_library(text):
    assert CODEC.encode(text) == library(text)


@given(st.lists(st.integers(0, 50256), max_size=30))
@settings(max_examples=100, deadline=None)
def test_decoding_any_ids(ids):
    assert CODEC.decode(ids) == LIBRARY.decode(ids, skip_special_tokens=False)


def naive(tokens, merges):
    tokens = list(tokens)
    while True:
        ranked = [(merges[p][0], i) for i, p in enumerate(zip(tokens, tokens[1:])) if p in merges]
        if not ranked:
            return tokens
        _, i = min(ranked)
        tokens[i : i + 2] = [merges[tokens[i], tokens[i + 1]][1]]


@given(st.lists(st.integers(0, 2), max_size=40))
def test_segment_tree_merges_as_a_scan_does(tokens):
    merges = {(0, 0): (3, 3), (0, 1): (1, 4), (3, 3): (0, 5), (4, 2): (2, 6), (1, 1): (4, 7), (6, 0): (5, 8)}
    assert bpe.merge_piece(tokens, merges) == naive(tokens, merges)


def test_a_long_piece_is_encoded_whole():
    text = "abcdefghij" * 5000
    assert CODEC.encode(text) == library(text)


def test_a_full_cache_changes_nothing(prose):
    small = bpe.Codec(CODEC.vocabulary, cache=3)
    assert all(small.encode(t) == CODEC.encode(t) for t in prose[:20])


def test_query_columns(spark, docs):
    rows = bpe.encode(docs, PATH).collect()
    assert len(rows) == docs.count()
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in rows:
        ids = library(texts[r["doc_id"]])
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_empty_table(no_docs):
    assert bpe.encode(no_docs, PATH).count() == 0
