"""Byte-level BPE against the tiktoken library and against merges by definition, and exact round trips."""

import codecs
import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken

from panelspark.llm import byte_bpe, queries, words

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SCHEMA = "doc_id long, text string, ids int, n_tokens string"
ODD = [None, "", " ", " \n\n ", "it's we'll I'd 'tis ''s x'S 're1", "a" * 40_000, "word " * 30_000, "\n" * 3_000 + "x", "<|endoftext|>", "é中😀 ½Ⅷ\x1c\x85　​\x00", "1 a" * 500_000]


@pytest.fixture(scope="module")
def encoder():
    return byte_bpe.Encoder(PATH)


@pytest.fixture(scope="module")
def library(encoder):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=encoder.transducer.ranks, special_tokens={})


def random_texts(seed, n):
    rnd = random.Random(seed)
    parts = [" ", "  ", "\n", "\r\n", "\t", "'", "'s", "'re", "'ll", "'d", "'S", "'v", "a", "the", "é", "中", "1", "23", "!", "...", "😀", "　", "½", "Ⅷ", "\x1c", "\x85", "​", "st", "ing", "\x00", "Straße"]
    return ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 30))) for _ in range(n)]


def test_ids_equal_the_library(encoder, library):
    texts = random_texts(1, 5_000) + [t or "" for t in ODD] + [f"a{chr(c)}b {chr(c)}" for c in range(0, 0x110000, 97) if not 0xD800 <= c < 0xE000]
    for text, ids in zip(texts, encoder.texts(pa.array(texts)), strict=True):
        assert library.encode_ordinary(text) == ids.tolist(), text[:60]


def test_pieces_equal_the_pattern():
    for text in filter(None, random_texts(2, 3_000)):
        data = text.encode()
        starts = byte_bpe.piece_starts(np.frombuffer(data, np.uint8), np.array([0, len(data)])).tolist()
        assert [data[a:b].decode() for a, b in zip(starts, [*starts[1:], len(data)], strict=True)] == regex.findall(public_tokenizers.PATTERN, text)


def test_long_texts_are_cut_where_pieces_begin(encoder, monkeypatch):
    texts = [t for t in random_texts(3, 400) if t] + ["x" * 500, "ab cd " * 300, "a's " * 200 + "it's"]
    whole = [x.tolist() for x in encoder.texts(pa.array(texts))]
    monkeypatch.setattr(words, "CHUNK_BYTES", 16)
    assert [x.tolist() for x in encoder.texts(pa.array(texts))] == whole
    assert len(byte_bpe._parts(np.frombuffer(b"ab cd " * 300, np.uint8))) > 50


def test_small_vocabularies_by_definition():
    """Random merges over three letters: the transducer against the plain loop, and pairs against merging both tokens' bytes."""
    rnd = random.Random(5)
    for _ in range(40):
        ranks = {b"a": 0, b"b": 1, b"c": 2}
        own = byte_bpe.Transducer(ranks)
        while len(ranks) < 25:
            x, y = rnd.choice(list(ranks)), rnd.choice(list(ranks))
            if x + y not in ranks and len(x + y) < 9 and own.merged(x + y) == [ranks[x], ranks[y]]:
                ranks[x + y] = len(ranks)
        ranks[b"cacacacacb"] = 25  # stands for a whole piece only, if merges don't make it
        own = byte_bpe.Transducer(ranks)
        made = [t for t in ranks if own.merged(t) == [ranks[t]]]
        assert all(own.agree(ranks[x], ranks[y]) == (own.merged(x + y) == [ranks[x], ranks[y]]) for x in made for y in made)
        for _ in range(200):
            piece = bytes(rnd.choice(b"abc") for _ in range(rnd.randint(1, 25)))
            assert own.encode(piece) == ([own.ranks[piece]] if piece in own.ranks else own.merged(piece))
    with pytest.raises(ValueError, match="before its halves"):
        byte_bpe.Transducer({b"a": 0, b"b": 1, b"c": 2, b"abc": 3, b"ab": 4})


def test_bounded_tables_give_the_same_ids(library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "TRANSITIONS", 40)
    monkeypatch.setattr(byte_bpe, "PAIRS", 10)
    monkeypatch.setattr(byte_bpe.Encoder, "most", 30)
    monkeypatch.setattr(words, "CHUNK_BYTES", 200)
    own = byte_bpe.Encoder(PATH)
    texts = random_texts(4, 400) + ["unbelievable" * 100]
    assert [x.tolist() for x in own.texts(pa.array(texts))] == [library.encode_ordinary(t) for t in texts]
    assert len(own.transducer.steps) < 200 and len(own.keys) < 200


def test_lookahead_is_bounded(encoder):
    """No state holds back more tokens than the longest token has bytes."""
    list(encoder.texts(pa.array(["".join(random.Random(k).choice("abcdefghij") for _ in range(3_000)) for k in range(20)])))
    assert max(len(held) for _, ways in encoder.transducer.states for held, _ in ways) <= max(map(len, encoder.transducer.ranks))


def test_utf8_stream_equals_the_incremental_decoder():
    rnd = random.Random(6)
    bytes_of = [0x41, 0x80, 0xBF, 0xC3, 0xE0, 0xA0, 0xED, 0x9F, 0xF0, 0x90, 0xF4, 0x8F, 0xFF, 0xE2, 0x82, 0xAC]
    for k in range(4_000):
        valid = k % 2
        data = "".join(rnd.choice("aé€😀") for _ in range(8)).encode() if valid else bytes(rnd.choice(bytes_of) for _ in range(rnd.randint(0, 12)))
        own, theirs, at, got = byte_bpe.Utf8Stream(), codecs.getincrementaldecoder("utf-8")("replace"), 0, ""
        while at < len(data):
            n = rnd.randint(1, 3)
            part = own.feed(data[at : at + n])
            assert not valid or part == theirs.decode(data[at : at + n])  # of what is no UTF-8, that one holds more back
            got, at = got + part, at + n
        assert got + own.finish() == data.decode("utf-8", "replace"), data


def test_documents_round_trip(spark, library):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(ODD)] + [(None, "no id", 1, "x"), (3, ODD[3], 1, "x")], SCHEMA)
    ids = {(r["doc_id"], tuple(r["ids"])) for r in byte_bpe.encode(docs, PATH).collect()}
    assert ids == {(r["doc_id"], tuple(library.encode_ordinary(r["text"] or ""))) for r in docs.collect()}
    back = byte_bpe.decode(byte_bpe.encode(docs, PATH), PATH).collect()
    assert sorted((r["doc_id"] or -1, r["text"]) for r in back) == sorted((r["doc_id"] or -1, r["text"] or "") for r in docs.collect())
    assert byte_bpe.round_trip(docs.limit(0), PATH).count() == 0


def test_query_equals_the_library(spark, library):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.QUERIES["op12_byte_bpe"](spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
