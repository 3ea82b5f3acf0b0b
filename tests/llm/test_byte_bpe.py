import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from plumbline.llm import byte_bpe as B
from plumbline.llm import queries

from .helpers import EDGES, docs

FILES = ("byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken")


def library(name):
    ranks = B.read_ranks(open(P.path(name), "rb").read())
    return ranks, tiktoken.Encoding(name, pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("name", FILES)
def test_same_as_the_library(name):
    ranks, lib = library(name)
    enc, dec = B.Encoder(ranks, P.PATTERN, max_words=50, max_states=40), B.Decoder(ranks)  # small tables, so that they overflow
    rnd = random.Random(1)
    parts = [" ", "  ", "\n", "a", "th", "e", "er", "ing", "é", "1", "22", "$", "!", "'s", "\t", " ", "\x1c", "中", "😀", "A", "ß", "　", "\x85"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 30))) for _ in range(3000)]
    texts += [" " * 5000, "a" * 20_000, "ab" * 9000, "=" * 7777, "x y  z \n\n q", "0123456789" * 900, "".join(rnd.choice("abcdefghinort") for _ in range(5000))]
    for t in texts:
        ids = enc.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == lib.encode_ordinary(t)
        assert "".join(dec.decode(ids, chunk=3)) == t


def test_machine_emits_before_the_end():
    ranks, _ = library(FILES[0])
    tokens = B.Transducer(ranks).encode(b"a" * 10_000 + b"b" * 10_000)
    assert next(tokens) == next(iter(B.Transducer(ranks).encode(b"a" * 10_000 + b"b" * 10_000)))


def test_utf8_stream():
    data = "aé中😀߿".encode() + b"\xff\xc3(" + "ü".encode()
    for step in (1, 2, 3, 5):
        s = B.Utf8Stream()
        assert "".join(s.feed(data[i : i + step]) for i in range(0, len(data), step)) + s.finish() == data.decode("utf-8", "replace")
    s = B.Utf8Stream()
    assert s.feed("😀".encode()[:2]) + s.finish() == "�"


def test_all_documents(spark, sf):
    _, lib = library(FILES[0])
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op10_byte_bpe(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = lib.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_edges(spark):
    df = docs(spark, EDGES)
    enc = B.encode(df, P.path(FILES[0]), P.PATTERN)
    back = sorted((str(r["doc_id"]), r["text"]) for r in B.decode(enc, P.path(FILES[0]), P.PATTERN).collect())
    assert back == sorted((str(i), t or "") for i, t in EDGES)
    assert B.digest(docs(spark, []), P.path(FILES[0]), P.PATTERN).count() == 0
