"""Byte-level BPE against the tiktoken library and the regex that defines its pre-tokens."""

import hashlib
import random

import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken

from faultloom.llm import bpe, queries

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
ODD = list("  \n\t's're'll'd'veSTM aABé中١²½…—'’ 　 🙂😀é\x1c\x85᠎​") + ["'s", "'t", "'re", "  ", "\n\n", " '"]


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(PATH)


@pytest.fixture(scope="module")
def known(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    out = ["".join(rng.choice(ODD) for _ in range(rng.randrange(25))) for _ in range(3000)]
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    out += ["".join(map(chr, points[a : a + 700])) for a in range(0, len(points), 700)]
    out += ["".join(rng.choice(ODD) for _ in range(5000)), "a" * 3000, "b " * 300, "x\n" * 100, " " * 500, "<|endoftext|>"]
    return out


@pytest.mark.parametrize("piece", [64, 1 << 19])
def test_splits(texts, piece, monkeypatch):
    monkeypatch.setattr(bpe, "PIECE_BYTES", piece)
    words, opens = bpe.words_of(pa.array(texts))
    words = words.to_pylist()
    pattern = regex.compile(public_tokenizers.PATTERN)
    for i, text in enumerate(texts):
        assert words[opens[i] : opens[i + 1]] == [w.encode() for w in pattern.findall(text)]


def test_merge(texts, ranks, known):
    for text in [*texts[:200], "ab" * 20000, "é" * 999]:
        assert [i for w in regex.findall(public_tokenizers.PATTERN, text) for i in bpe.merge(w.encode(), ranks)] == known.encode_ordinary(text)
    assert bpe.merge(b"", ranks) == []


@pytest.mark.parametrize("parts, hot", [(1, 1), (5, 0), (12, 1 << 19)])
def test_round_trip(spark, ranks, known, parts, hot):
    rows = [(1, "a b c supercalifragilistic"), (1, "a b c supercalifragilistic"), (1, "other text"), (None, "xyzzy plugh"), (None, None),
            (2, ""), (3, "a'll é　 " * 30000), (4, "q" * 300000), (5, "\n\n \t")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows * 3], "doc_id long, text string, ids int, block string").repartition(parts)
    out = bpe.decode(bpe.encode(docs, ranks, hot_words=hot), ranks).collect()
    key = lambda i, text, ids: (i is None, i or 0, text, ids)
    assert sorted(key(r.doc_id, bytes(r.decoded).decode(), r.ids) for r in out) == sorted(
        key(i, t or "", known.encode_ordinary(t or "")) for i, t in rows * 3
    )


def test_long_texts_cross_blocks(spark, ranks, known):
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choice("alpha betas gamma über".split()) + str(rng.randrange(9999)) for _ in range(n))) for i, n in
            enumerate([3, 60000, 10, 400000, 0])]
    out = bpe.encode(spark.createDataFrame(docs, "doc_id long, text string"), ranks, hot_words=500).collect()
    assert {r.doc_id: r.ids for r in out} == {i: known.encode_ordinary(t) for i, t in docs}


def test_empty_and_unknown_ids(spark, ranks):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.decode(bpe.encode(none, ranks), ranks).collect() == []
    odd = spark.createDataFrame([(1, [-1, 0, 1 << 30, None, 1]), (2, None), (3, [])], "doc_id long, ids array<int>")
    by_rank = {v: k for k, v in ranks.items()}
    assert {r.doc_id: bytes(r.decoded) for r in bpe.decode(odd, ranks).collect()} == {1: by_rank[0] + by_rank[1], 2: b"", 3: b""}


def test_query(spark, sf_dir, known):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    out = queries.QUERIES["op11_byte_bpe"](spark, sf_dir).collect()
    assert {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out} == {
        (i, len(ids), sha(" ".join(map(str, ids)).encode()), sha(t.encode()))
        for i, t in docs.items() for ids in [known.encode_ordinary(t)]
    }
    assert len(out) == len(docs)
