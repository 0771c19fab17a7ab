import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from papyra.llm import byte_bpe
from papyra.llm.queries import VOCABULARY, op1_byte_bpe

PATH = P.path(VOCABULARY)


@pytest.fixture(scope="module")
def coder():
    return byte_bpe.ByteBPE(byte_bpe.read_ranks(PATH), P.PATTERN)


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = ["", " ", "hello world", "Ünïcödé  tëxt\n\n\t x", "a" * 30_000, "<|endoftext|> 'll we'LL 123456", "日本語のテキスト", "\U0001f600" * 50, "\x00\x01�", "  trailing   ", "إلى ١٠٠"]


def test_ids_as_the_library(coder, reference):
    for text, ids in zip(TEXTS, coder.encode_batch(TEXTS), strict=True):
        assert ids.tolist() == reference.encode_ordinary(text)
        assert coder.decode(ids) == text.encode()


@settings(max_examples=150, deadline=None)
@given(text=st.text(max_size=80))
def test_any_text(coder, reference, text):
    (ids,) = coder.encode_batch([text])
    assert ids.tolist() == reference.encode_ordinary(text)
    assert coder.decode(ids) == text.encode()


def test_perfect_hash_is_minimal_and_rejects_others():
    rng = random.Random(4)
    keys = list({bytes(rng.randrange(256) for _ in range(rng.randrange(1, 9))) for _ in range(5000)})
    table = byte_bpe.PerfectHash(keys)
    assert table.find(keys) == list(range(len(keys)))
    assert sorted(table.value.tolist()) == list(range(len(keys))) and len(table.keys) == len(keys)
    others = [k + b"\0\0\0\0\0\0\0\0\0" for k in keys]
    assert set(table.find(others)) == {-1}
    assert byte_bpe.PerfectHash([]).find([b"x"]) == [-1]


def test_forgetting_pieces_changes_nothing(coder, reference, monkeypatch):
    monkeypatch.setattr(byte_bpe, "CACHE_BYTES", 2)
    assert [x.tolist() for x in coder.encode_batch(TEXTS)] == [reference.encode_ordinary(t) for t in TEXTS]
    assert [x.tolist() for x in coder.encode_batch(TEXTS[::-1])] == [reference.encode_ordinary(t) for t in TEXTS[::-1]]


def test_table_with_nulls_repeats_and_clashing_names(spark, reference):
    rows = [(1, "a b", "k"), (1, "a b", "k"), (None, None, None), (3, "", "n"), (4, "x" * 5000, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, t string")
    got = byte_bpe.encode(df, PATH, P.PATTERN, keep=("doc_id", "t", "text")).collect()
    assert len(got) == 5
    for r in got:
        ids = reference.encode_ordinary(r["text"] or "")
        assert r["token_ids"] == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
    clash = byte_bpe.encode(df.withColumnRenamed("t", "n_tokens"), PATH, P.PATTERN, keep=("doc_id", "n_tokens"), ids=False)
    assert clash.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and clash.count() == 5
    assert byte_bpe.encode(df.limit(0), PATH, P.PATTERN).collect() == []


def test_query(spark, sf, reference):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op1_byte_bpe(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r["ids_sha256"] == hashlib.sha256(np.array(reference.encode_ordinary(texts[r["doc_id"]]), "<u4").tobytes()).hexdigest()
