import base64
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import tiktoken

import public_tokenizers
from lumenfold.llm._text import string_bytes
from lumenfold.llm.bpe import Vocabulary, decode, encode, op4_bpe, safe_cuts

SF, PATH = "/root/testdata/sf0.001", public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
BITS = ["'s", "'t", "'re", "'ve", "'m", "'ll", "'d", "'", " ", "  ", "\n", "\t", "a", "é", "B", "1", "²", "!", " ", "　", "漢", "🙂", "ll", "\x1c", "\x85", "ǅ", "́", "l", "v", "s", "\r\n", "\0"]


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_as_the_library(library):
    r = random.Random(3)
    texts = ["".join(r.choice(BITS) for _ in range(r.randint(0, 40))) for _ in range(3000)] + ["<|endoftext|> a", "a" * 3000, "ab" * 500]
    ids, at = Vocabulary(PATH).encode(*string_bytes(pa.array(texts)))
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == [library.encode_ordinary(t) for t in texts]


def test_operator_on_odd_rows(spark, library):
    texts = [None, "", " ", "a b" * 9000, "x" * 4000, "it's 12 o'clock", "it's 12 o'clock"]
    df = spark.createDataFrame([(i, t, "old") for i, t in enumerate(texts)], "k int, text string, ids string")
    got = {r.k: r for r in encode(df, PATH, decode=True, limit=1000).collect()}
    for i, t in enumerate(texts):
        assert got[i].ids == library.encode_ordinary(t or "") and bytes(got[i].decoded) == (t or "").encode()
    assert encode(df.limit(0), PATH).collect() == []
    words = {i: w for w, i in library._mergeable_ranks.items()}
    for r in encode(df, PATH, offsets=True, limit=1000).collect():
        b = (texts[r.k] or "").encode()
        assert [b[a:e] for a, e in zip([0, *r.ends], r.ends, strict=False)] == [words[i] for i in r.ids]
    back = decode(encode(df, PATH), PATH).collect()
    assert {r.k: bytes(r.decoded).decode() for r in back} == {i: t or "" for i, t in enumerate(texts)}


@pytest.mark.parametrize("words", ["word  two\n three's ", "слово\u00a0два\u2003 три. ", "你好，世界。再见", "एक दो\u0301 ", "12 34! ", "".join(BITS)])
def test_cuts_change_nothing(library, words):
    r = random.Random(4)
    t = "".join(words[r.randrange(len(words)) :] for _ in range(600)).encode()
    cuts = [0, *safe_cuts(np.frombuffer(t, np.uint8), 100), len(t)]
    parts = [library.encode_ordinary(t[a:b].decode()) for a, b in zip(cuts, cuts[1:], strict=False)]
    assert len(parts) > 10 and max(np.diff(cuts)) < 300 and sum(parts, []) == library.encode_ordinary(t.decode())


def test_cuts_beyond_a_window(library):
    t = ("я" * 70_000 + " " + "語" * 50_000 + "。a").encode()
    cuts = safe_cuts(np.frombuffer(t, np.uint8), 1000)
    assert cuts == [140_000, 290_001] and safe_cuts(np.frombuffer(("é" * 90_000).encode(), np.uint8), 1000) == []


def test_query(spark, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in op4_bpe(spark, SF).collect():
        ids = library.encode_ordinary(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(docs[r.doc_id].encode()).hexdigest())


def test_decoding_goes_by_the_offsets(spark):
    texts = ["one two", None, "", "three é", "x" * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    both = encode(df, PATH, decode=True, offsets=True, limit=1000)
    assert both.columns == ["k", "text", "ids", "ends", "decoded"]
    assert {r.k: (bytes(r.decoded).decode(), r.ends[-1] if r.ends else 0) for r in both.collect()} == {k: (t or "", len((t or "").encode())) for k, t in enumerate(texts)}
    wrong = both.drop("decoded").where("k = 0").selectExpr("k", "ids", "transform(ends, x -> x + 1) AS ends")
    with pytest.raises(Exception, match="offsets"):
        decode(wrong, PATH).collect()


@pytest.mark.parametrize("text", ["12345 " * 300, "ก" * 900, "- " * 700, "\u0e34" * 500 + " .", "\x1c" * 600])
def test_long_texts_without_letters(spark, library, text):
    got = encode(spark.createDataFrame([(1, text)], "k int, text string"), PATH, decode=True, limit=256).first()
    assert got.ids == library.encode_ordinary(text) and bytes(got.decoded).decode() == text
