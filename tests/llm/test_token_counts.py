import random

import pytest
from tokenizers import Tokenizer

import public_tokenizers
from lumenfold.llm.token_counts import count_spliced, op8_token_counts, with_token_counts

SF, PATH = "/root/testdata/sf0.001", public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_splicing_changes_nothing(library):
    r = random.Random(1)
    bits = ["word", " ", "  ", "\n", "<|endoftext|>", "é", "12", "!", " a", "'s", "x", " ", "\x1c"]
    for n in range(80):
        s = "".join(r.choice(bits) for _ in range(r.randint(50, 700))) if n % 5 else "ab" * r.randint(50, 900)
        for chunk, overlap in ((40, 8), (100, 3), (64, 64)):
            assert count_spliced(library, s, chunk, overlap) == len(library.encode(s, add_special_tokens=False))


def test_odd_rows(spark, library):
    texts = [None, "", "<|endoftext|>", "a <|endoftext|> b", "y" * 3000, "word " * 4000]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "k int, text string, n_tokens string")
    got = {r.k: r.n_tokens for r in with_token_counts(df, PATH, chunk=500, overlap=20).collect()}
    assert got == {i: len(library.encode(t or "", add_special_tokens=False)) for i, t in enumerate(texts)}
    assert with_token_counts(df.limit(0), PATH).collect() == []


def test_query(spark, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in op8_token_counts(spark, SF).collect():
        n = len(library.encode(docs[r.doc_id], add_special_tokens=False))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(docs[r.doc_id].encode()), n, n > 512)
