import random

import corpus_pipeline as P
from tests.llm import brute

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], COLUMNS)


def test_stages_keep_the_columns_and_chain(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    for _, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs = P.saved(docs, "test")
        now = {r.doc_id for r in docs.select("doc_id").collect()}
        assert now <= ids and docs.count() == len(now)
        ids = now
    out = P.run(spark, SF).collect()
    assert {r.doc_id for r in out} == ids and all(r.round_trip and r.n_tokens == len(r.ids) for r in out)


def test_near_dup_stage_as_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute.components([(r.doc_id, r.text) for r in docs.collect()], 5, 80, 100)
    assert {r.doc_id for r in P.near_dup(spark, docs, SF).collect()} == {i for i, c in want.items() if i == c}


def test_near_dup_stage_decides_by_row(spark):
    a, b, c = (" ".join(f"{p}{i}" for i in range(40)) for p in "abc")
    rows = [(0, a), (1, b), (1, a), (1, b), (2, c), (2, f"{b} end"), (3, None), (3, None), (3, ""), (None, a), (None, a)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], COLUMNS)
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "", r[1] is None)
    want = [(0, a), (1, b), (2, c), (3, None), (3, ""), (None, a), (None, a)]
    out = P.near_dup(spark, docs, SF)
    assert sorted([(r.doc_id, r.text) for r in out.collect()], key=key) == sorted(want, key=key) and out.columns == docs.columns


def test_substring_stage_cuts_long_passages_only(spark):
    long, short = (" ".join(f"{p}{i}" for i in range(n)) for p, n in (("p", 52), ("q", 30)))
    docs = frame(spark, [f"a  {long} b", f"c {long}\nd", f"e {short}", f"f {short}", None, ""])
    got = {r.doc_id: (r.text, r.n_chars) for r in P.substring_dedup(spark, docs, SF).collect()}
    assert got[1] == ("c d", 3) and got[0][0] == f"a  {long} b" and got[3][0] == f"f {short}" and got[4][0] is None and got[5] == ("", 0)


def test_language_and_benchmark_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert P.language_id(spark, docs, SF).count() >= 0.99 * docs.count()
    items = [brute.words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    holds = lambda w: any(w[k : k + len(q)] == q for q in items for k in range(len(w) - len(q) + 1))
    want = {r.doc_id for r in docs.collect() if not holds(brute.words(r.text))}
    assert {r.doc_id for r in P.decontaminate(spark, docs, SF).collect()} == want


def test_languages_of_many_ngrams_stay(spark):
    r = random.Random(4)
    words = ["".join(chr(0x4E00 + r.randrange(8000)) for _ in range(4)) for _ in range(15_000)]
    many = [" ".join(r.choices(words, k=200)) for _ in range(300)]
    few = [" ".join(r.choices(["the", "and", "of", "house", "tree", "river"], k=50)) for _ in range(300)]
    docs = frame(spark, many + few)
    docs = docs.withColumn("lang", P.F.when(P.F.col("doc_id") < 300, "zh").otherwise("en"))
    junk = spark.createDataFrame([(1000, "xq zvk jjw qqz wxk " * 20, None, "s", 1)], COLUMNS)
    got = {x.doc_id for x in P.language_id(spark, docs.union(junk), SF).select("doc_id").collect()}
    assert got == set(range(600))


def test_empty_and_null(spark):
    docs = spark.createDataFrame([(None, None, None, None, None), (1, "", None, None, 0), (2, "the and of", "en", "s", 10), (None, "the and of", "en", "s", 10)], COLUMNS)
    for df in (docs, docs.limit(0)):
        for _, stage in P.STAGES:
            df = P.saved(stage(spark, df, SF), "test")
        assert df.count() <= 4
