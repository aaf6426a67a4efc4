import collections
import unicodedata
import zlib

import numpy as np

from lumenfold.llm.language_id import Filters, learn, ngrams, op10_language, predict
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


def test_ngrams_stay_inside_words():
    h, at, letters = ngrams(["Ab", "", "1 2", "ab", "abc d"])
    counts = (at[:, 1:] - at[:, :-1]).sum(axis=0).tolist()
    assert counts == [3, 0, 0, 3, 6] and letters.tolist() == [2, 0, 0, 2, 4]  # " ab", "ab ", " ab "; and of abc: 3 + 2, of d: 1
    assert h[at[0][0] : at[0][1]].tolist() == h[at[0][3] : at[0][4]].tolist()


def test_many_languages_in_slices():
    grams = np.arange(1, 5 * 70 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    f = Filters.build([f"l{k:02}" for k in range(70)], {f"l{k:02}": grams[5 * k : 5 * k + 5] for k in range(70)}, bits=16)
    assert [m.dtype for m in f.masks] == [np.uint64, np.uint8] and f.shares(["abc"])[0].shape == (1, 70)


def test_odd_rows(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (3, None, "en"), (4, "", None), (5, "123 !", "de"), (6, "ÉÉ 漢字", None), (None, "the dog", "en"), (7, "the " * 300_000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in predict(df.withColumn("score", F.lit("x")), learn(df)).collect()}
    assert {k: got[k].lang_pred for k in (1, 2, 3, 4, 5, 7, None)} == {1: "en", 2: "de", 3: "und", 4: "und", 5: "und", 7: "en", None: "en"}
    assert got[6].lang_pred in ("en", "de") and all(0 <= r.score <= 1 for r in got.values())
    assert learn(df.limit(0)) is None and predict(df.limit(1), None).first().lang_pred == "und"
    assert predict(df.limit(0), learn(df)).collect() == []


def test_query_on_held_out(spark):
    docs = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    out = op10_language(spark, SF).collect()
    assert len(out) == len(docs) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)
    held = [r for r in out if r.held_out]
    assert sum(r.lang_pred == docs[r.doc_id] for r in held) >= 0.98 * len(held)


def own_ngrams(text):
    marks = "".join(c if unicodedata.category(c).startswith("L") else " " for c in text.lower())
    spaced = f" {marks} "
    return [(n, spaced[i : i + n]) for n in (3, 4) for i in range(len(spaced) - n + 1) if " " not in spaced[i + 1 : i + n - 1]]


def test_query_as_sets_say(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    counts, rows = collections.defaultdict(collections.Counter), collections.Counter()
    for r in docs:
        if r.text is not None and r.lang is not None and zlib.crc32(str(r.doc_id).encode()) % 3 != 1:
            counts[r.lang].update(own_ngrams(r.text))
            rows[r.lang] += 1
    rate = {k: {g: n / sum(c.values()) for g, n in c.items()} for k, c in counts.items()}
    holds = {k: {g for g, x in c.items() if all(x >= 0.1 * o.get(g, 0) for o in rate.values())} for k, c in rate.items()}
    got = {r.doc_id: r for r in op10_language(spark, "/root/testdata/sf0.001").collect()}
    for r in docs:
        grams = own_ngrams(r.text or "")
        share = {k: sum(g in s for g in grams) / max(1, len(grams)) for k, s in holds.items()}
        best = max(share.values())
        assert abs(got[r.doc_id].score - best) < 0.02
        if sum(x > best - 0.02 for x in share.values()) == 1:
            assert got[r.doc_id].lang_pred == max(share, key=share.get)
    assert len(got) == len(docs)


def test_wrong_labels_and_many_languages(spark):
    words = {f"l{k:02}": [chr(0x4E00 + 40 * k + j) * 3 for j in range(20)] for k in range(70)}
    rows = [(100 * k + n, " ".join(w[n:] + w[:n]), name) for k, (name, w) in enumerate(words.items()) for n in range(20 if k < 2 else 1)]
    rows.append((9999, " ".join(words["l00"]), "l01"))  # one of 21 rows has a wrong label
    filters = learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    share, _ = filters.shares([" ".join(w) for w in words.values()])
    assert len(filters.masks) == 2 and [filters.languages[b] for b in share.argmax(axis=1)] == list(words)
    assert share[0][filters.languages.index("l01")] < 0.1
