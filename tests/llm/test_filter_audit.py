import itertools
import random

import pytest
from pyspark.sql import functions as F

from lumenfold.llm.filter_audit import FILTERS, _words, op13_filter_audit, text_failures
from tests.llm.brute import words


def brute(docs, labels):
    """Every order by plain removal of rows."""
    firsts = {}
    for i, t, _ in docs:
        if i is not None:
            firsts[t or ""] = min(i, firsts.get(t or "", i))
    rows = []
    for i, t, lang in docs:
        w, s = words(t), t or ""
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in s) > 3 * len(s), "D": any(c in "#$%&*|" for c in s), "E": i is not None and i > firsts[s]}
        got = [x for x in labels if x[0] == i and i is not None]
        rows.append((lang or "", fails, any(q == 1 for _, q, _ in got), any(x == 1 for _, _, x in got)))
    out, shapley = {}, {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        for order in itertools.permutations(FILTERS):
            left = mine
            for k, f in enumerate(order):
                gone = [r for r in left if r[1][f]]
                left = [r for r in left if not r[1][f]]
                shapley[part, f] = shapley.get((part, f), 0) + len(gone)
                out[part, "".join(order), k + 1] = (len(left), len(gone), sum(r[1][f] for r in mine) - len(gone), sum([x for x in FILTERS if r[1][x]] == [f] for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone))
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def run(spark, tmp_path, docs, labels):
    spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumns({"part": F.lit("clash"), "failed": F.lit(-1), "digest": F.lit("x")}).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("part", F.lit(9)).write.parquet(f"{tmp_path}/labels.parquet")
    got = op13_filter_audit(spark, str(tmp_path)).collect()
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in got}, len(got)


def test_equals_plain_removal_over_odd_rows(spark, tmp_path):
    rng = random.Random(3)
    texts = [None, "", "a b", "A B C", "x#y", " ".join(f"w{i}" for i in range(300)), "same " * 250, "GOOD " * 10, " wide\u0085gaps stay\x1cone", "long " * 400_000]
    docs = [(i, rng.choice(texts), rng.choice(["en", "de", None, ""])) for i in range(120)]
    docs += [(7, "a b", "en"), (7, "a b", "en"), (None, "a b", "de"), (None, None, None), (-5, "a b", "en")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 120, 2)] + [(4, 1, 1), (None, 1, 1), (9999, 1, 1)]
    got, n = run(spark, tmp_path, docs, labels)
    want = brute(docs, labels)
    assert got == want and n == len(want) == 3 * 600


def test_no_documents(spark, tmp_path):
    assert run(spark, tmp_path, [], [(1, 1, 1)]) == ({}, 0)


@pytest.mark.parametrize("piece", [1, 3, 64])
def test_words_of_pieces(monkeypatch, piece):
    monkeypatch.setattr("lumenfold.llm.filter_audit.PIECE", piece)
    for t in ["", " ", "ab", " ab  cd ab ", "x" * 200, "ab\x0bcd\x0cab\x85\x1c ab", " a" * 50]:
        w = words(t)
        assert _words(t.encode()) == (len(w), len(set(w)))


def test_failures_of_texts():
    assert text_failures(None) == 1 and text_failures("É" * 50) == 1 and text_failures("A" + "b" * 32) == 1 | 4 and text_failures("A" + "b" * 33) == 1
    assert text_failures("a " * 200) == 2 and text_failures("a|") == 9
