import hashlib
import random
import time

import pytest

from lumenfold.llm.substring_dedup import op5_substring_dedup, without_repeats
from tests.llm import brute
from tests.llm.test_near_dup import thue_morse

SF = "/root/testdata/sf0.001"


def result(spark, rows, **how):
    return without_repeats(spark.createDataFrame(rows, "doc_id long, text string, n_words string"), **how).collect()


def texts(seed):
    r = random.Random(seed)
    base = [" ".join(r.choice("abcdefgh") for _ in range(r.randint(0, 90))) for _ in range(12)]
    mixed = [r.choice(base) + " " + r.choice(base) + "\n" + r.choice(base) for _ in range(50)]
    return ["x y " * 60, "x y " * 45 + "z", "a " * 100, "", "   ", "a", None, *base, *mixed, *[base[3]] * 5]


@pytest.mark.parametrize("how", [{}, {"group_rows": 3, "at_once": 10}, {"prefix": 2}])
def test_as_brute_force(spark, how):
    rows = [(i, t, "x") for i, t in enumerate(texts(5))]
    want = brute.without_repeats([r[:2] for r in rows], 20)
    got = result(spark, rows, window=20, layout=False, **how)
    assert {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in got} == want


def test_layout_stays(spark):
    passage = " ".join(f"p{i}" for i in range(55))
    rows = [(1, f"one\n\n  two {passage}\nthree ", ""), (2, f"four\t\t{passage} \n five\n", ""), (3, "  as  it\n was ", ""), (4, passage, "")]
    got = {r.doc_id: (r.kept_text, r.n_removed) for r in result(spark, rows, window=50)}
    assert got == {1: (rows[0][1], 0), 2: ("four\t\tfive\n", 55), 3: ("  as  it\n was ", 0), 4: ("", 55)}


def test_repeated_and_missing_ids(spark):
    t = " ".join(f"q{i}" for i in range(25))
    got = result(spark, [(7, t, "")] * 3 + [(None, t, ""), (8, t, ""), (7, "other", "")], window=20)
    assert sorted((r.doc_id or 0, r.n_removed) for r in got) == [(0, 25), (7, 0), (7, 0), (7, 0), (7, 0), (8, 25)]


def test_empty_and_long(spark):
    assert result(spark, [], window=20) == []
    long = " ".join(f"w{i}" for i in range(30_000))
    got = result(spark, [(1, long, ""), (2, "new " + long, "")], window=20)
    assert sorted((r.n_words, r.n_removed) for r in got) == [(30_000, 0), (30_001, 30_000)]


def test_query_as_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in op5_substring_dedup(spark, SF).collect()}
    assert got == brute.without_repeats(docs, 20)


def test_words_are_compared_not_their_hashes(spark):
    a, b = thue_morse(1024)
    head = " ".join(f"w{i}" for i in range(19))
    rows = [(1, f"{head} {a}", ""), (2, f"{head} {b}", ""), (3, f"{head} {a}", "")]
    assert {r.doc_id: r.n_removed for r in result(spark, rows, window=20)} == {1: 0, 2: 0, 3: 20}
    rows = [(1, f"{head} {a} tail", ""), (2, f"x {head} {b}", ""), (3, f"x {head} {a}", "")]
    assert {r.doc_id: r.n_removed for r in result(spark, rows, window=20)} == {1: 0, 2: 0, 3: 21}


@pytest.mark.parametrize("group_rows", [2, 5, 40])
def test_longer_prefixes_change_no_result(spark, group_rows):
    r = random.Random(group_rows)
    common = " ".join(f"c{i}" for i in range(40))
    rows = [(i, " ".join([*(f"r{r.random()}" for _ in range(r.randint(0, 6))), *common.split()[r.randint(0, 20) : r.randint(21, 40)], *(r.choice("xyz") for _ in range(30))]), "") for i in range(60)]
    got = result(spark, rows, window=20, layout=False, group_rows=group_rows)
    assert {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in got} == brute.without_repeats([x[:2] for x in rows], 20)


def test_many_rows_without_an_id(spark):
    passage = " ".join(f"p{i}" for i in range(25))
    rows = [(None, f"{passage} {' '.join(f'n{i}-{k}' for k in range(10))}", "") for i in range(10_000)]
    began = time.time()
    got = result(spark, rows, window=20)
    assert sorted(r.n_removed for r in got) == [0] + [25] * 9_999
    assert time.time() - began < 120
