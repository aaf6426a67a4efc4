import random
import time

import numpy as np
import pyarrow as pa
import pytest

from lumenfold.llm import near_dup
from lumenfold.llm.near_dup import _agreeing, _confirmed, _near_confirmed, _shingle_tokens, _shingles, in_blocks, near_duplicates, op2_near_dup, threshold
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def result(spark, rows, **how):
    return near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, n_shingles string"), **how).collect()


@pytest.mark.parametrize("how", [{"k": 3, "num": 85}, {"k": 5, "num": 80}, {"k": 3, "num": 85, "list_rows": 4, "family_bytes": 300}, {"k": 3, "num": 85, "list_rows": 4, "family_bytes": 300, "most_parts": 1}])
def test_as_brute_force(spark, how):
    rows = [(i, t, "x") for i, t in enumerate(brute.copies(3, 120, 60, 3))] + [(900 + i, t, None) for i, t in enumerate(["", "  ", "a", "A", "a b", None, "a  B\n"])]
    want = brute.components([r[:2] for r in rows], how["k"], how["num"], 100)
    got = result(spark, rows, **how)
    assert {r.doc_id: r.component_id for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert {r.doc_id: r.n_shingles for r in got} == {i: len(brute.shingles(t, how["k"])) for i, t, _ in rows}


def test_repeated_and_missing_ids(spark):
    a, b = "one two three four five six seven", "eight nine ten eleven twelve thirteen"
    got = result(spark, [(1, a, "")] * 3 + [(1, b, ""), (2, b, ""), (3, a, ""), (None, a, ""), (None, None, "")], k=3)
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got if r.doc_id) == [(1, 1, True)] * 4 + [(2, 1, False), (3, 1, False)]
    assert all(r.kept for r in got if r.doc_id is None)


def test_empty(spark):
    assert result(spark, []) == []


def test_query_as_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = brute.components([(r.doc_id, r.text) for r in docs], 3, 85, 100)
    assert {r.doc_id: r.component_id for r in op2_near_dup(spark, SF).collect()} == want


def test_threshold_is_the_tail():
    from math import comb

    t = threshold(85, 100, 64, 1e-9)
    tail = lambda n: sum(comb(64, k) * 0.85**k * 0.15 ** (64 - k) for k in range(n))
    assert tail(t) <= 1e-9 < tail(t + 1)


def thue_morse(n):
    """Two words of n letters that differ everywhere, which polynomial hashes modulo a power of two mix up."""
    a = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    return a, a.translate(str.maketrans("ab", "ba"))


def test_long_words_that_differ_are_not_linked(spark):
    for n in (1024, 4096):
        a, b = thue_morse(n)
        rows = [(1, a, ""), (2, b, ""), (3, f"one two {a}", ""), (4, f"one two {b}", "")]
        assert all(r.kept for r in result(spark, rows, k=3, num=85))


@pytest.mark.parametrize("members", [4_000, 16_000])
def test_families_without_links_take_about_linear_time(members):
    r = random.Random(5)
    shared = [f"s{i}" for i in range(9)]  # 7 of 10 shingles are the same in all
    texts = [" ".join([*shared, *(f"u{i}-{r.random()}" for _ in range(3))]) for i in range(members)]
    table = pa.table({"family": np.zeros(members, np.int64), "block": np.zeros(members, np.int64), "id": np.arange(members), "text": texts, "near": np.zeros(members, bool)})
    began = time.process_time()
    assert _confirmed(3, 85, 100)(table) is None
    assert time.process_time() - began < members * 6e-4


def test_members_of_large_groups_meet_under_rare_tokens(spark, monkeypatch):
    r = random.Random(8)
    rows, words = [], [f"w{i}" for i in range(60)]
    for i in range(150):  # each like the one before, but soon unlike the first
        words[r.randrange(60)] = f"n{i}"
        rows.append((i, " ".join(words), "") if i % 25 else (i, " ".join(words[:30] + [f"v{i}-{j}" for j in range(30)]), ""))
    rows += [(200 + i, rows[i][1] + " and more", "") for i in range(0, 150, 7)] + [(1, rows[90][1], ""), (1, rows[91][1] + " x", "")]
    calls, under = [], near_dup._under_tokens
    monkeypatch.setattr(near_dup, "_under_tokens", lambda told, keys, tokens: calls.append(keys) or under(told, keys, tokens))
    want = brute.components([x[:2] for x in rows], 3, 85, 100)
    got = result(spark, rows, k=3, num=85, list_rows=6, family_bytes=2000, most_parts=1)
    assert {x.doc_id: x.component_id for x in got} == want and 10 < len(set(want.values())) < 150
    assert sorted(calls) == [["family"], ["key"]]


def test_large_groups_without_links_grow_linearly(spark):
    shared = [f"s{i}" for i in range(9)]  # 7 of 10 shingles are the same in all
    counts = []
    for members in (100, 400):
        rows = [(0, i, " ".join([*shared, *(f"u{i}-{j}" for j in range(3))])) for i in range(members)]
        rows += [(0, members + i, " ".join([*shared, f"p{i // 2}", f"q{i // 2}", f"r{i}"])) for i in range(members // 10)]  # pairs that meet
        df = spark.createDataFrame(rows, "family long, id long, text string")
        blocks, edges = in_blocks(df, ["family"], "text", "octet_length(text)", 400, _near_confirmed(3, 85, 100), _shingle_tokens(3, 85, 100), 1)
        assert edges.count() == 0
        counts.append(blocks.count())
    assert 0 < counts[0] and counts[1] <= 4 * counts[0]


def test_lists_are_merged_as_counted_whole():
    r = np.random.default_rng(3)
    base = r.integers(0, 256, (6, 64), dtype=np.uint8)
    sig = base[r.integers(0, 6, 400)]
    change = r.random(sig.shape) < r.choice([0.05, 0.3, 0.6], 400)[:, None]
    sig = np.where(change, r.integers(0, 256, sig.shape, dtype=np.uint8), sig)
    n = r.integers(90, 110, 400)
    table = pa.table({"key": np.zeros(400, np.int64), "block": np.zeros(400, np.int64), "id": np.arange(400), "n": n, "sig": [x.tobytes() for x in sig], "near": np.arange(400) < 3})

    def components(edges):
        parent = list(range(400))

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in [(0, 1), (0, 2), *edges]:  # the first three are known to be near each other
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
        return [find(x) for x in range(400)]

    def edges(direct):
        out = _agreeing(36, 64, 85, 100, direct)(table)
        return zip(out["a"].to_pylist(), out["b"].to_pylist(), strict=True)

    want = [(i, j) for i in range(400) for j in range(i) if (sig[i] == sig[j]).sum() >= 36 and 100 * min(n[i], n[j]) >= 85 * max(n[i], n[j])]
    assert components(edges(1000)) == components(edges(2)) == components(want)


def test_shingles_are_words_not_hashes():
    number, at, top = _shingles(pa.array(["a b c d", "A  b\nc", "x", None, "b c d"]), 3)
    sets = [set(number[a:b].tolist()) for a, b in zip(at[:-1], at[1:], strict=True)]
    assert list(map(len, sets)) == [2, 1, 0, 0, 1] and sets[1] < sets[0] and sets[4] < sets[0] and sets[1] != sets[4] and top == 2
