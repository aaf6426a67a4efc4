"""Indexes for names that are alike and texts that hold others, against all pairs."""

import random

import pytest

from lumenfold.operators import match as J
from lumenfold.operators.similar import alike
from lumenfold.operators.substrings import first_inside


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(new[-1] + 1, row[j + 1] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


def similarity(a, b):
    return 1.0 if a == b else 1 - distance(a, b) / max(len(a), len(b)) if a and b else 0.0


def confidence(text, name):
    if text == name:
        return 1.0
    s = similarity(text, name)
    return 0.75 if (name in text or text in name) and s < 0.75 else s


def words(rng, n, letters="abcd", most=9):
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(most + 1))) for _ in range(n)]


def edited(rng, w):
    for _ in range(rng.randrange(4)):
        i = rng.randrange(len(w) + 1)
        w = rng.choice([w[:i] + rng.choice("abcd") + w[i:], w[:i] + w[i + 1 :], w[:i] + rng.choice("abcd") + w[i + 1 :]])
    return w


@pytest.mark.parametrize("seed,letters", [(1, "abcd"), (2, "ab"), (3, "abcdefghij")])
def test_best_blocks_as_all_pairs(spark, seed, letters):
    rng = random.Random(seed)
    fields, blocks = [], []
    for doc in "xyz":
        texts = words(rng, 40, letters) + ["aaaaaaaaaaa", "a", ""]
        names = words(rng, 15, letters) + [edited(rng, w) for w in rng.sample(texts, 20)] + ["aaaaaaaabb", "b", "", texts[0]]
        blocks += [(doc, i, t) for i, t in enumerate(texts + texts[:5])]
        fields += [(doc, i, t) for i, t in enumerate(names)]
    got = {(r.doc_id, r.field_idx): (r.confidence, r.block_idx) for r in J.best_blocks(spark.createDataFrame(fields, "doc_id string, field_idx int, norm string"), spark.createDataFrame(blocks, "doc_id string, block_idx int, norm string")).collect()}
    want = {}
    for doc, i, name in fields:
        c, first = max((confidence(t, name), -k) for d, k, t in blocks if d == doc)
        if c > 0:
            want[doc, i] = (c, -first)
    assert {k: v[1] for k, v in got.items()} == {k: v[1] for k, v in want.items()} and all(abs(got[k][0] - want[k][0]) < 1e-12 for k in want)


def test_index_finds_all_that_are_alike_among_few_candidates(spark):
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(4, 12))) for _ in range(300)]
    texts = list({" ".join(rng.sample(vocabulary, 2)) for _ in range(400)})
    names = list({edited(rng, t) for t in rng.sample(texts, 150)})
    df = lambda x: spark.createDataFrame([("d", w) for w in x], "doc_id string, norm string")
    got = {(r.norm, r.text) for r in alike(df(names), df(texts)).collect()}
    want = {(n, t) for n in names for t in texts if similarity(n, t) >= 0.75 or n in t or t in n}
    assert want and want <= got and len(got) < len(names) * len(texts) / 50


def test_first_inside_as_all_pairs(spark):
    rng = random.Random(5)
    patterns = [(d, i, p) for d in "xy" for i, p in enumerate(words(rng, 12, "ab", 4)[1:] + ["ab", "abab", None])] + [("y", 40, "")]
    patterns = [p for p in patterns if p[2] != "" or p[1] == 40]
    texts = [(d, i + 1000 * (d == "y") + 5000 * (d == "z"), t) for d in "xyz" for i, t in enumerate([*words(rng, 150, "abc", 9), None, "á€😀ab"])]
    want = {}
    for d, i, t in texts:
        hits = [(o, p) for e, o, p in patterns if e == d and t is not None and p is not None and p in t]
        if hits:
            want[i] = min(hits)[1]
    for part_rows in (1000, 20):
        got = first_inside(spark.createDataFrame(texts, "doc_id string, row long, text string").repartition(3), spark.createDataFrame(patterns, "doc_id string, ord long, path string"), part_rows)
        assert {r.row: r.pattern for r in got.collect()} == want
