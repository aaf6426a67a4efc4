import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.llm import embedding_dedup as E


def brute(rows, cosine=0.9):
    """(id, links, component, kept) of each row, by all pairs."""
    if not rows:
        return []
    fine = [i is not None and v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for i, v in rows]
    dims = max((len(v) for (_, v), ok in zip(rows, fine, strict=True) if ok), default=1)
    x = np.array([[*v, *[0.0] * (dims - len(v))] if ok else [1.0] * dims for (_, v), ok in zip(rows, fine, strict=True)])
    x = x / np.abs(x).max(1, keepdims=True)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= cosine) & np.outer(fine, fine) & ~np.eye(len(x), dtype=bool)
    at = np.arange(len(rows))
    while True:
        new = np.array([min(at[i], at[near[i]].min(initial=at[i])) for i in range(len(at))])
        if (new == at).all():
            break
        at = new
    least = {}
    for k, (i, _) in zip(at, rows, strict=True):
        least[k] = i if k not in least or least[k] is None else least[k] if i is None else min(i, least[k])
    out = [(i, int(near[k].sum()), least[at[k]], i is None or i == least[at[k]]) for k, (i, _) in enumerate(rows)]
    return sorted(out, key=repr)


def result(df):
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in df.collect()), key=repr)


def unit(x):
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def planted(seed=1, dims=48):
    """Groups around centres, chains of links, copies, and vectors near no other."""
    rng = np.random.default_rng(seed)
    out = list(unit(rng.normal(size=(300, dims))))
    for n, noise in ((120, 0.012), (60, 0.03), (15, 0.04), (2, 0.02)):
        out += list(unit(unit(rng.normal(size=dims)) + noise * rng.normal(size=(n, dims))))
    at = unit(rng.normal(size=dims))
    for _ in range(20):  # a chain: each is linked with its neighbours
        at = unit(at + 0.045 * rng.normal(size=dims))
        out.append(at)
    out += [out[3]] * 90 + [out[310] * 5.0] * 40  # exact copies, and multiples
    rng.shuffle(out)
    return [(int(i), [float(np.float32(y)) for y in v]) for i, v in zip(rng.permutation(len(out)) + 10, out, strict=True)]


SCHEMA = "vec_id long, embedding array<float>"


@pytest.mark.parametrize("hot", [1000, 25])
def test_links_and_components_as_all_pairs(spark, hot):
    """With hot=25 the dense groups go through balls, parts and blocks."""
    rows = planted()
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(0) for c in ("cid", "key", "size", "links", "ball")}).repartition(5)
    assert result(E.near_vectors(df, "embedding", "vec_id", hot=hot)) == brute(rows)


def test_recall_at_the_threshold(spark):
    """Pairs just over a cosine of 0.9, which share fewest bits: at least 0.98 are found, and none below."""
    rng = np.random.default_rng(4)
    a, z = unit(rng.normal(size=(2, 1500, 64)))
    z = unit(z - (z * a).sum(1, keepdims=True) * a)
    c = np.where(np.arange(1500) < 1000, 0.901, 0.899)[:, None]
    rows = [(i, [float(y) for y in v]) for i, v in enumerate(np.vstack([a, c * a + np.sqrt(1 - c * c) * z]))]
    links = {r.vec_id: r.n_links for r in E.near_vectors(spark.createDataFrame(rows, SCHEMA), "embedding", "vec_id").collect()}
    assert sum(links[i] for i in range(1000)) >= 980 and max(links.values()) == 1 and not any(links[i] for i in range(1000, 1500))


def test_odd_vectors(spark, tmp_path):
    v = [0.25, -0.5, 1.0]
    rows = [(1, v), (2, v), (2, v), (3, None), (4, []), (5, [0.0, 0.0, 0.0]), (6, [float("nan"), 1.0, 0.0]), (7, [float("inf"), 1.0, 0.0]), (8, [None, 1.0, 0.0]), (None, v), (None, None)]
    rows += [(-9, [1e30, 1e30, 0.0]), (9, [1e-30, 1e-30, 0.0]), (10, [1.0, 1.0]), (11, [-1.0, -1.0, -0.0]), (3, None)]
    spark.createDataFrame(rows, SCHEMA).withColumn("label", F.lit("x")).withColumn("id", F.lit(5)).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert result(E.op11_near_vectors(spark, str(tmp_path))) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(1, None)]])
def test_few_vectors(spark, rows):
    assert result(E.near_vectors(spark.createDataFrame(rows, SCHEMA), "embedding", "vec_id")) == brute(rows)


def test_codes_are_balanced_and_keys_hold_all_settings():
    rng = np.random.default_rng(2)
    x = unit(rng.normal(size=(500, 16)) + 0.5)
    w, at = E.rotation(x, 40)
    set_ = ((x @ w) > at).mean(0)
    assert w.shape == (16, 40) and (abs(set_ - 0.5) < 0.01).all()
    base, mask, keys = E.codes(x, w, at, 5, 2)
    assert keys.shape == (500, 20) and (np.bitwise_count(mask) == 2).all()
    for t in range(5):
        own = keys[:, 4 * t : 4 * t + 4]
        assert (own >> 8 == t).all() and ((own & 255) & ~mask[:, [t]] == (base & ~mask)[:, [t]]).all() and all(len(set(r)) == 4 for r in own[:50])


def test_pairs_and_labels():
    got = [p for i, j in E._pairs(np.array([3, 3, 3, 4, 6, 6])) for p in zip(i.tolist(), j.tolist(), strict=True)]
    assert got == [(0, 1), (0, 2), (1, 2), (4, 5)]
    assert E.least_labels(6, np.array([5, 3, 1]), np.array([3, 1, 2])).tolist() == [0, 1, 1, 1, 4, 1]
