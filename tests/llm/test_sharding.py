import math

import xxhash
from pyspark.sql import functions as F

from lumenfold.llm.sharding import even_tree, op1_hash_tree, shard_of, with_shards, with_slots

SF = "/root/testdata/sf0.001"


def brute_shard(key: int, tree) -> int:
    """The live shard of the least loss. Spark's xxhash64 chains: the hash of the key is the seed for the first number of the path."""

    def draw(path, w):
        seed = xxhash.xxh64_intdigest(key.to_bytes(8, "little", signed=True), seed=42)
        for i in path:
            seed = xxhash.xxh64_intdigest(i.to_bytes(4, "little", signed=True), seed=seed)
        return -math.log(((seed >> 12) + 0.5) / 2**52) / w if w > 0 else math.inf

    least = []
    for r, region in enumerate(tree):
        weights = [sum(w for _, w in rack) for rack in region]
        racks = [draw((r, k), w) for k, w in enumerate(weights)]
        for k, rack in enumerate(region):
            places = [draw((r, k, i), w) for i, (_, w) in enumerate(rack)]
            least += [(draw((r,), sum(weights)) + (racks[k] - min(racks)) + (places[i] - min(places)), s) for i, (s, w) in enumerate(rack) if w > 0 and s is not None]
    return min(least)[1]


def test_shards_as_brute_force_and_in_proportion(spark):
    tree = [[[(0, 1.0), (1, 3.0)]], [[(2, 0.0)], [(3, 4.0)]]]
    rows = with_shards(spark.range(4000), "id", tree).collect()
    assert all(r.shard == brute_shard(r.id, tree) for r in rows[:300])
    n = [sum(r.shard == s for r in rows) for s in range(4)]
    assert n[2] == 0 and abs(n[0] - 500) < 90 and abs(n[1] - 1500) < 140 and abs(n[3] - 2000) < 150


def test_a_new_or_heavier_shard_only_takes(spark):
    key = F.col("id")
    for n in (1, 7, 8, 40):
        moved = spark.range(3000).where(shard_of(key, even_tree(n)) != shard_of(key, even_tree(n + 1))).select(shard_of(key, even_tree(n + 1)).alias("to")).distinct().collect()
        assert {r.to for r in moved} <= {n}
    light, heavy = ([[[(0, 1.0), (1, 1.0), (x, 1.0)], [(2, 1.0)]]] for x in (None, 1))  # in a place that was planned
    assert {r.to for r in spark.range(2000).where(shard_of(key, light) != shard_of(key, heavy)).select(shard_of(key, heavy).alias("to")).distinct().collect()} == {1}


def test_a_changed_weight_moves_rows_of_its_subtrees_alone(spark):
    key = F.col("id")
    trees = [[[[(0, 1.0), (1, w)], [(2, 1.0)]], [[(3, 2.0)], [(4, 1.0)]]] for w in (1.0, 2.0)]
    moved = {(r.a, r.b) for r in spark.range(4000).select(*(shard_of(key, t).alias(c) for t, c in zip(trees, "ab", strict=True))).where("a != b").collect()}
    # Into the first region, and there into the first rack; never from one place outside to another.
    assert moved and all(b <= 2 for a, b in moved) and all(a > 2 or b < 2 for a, b in moved) and (1, 0) not in moved


def test_the_shape_of_the_tree_matters(spark):
    key, flat = F.col("id"), [[[(s, 1.0) for s in range(40)]]]
    assert spark.range(2000).where(shard_of(key, flat) != shard_of(key, even_tree(40))).count() > 1500


def test_ten_thousand_shards(spark):
    tree = even_tree(10_000, 20, 20)
    out = spark.range(50_000).select("id", shard_of(F.col("id"), tree).alias("shard")).collect()
    assert len({r.shard for r in out}) > 9_800 and all(r.shard == brute_shard(r.id, tree) for r in out[:5])


def test_existing_columns_are_replaced(spark):
    df = spark.createDataFrame([(i, "x", "y") for i in range(50)], "doc_id long, shard string, slot string")
    out = with_slots(with_shards(df, "doc_id", even_tree(2)), "shard", [F.col("doc_id")], parts=4)
    assert sorted(out.columns) == ["doc_id", "shard", "slot"] and sorted(r.slot for r in out.where("shard = 0").collect()) == list(range(out.where("shard = 0").count()))


def test_slots_are_gapless_with_repeats_and_nulls(spark):
    rows = [(None, "a")] * 40 + [(5, "b")] * 300 + [(i, "c") for i in range(100)]
    df = with_shards(spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.monotonically_increasing_id()), "doc_id", even_tree(3))
    out = with_slots(df, "shard", [F.col("doc_id"), F.col("row")], parts=8).collect()
    assert len(out) == 440 and len({r.shard for r in out if r.doc_id == 5}) == 1
    for s in range(3):
        got = sorted(r.slot for r in out if r.shard == s)
        assert got == list(range(len(got)))
    assert with_slots(df.limit(0), "shard", [F.col("doc_id")]).count() == 0


def test_query(spark):
    out = op1_hash_tree(spark, SF).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    import zlib

    assert len(out) == len(docs)
    for r in out:
        b = docs[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law) == (len(b) + 16, zlib.crc32(b), "key")
        assert r.shard == brute_shard(r.doc_id, even_tree(40)) and r.grown_shard in (r.shard, 40)


def test_no_python_in_the_plan(spark):
    assert "Python" not in op1_hash_tree(spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_query_on_odd_rows(spark, tmp_path):
    """Null and empty texts, negative, repeated and null ids, columns of clashing names; then no rows at all."""
    import zlib

    rows = [(-5, None), (-5, "é"), (0, ""), (None, "x"), (None, None), *((k, "same") for k in range(-200, 200))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(-1) for c in ("shard", "slot", "size", "law", "grown_shard")})
    df.write.parquet(f"{tmp_path}/a/documents.parquet")
    got = op1_hash_tree(spark, f"{tmp_path}/a").collect()
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in got if r.doc_id is not None) == sorted((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows if i is not None)
    assert len(got) == len(rows) and all(0 <= r.shard < 40 and r.law == "key" and r.grown_shard in (r.shard, 40) for r in got)
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    places = {}
    for r in got:
        assert places.setdefault(r.doc_id, (r.shard, r.grown_shard)) == (r.shard, r.grown_shard)
    df.limit(0).write.parquet(f"{tmp_path}/b/documents.parquet")
    assert op1_hash_tree(spark, f"{tmp_path}/b").collect() == []
