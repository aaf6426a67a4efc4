"""Hierarchical weighted hash tree: regions hold racks, racks hold shards.

Each node draws for a key: an exponential number with the node's planned weight as its rate, from a hash of the key and of the node's path. The least
draw among siblings wins, so that each child is chosen in proportion to its weight, and a key descends by one choice a
level: region, rack, shard. A node's loss is how much its draw exceeds its best sibling's; a shard's is the sum along its path.

A place that is planned but empty (shard None) keeps its weight in its rack and region, so that filling it changes no draw: the
key then belongs to the live shard of the least loss, and a new shard takes rows only into itself. Only subtrees with
empty places need these sums; elsewhere the descent decides. Where a planned weight itself changes, or a rack is added to a region, the draws
of that rack and region change, and rows move into, out of and within these subtrees only. A new region takes rows only
into itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.llm._shared import saved

Rack = list[tuple[int | None, float]]
Tree = list[list[Rack]]


def even_tree(shards: int, shards_per_rack: int = 4, racks_per_region: int = 2) -> Tree:
    """Shards 0.. of weight 1 in racks and regions, filled in order; the last region's other places are planned."""
    places = shards_per_rack * racks_per_region
    rack = lambda a: [(s if s < shards else None, 1.0) for s in range(a, a + shards_per_rack)]
    return [[rack(a + k * shards_per_rack) for k in range(racks_per_region)] for a in range(0, shards, places)]


def _list(values: list, kind: str) -> Column:
    """A constant array."""
    return F.expr(f"array({', '.join(f'cast({v!r} as {kind})' for v in values)})" if values else f"cast(array() as array<{kind}>)")


def _draw(key: Column, path: list[Column], weight: Column) -> Column:
    """-ln(u) / weight; u is in (0, 1), from 52 bits of a hash of the key and the path. Without weight it never wins."""
    bits = F.shiftrightunsigned(F.xxhash64(key, *path), 12)
    return F.when(weight > 0, -F.log((bits.cast("double") + 0.5) / float(1 << 52)) / weight).otherwise(F.lit(float("inf")))


def _draws(weights: Column, draw: Callable[[Column, Column], Column]) -> Column:
    """An array of (draw, child) structs."""
    return F.transform(weights, lambda w, i: F.struct(draw(i, w).alias("draw"), i.alias("child")))


def _losses(draws: Column) -> Column:
    """The draws of siblings above the least of them."""
    return F.transform(draws, lambda d: F.struct((d["draw"] - F.array_min(draws)["draw"]).alias("draw"), d["child"].alias("child")))


def _one_of(children: list[int]) -> Callable[[Column], Column]:
    return lambda d: F.array_contains(_list(children, "int"), d["child"])


def shard_of(key: Column, tree: Tree) -> Column:
    """The shard of a key. A null key is a key like any other. Shards of weight 0 get no rows; equal draws go to the first place.

    The expression has a constant part for each region and one for each place of a region that isn't full; a key looks at its
    region's racks and its rack's shards alone.
    """
    live = lambda rack: [s for s, w in rack if w > 0 and s is not None]
    there = [any(map(live, region)) for region in tree]
    if not any(there):
        raise ValueError("the tree has no shard with a weight")
    full = lambda rack: all(s is not None for s, w in rack if w > 0)
    rack_weight = lambda rack: float(sum(w for _, w in rack))

    def racks(r: Column, weights: Column) -> Column:
        return _draws(weights, lambda k, w: _draw(key, [r, k], w))

    def shards(r: Column, k: Column, weights: Column) -> Column:
        return _draws(weights, lambda s, w: _draw(key, [r, k, s], w))

    scores = []  # (loss, region, rack, place) of each region; rack and place only where the region isn't full
    none = F.lit(-1)
    weights = _list([sum(map(rack_weight, region)) if some else 0.0 for region, some in zip(tree, there, strict=True)], "double")
    top = _draws(weights, lambda r, w: _draw(key, [r], w))
    whole = [some and all(map(full, region)) for region, some in zip(tree, there, strict=True)]
    if any(whole):
        best = F.array_min(F.filter(top, lambda d: F.element_at(_list(whole, "boolean"), d["child"] + 1)))
        scores.append(F.struct(best["draw"].alias("draw"), best["child"].alias("region"), none.alias("rack"), none.alias("place")))
    for r, region in enumerate(tree):
        if whole[r] or not there[r]:
            continue
        above = _losses(racks(F.lit(r), _list(list(map(rack_weight, region)), "double")))
        for k, rack in enumerate(region):
            open_ = [i for i, (s, w) in enumerate(rack) if s is not None and w > 0]
            if open_:
                below = _losses(shards(F.lit(r), F.lit(k), _list([w for _, w in rack], "double")))
                # A full rack's best place has no loss; else the least loss among its live places.
                least = F.array_min(F.filter(below, _one_of(open_)))
                total = F.element_at(top, r + 1)["draw"] + F.element_at(above, k + 1)["draw"] + least["draw"]
                scores.append(F.struct(total.alias("draw"), F.lit(r).alias("region"), F.lit(k).alias("rack"), least["child"].alias("place")))
    won = scores[0] if len(scores) == 1 else F.least(*scores)
    numbers = lambda rack: "array(" + ", ".join(str(s) if s is not None else "cast(null as int)" for s, _ in rack) + ")"
    ids = F.expr("array(" + ", ".join("array(" + ", ".join(map(numbers, region)) + ")" for region in tree) + ")")
    inner = F.expr("array(" + ", ".join("array(" + ", ".join(f"array({', '.join(f'{float(w)!r}D' for _, w in rack)})" for rack in region) + ")" for region in tree) + ")")

    def descend(x: Column) -> Column:
        """From a full region: the rack of the least draw, then its place."""
        mine = F.element_at(inner, x["region"] + 1)
        sums = F.transform(mine, lambda rack: F.aggregate(rack, F.lit(0.0), lambda a, w: a + w))
        rack = F.array_min(racks(x["region"], sums))["child"]
        rack = F.when(x["rack"] >= 0, x["rack"]).otherwise(rack)
        return _with(rack, lambda k: F.struct(x["region"].alias("region"), k.alias("rack"), F.when(x["place"] >= 0, x["place"]).otherwise(F.array_min(shards(x["region"], k, F.element_at(mine, k + 1)))["child"]).alias("place")))

    return _with(won, lambda x: _with(descend(x), lambda y: F.element_at(F.element_at(F.element_at(ids, y["region"] + 1), y["rack"] + 1), y["place"] + 1)))


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), which computes the value once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def with_shards(df: DataFrame, key: str, tree: Tree, shard: str = "shard") -> DataFrame:
    """df with the shard of each row, in place of a column of that name; needs no shuffle."""
    return df.withColumn(shard, shard_of(F.col(key), tree))


def with_slots(df: DataFrame, shard: str, spread: list[Column], slot: str = "slot", parts: int = 256) -> DataFrame:
    """Numbers the rows of each shard from 0 without a gap, in place of a column of the slot's name.

    Rows are dealt into parts per shard by a hash of spread, counted, and numbered within their part,
    after the rows of the parts before; no task numbers a whole shard. The counts that are joined are
    at most shards x parts rows. The rows are written first, so that both see the same parts. Repeated rows get any of the slots of their part; spread should
    hold what keeps equal keys apart.
    """
    part = saved(df.withColumn("_lf_part", F.pmod(F.xxhash64(*spread), F.lit(parts)).cast("int")), "parts")
    counts = part.groupBy(F.col(shard).alias("_lf_s"), F.col("_lf_part").alias("_lf_p")).agg(F.count("*").alias("_lf_n"))
    # One row per shard, of at most `parts` counts.
    lists = counts.groupBy("_lf_s").agg(F.map_from_entries(F.collect_list(F.struct("_lf_p", "_lf_n"))).alias("_lf_m"))
    # F.sequence gives the parts in order, so the running sum is over all parts before.
    grow = F.aggregate(
        F.sequence(F.lit(0), F.lit(parts - 1)),
        F.struct(F.lit(0).cast("long").alias("total"), F.array().cast("array<bigint>").alias("before")),
        lambda acc, p: F.struct((acc["total"] + F.coalesce(F.try_element_at(F.col("_lf_m"), p), F.lit(0).cast("long"))).alias("total"), F.concat(acc["before"], F.array(acc["total"])).alias("before")),
        lambda acc: acc["before"],
    )
    before = lists.select("_lf_s", F.posexplode(grow).alias("_lf_p", "_lf_before"))
    rank = F.row_number().over(Window.partitionBy(shard, "_lf_part").orderBy(*spread))
    ranked = part.withColumn("_lf_rank", rank)
    joined = ranked.join(before, (F.col(shard) == F.col("_lf_s")) & (F.col("_lf_part") == F.col("_lf_p")))
    return joined.withColumn(slot, (F.col("_lf_before") + F.col("_lf_rank") - 1).cast("long")).drop("_lf_part", "_lf_s", "_lf_p", "_lf_before", "_lf_rank")


def op1_hash_tree(spark, sf_dir: str) -> DataFrame:
    """All documents in shards 0-39 under the law "key", and where a 41st shard would move them.

    A null text has size 16 and the CRC of no bytes. The slot's part depends on the doc_id and, so that
    a repeated doc_id is dealt out, on the row's place in the input.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(F.col("doc_id"), even_tree(40)).cast("int").alias("shard"),
        shard_of(F.col("doc_id"), even_tree(41)).cast("int").alias("grown_shard"),
        F.monotonically_increasing_id().alias("_lf_row"),
    )
    out = with_slots(rows, "shard", [F.col("doc_id"), F.col("_lf_row")])
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
