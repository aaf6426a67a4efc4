"""Near-duplicate vectors: a learned rotation to balanced binary codes, multi-index Hamming tables, reranking by the original vectors."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm._shared import SALTS, components, in_groups, saved
from lumenfold.llm._text import lean

SAMPLE, TABLES, FLIPS, COSINE, HOT = 4096, 6, 3, 0.9, 1000
AT_ONCE, PAIRS = 4096, 1 << 18
#: Above these angles' bounds, rounding decides nothing.
SLACK = 1e-6


def rotation(x: np.ndarray, bits: int, rounds: int = 30, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(projection, thresholds) of a code of so many bits, by iterative quantisation of a sample of unit vectors.

    PCA and a rotation, in turn fitted to the signs and the signs to it, give as many bits as dimensions at most; further ones come from
    further rotations, each begun at another random one. Thresholds are medians, so that a bit is set in half of the sample.
    """
    rng, mean, parts, dims = np.random.default_rng(seed), x.mean(0), [], x.shape[1]
    _, _, axes = np.linalg.svd(x - mean, full_matrices=True)
    while (left := bits - sum(p.shape[1] for p in parts)) > 0:
        v = (x - mean) @ axes.T
        r = np.linalg.qr(rng.normal(size=(dims, dims)))[0]
        for _ in range(rounds):
            a, _, b = np.linalg.svd(np.where(v @ r > 0, 1.0, -1.0).T @ v)
            r = (a @ b).T
        parts.append((axes.T @ r)[:, :left])
    w = np.hstack(parts)
    return w, np.median(x @ w, axis=0)


def _stacked(column: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    """Lists as rows of doubles; shorter ones are padded with zeros."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = a.value_lengths().to_numpy(zero_copy_only=False)
    flat = a.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(n) and (n == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(n), dims))
    out[np.repeat(np.arange(len(n)), n), np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(1, keepdims=True, initial=1e-300)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def codes(x: np.ndarray, w: np.ndarray, at: np.ndarray, tables: int, flips: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row and table: its substring of the code, the mask of its least certain bits, and the keys under which it stands: all settings of these."""
    margin = (x @ w - at).reshape(len(x), tables, -1)
    width = margin.shape[2]
    value = 1 << np.arange(width, dtype=np.int64)
    base = ((margin > 0) * value).sum(2)
    low = value[np.argsort(np.abs(margin), axis=2, kind="stable")[:, :, :flips]]
    mask = low.sum(2)
    picked = (np.arange(1 << low.shape[2])[:, None] >> np.arange(low.shape[2]) & 1) @ low[:, :, None, :].swapaxes(2, 3)
    keys = ((base & ~mask)[:, :, None] | picked[..., 0]) + (np.arange(tables, dtype=np.int64)[:, None] << width)
    return base, mask, keys.reshape(len(x), -1)


def _coded(w: np.ndarray, at: np.ndarray, tables: int, flips: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                got = codes(_unit(_stacked(batch.column("embedding"), len(w))), w, at, tables, flips)
                lists = [pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.int64())) for x in got]
                yield pa.RecordBatch.from_arrays([batch.column("cid"), *lists], ["cid", "base", "mask", "keys"])

    return run


def _pairs(ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j), i < j < ends[i], some at a time."""
    n = ends - np.arange(len(ends)) - 1
    so_far, a = np.cumsum(n), 0
    while a < len(n):
        b = max(a + 1, int(np.searchsorted(so_far, so_far[a] - n[a] + PAIRS, "right")))
        i = np.repeat(np.arange(a, b), n[a:b])
        yield i, i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n[a:b]) - n[a:b], n[a:b])
        a = b


class _Bucket:
    """Rows of whole buckets (key, cell), in order of these: which pairs they have to settle."""

    def __init__(self, table: pa.Table, tables: int, width: int, most: int) -> None:
        col = lambda c: table.column(c).to_numpy()
        self.key, self.cell, self.side, self.ball, self.cid = (col(c) for c in ("key", "cell", "side", "ball", "cid"))
        self.base, self.mask = (table.column(c).combine_chunks().flatten().to_numpy().reshape(-1, tables) for c in ("base", "mask"))
        self.table, self.own = self.key >> width, self.key & (1 << width) - 1
        self.most = most
        change = np.flatnonzero((np.diff(self.key) != 0) | (np.diff(self.cell) != 0)) + 1
        stops = np.append(change, len(self.key))
        self.ends = np.repeat(stops, np.diff(np.concatenate([[0], stops])))

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of different balls whose codes are near enough, each in one key only of all that its rows share.

        That key is in the first table in which each differing bit is uncertain on a side, and has zeros where both sides are uncertain.
        """
        for i, j in _pairs(self.ends):
            fits = ((self.side[i] < 0) | (self.side[i] != self.side[j])) & ((self.ball[i] != self.ball[j]) | (self.ball[i] < 0))
            i, j = i[fits], j[fits]
            t, a, b = self.table[i], self.mask[i], self.mask[j]
            x, y = self.base[i], self.base[j]
            apart = x ^ y
            meets = (apart & ~(a | b)) == 0
            row = np.arange(len(i))
            canonical = (x & ~a) | (y & a & ~b)
            good = (meets.argmax(1) == t) & (canonical[row, t] == self.own[i]) & (np.bitwise_count(apart).sum(1) <= self.most)
            yield i[good], j[good]


def _retrieved(tables: int, width: int, most: int):
    """The rows of a bucket that have a candidate there."""

    def work(table: pa.Table) -> pa.RecordBatch | None:
        bucket = _Bucket(table, tables, width, most)
        found = np.zeros(table.num_rows, bool)
        for i, j in bucket.pairs():
            found[i] = found[j] = True
        kept = table.filter(pa.array(found)).combine_chunks().to_batches()
        return kept[0] if kept else None

    return work


def least_labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n nodes the least that it reaches over links i-j."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        for at in (label[i], label[j], i, j):
            np.minimum.at(new, at, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _reranked(tables: int, width: int, most: int, cosine: float, dims: int):
    """Each row's links in its buckets, by the original vectors, and the least class that it reaches there."""

    def work(table: pa.Table) -> pa.RecordBatch | None:
        bucket = _Bucket(table, tables, width, most)
        x, size = _unit(_stacked(table.column("embedding"), dims)), table.column("size").to_numpy()
        links, left, right = np.zeros(len(x), np.int64), [], []
        for i, j in bucket.pairs():
            near = np.zeros(len(i), bool)
            for a in range(0, len(i), 16384):
                s = slice(a, a + 16384)
                near[s] = np.einsum("ij,ij->i", x[i[s]], x[j[s]]) >= cosine
            i, j = i[near], j[near]
            np.add.at(links, i, size[j])
            np.add.at(links, j, size[i])
            left.append(i)
            right.append(j)
        if not links.any():
            return None
        some = np.flatnonzero(links)
        # A class stands in several buckets of one table of rows: its rows are one node.
        _, node = np.unique(bucket.cid, return_inverse=True)
        label = least_labels(node.max() + 1, node[np.concatenate(left)], node[np.concatenate(right)])
        least = np.full(len(label), np.iinfo(np.int64).max)
        np.minimum.at(least, label[node], bucket.cid)
        return pa.RecordBatch.from_arrays([pa.array(bucket.cid[some]), pa.array(links[some]), pa.array(least[label[node[some]]])], ["cid", "links", "root"])

    return work


def _salted(big: DataFrame, small: DataFrame, on: list[str], spread, how: str = "inner") -> DataFrame:
    """big joined with a table of one row for each `on`; the rows of one key meet in several tasks, dealt out by the columns spread."""
    many = small.withColumn("_lf_salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    return big.withColumn("_lf_salt", F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int")).join(many.hint("merge"), [*on, "_lf_salt"], how).drop("_lf_salt")


def _sums(dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            key, at = np.unique(batch.column("key").to_numpy(), return_inverse=True)
            total = np.zeros((len(key), dims))
            np.add.at(total, at, _unit(_stacked(batch.column("embedding"), dims)))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(list(total), pa.list_(pa.float64()))], ["key", "embedding"])

    return run


def _centre(dims: int):
    def work(table: pa.Table) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([table.column("key").combine_chunks()[:1], pa.array([_stacked(table.column("embedding"), dims).sum(0)], pa.list_(pa.float64()))], ["key", "centre"])

    return work


def _inside(dims: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = _stacked(batch.column("centre"), dims)
            near = (_unit(_stacked(batch.column("embedding"), dims)) * c).sum(1) >= least * np.linalg.norm(c, axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("cid", "key", "n")], ["cid", "key", "n"]).filter(pa.array(near & (np.linalg.norm(c, axis=1) > 0)))

    return run


def balls(posts: DataFrame, hot: DataFrame, vectors: DataFrame, dims: int, cosine: float) -> DataFrame:
    """(cid, ball): the classes around the centre of a hot key, near enough that any two of them are linked.

    Two vectors within half the threshold's angle of a third are within that angle of each other, so these links need no comparison. A class in
    several such places takes that of the key with the most rows.
    """
    members = _salted(posts.select("cid", "key"), hot, ["key"], ["cid"]).join(vectors.select("cid", "embedding").hint("merge"), "cid")
    members = saved(members, "hot")
    sums = members.select("key", "embedding").mapInArrow(lean(_sums(dims)), "key long, embedding array<double>")
    centres = in_groups(sums, ["key"], _centre(dims), "key long, centre array<double>")
    least = math.cos(math.acos(cosine) / 2 - SLACK)
    inside = _salted(members, centres, ["key"], ["cid"]).select("cid", "key", "n", "embedding", "centre").mapInArrow(lean(_inside(dims, least)), "cid long, key long, n long")
    return inside.groupBy("cid").agg(F.max_by("key", F.struct("n", "key")).alias("ball"))


def _cells(posts: DataFrame, hot: DataFrame, most: int) -> DataFrame:
    """posts with cell and side: a hot key's rows dealt out so that each two that must be compared meet once, and no cell holds more than about 2 * most rows.

    Rows of the key's largest ball, which needs no comparing within, are cut into parts; the others into blocks. A block meets each part, and each
    other block. In a cell of two kinds (side 0 and 1) only rows of different sides are compared.
    """
    counts = _salted(posts.select("cid", "key", "ball"), hot.select("key"), ["key"], ["cid"]).groupBy("key", "ball").agg(F.count("*").alias("n"))
    by = counts.groupBy("key").agg(F.sum("n").alias("rows"), F.max_by("ball", F.struct(F.when(F.col("ball") >= 0, F.col("n")).otherwise(-1), "ball")).alias("main"), F.max(F.when(F.col("ball") >= 0, F.col("n")).otherwise(0)).alias("mains"))
    by = by.select("key", "main", F.ceil(F.col("mains") / most).cast("long").alias("parts"), F.ceil((F.col("rows") - F.col("mains")) / most).cast("long").alias("blocks"))
    told = _salted(posts, by, ["key"], ["cid"], "left")
    at = lambda n: F.pmod(F.xxhash64("cid", F.lit(7)), n)
    up_to = lambda n, f: F.transform(F.sequence(F.lit(0), n - 1), f)
    own = at(F.greatest(F.lit(1), F.col("blocks")))
    whole, wide = F.struct(F.lit(0).cast("long").alias("cell"), F.lit(-1).alias("side")), 1 << 20
    grid = up_to(F.col("blocks"), lambda b: F.struct((F.lit(1) + F.least(own, b) * wide + F.greatest(own, b)).alias("cell"), F.when(own == b, -1).otherwise((own > b).cast("int")).alias("side")))
    cross = lambda part, block: (F.lit(2**41) + part * wide + block).alias("cell")
    met = F.when(F.col("parts") > 0, up_to(F.col("parts"), lambda p: F.struct(cross(p, own), F.lit(1).alias("side")))).otherwise(F.slice(F.array(whole), 1, 0))
    main = F.when(F.col("blocks") > 0, up_to(F.col("blocks"), lambda b: F.struct(cross(at(F.col("parts")), b), F.lit(0).alias("side")))).otherwise(F.slice(F.array(whole), 1, 0))
    cells = F.when(F.col("parts").isNull(), F.array(whole)).when((F.col("ball") == F.col("main")) & (F.col("ball") >= 0), main).otherwise(F.concat(grid, met))
    return told.withColumn("_lf_c", F.explode(cells)).select(*posts.columns, "_lf_c.cell", "_lf_c.side")


def near_vectors(df: DataFrame, vector: str, key: str, cosine: float = COSINE, tables: int = TABLES, flips: int = FLIPS, sample: int = SAMPLE, hot: int = HOT) -> DataFrame:
    """Links (cosine >= the threshold) and components of the vectors in df: n_links, component_id (a least value of `key`) and kept beside the key.

    Equal vectors are one class. Codes have `tables` substrings of about log2(classes) bits, from rotations learned on a sample of so many classes. A class
    stands in each table under its substring with the `flips` least certain bits set in all ways; classes that meet, and whose whole codes differ in no more
    bits than all but one in 10,000 pairs at the threshold do, are candidates, and their vectors are fetched and compared in their bucket. Neither pairs nor
    links are ever rows: a bucket gives each member its number of links and the least class reached. Keys of over `hot` rows settle their dense middle by a ball.

    Null vectors, vectors of zeros, empty ones and those with null or non-finite components link with nothing; a shorter vector counts as padded with zeros. A row
    without a key links with nothing, has no component and is kept. Rows that repeat a key are vectors of their own, with one component_id if their vectors are equal or linked.
    """
    rows = df.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("embedding"))
    fine = F.col("id").isNotNull() & F.coalesce(F.forall("embedding", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))) & F.exists("embedding", lambda x: x != 0), F.lit(False))
    rows = saved(rows.withColumn("embedding", F.when(fine, F.col("embedding"))), "vectors")
    alone = rows.where("embedding IS NULL").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    classes = rows.where("embedding IS NOT NULL").groupBy("embedding").agg(F.count("*").alias("size"), F.min("id").alias("least"))
    classes = saved(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    n, dims = classes.agg(F.count("*"), F.max(F.size("embedding"))).first()
    # A class of one row is known by its id; the rows of the others find theirs by the vector.
    several = _salted(rows.where("embedding IS NOT NULL"), classes.where("size > 1").select("cid", "embedding", "size"), ["embedding"], ["id"])
    joined = several.select("id", "cid", "size").unionByName(classes.where("size = 1").select(F.col("least").alias("id"), "cid", "size"))

    def result(found: DataFrame, least: DataFrame) -> DataFrame:
        known = joined.join(found.hint("merge"), "cid", "left").join(least.hint("merge"), "cid", "left")
        out = known.select("id", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"), F.col("least").alias("component_id")).unionByName(alone)
        return out.select(F.col("id").alias(key), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))

    spark = df.sparkSession
    if n < 2:
        return result(spark.createDataFrame([], "cid long, links long"), classes.select("cid", "least"))
    width = max(8, math.ceil(math.log2(n)))
    drawn = classes.orderBy(F.xxhash64("cid"), "cid").limit(sample).select("embedding").toArrow().column("embedding")
    w, at = rotation(_unit(_stacked(drawn, dims)), tables * width)
    p = math.acos(cosine) / math.pi
    most = math.ceil(tables * width * p + 4 * math.sqrt(tables * width * p * (1 - p))) + 1
    coded = saved(classes.select("cid", "embedding").mapInArrow(lean(_coded(w, at, tables, min(flips, width))), "cid long, base array<long>, mask array<long>, keys array<long>"), "codes")
    posts = coded.select("cid", "base", "mask", F.explode("keys").alias("key"))
    crowded = saved(posts.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > hot), "crowded")
    links, edges = [], []
    if crowded.isEmpty():
        posts = posts.select("*", F.lit(-1).cast("long").alias("ball"), F.lit(0).cast("long").alias("cell"), F.lit(-1).alias("side"))
    else:
        ball = saved(balls(posts, crowded, classes, dims, cosine), "balls")
        weighed = ball.join(classes.select("cid", "size").hint("merge"), "cid")
        of = weighed.groupBy("ball").agg(F.sum("size").alias("all"), F.min("cid").alias("root"))
        told = _salted(weighed, of, ["ball"], ["cid"])
        links.append(told.select("cid", (F.col("all") - F.col("size")).alias("links")))
        edges.append(told.select(F.col("cid").alias("a"), F.col("root").alias("b")))
        posts = coded.join(ball.hint("merge"), "cid", "left").select("cid", "base", "mask", F.coalesce("ball", F.lit(-1)).alias("ball"), F.explode("keys").alias("key"))
        posts = _cells(posts, crowded, hot)
    place = ["key", "cell"]
    candidates = in_groups(posts.select("cid", "base", "mask", "key", "ball", "cell", "side"), place, _retrieved(tables, width, most), "cid long, base array<long>, mask array<long>, key long, ball long, cell long, side int", AT_ONCE)
    fetched = candidates.join(classes.select("cid", "embedding", "size").hint("merge"), "cid")
    found = saved(in_groups(fetched, place, _reranked(tables, width, most, cosine, dims), "cid long, links long, root long", AT_ONCE), "links")
    links.append(found.select("cid", "links"))
    edges.append(found.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    total = links[0] if len(links) == 1 else links[0].unionByName(links[1])
    reach = components(edges[0] if len(edges) == 1 else edges[0].unionByName(edges[1]), "vectors")
    group = classes.join(reach.hint("merge"), classes["cid"] == reach["node"], "left").select("cid", "least", F.coalesce("component", "cid").alias("component"))
    first = group.groupBy("component").agg(F.min("least").alias("first"))
    least = _salted(group.select("cid", "component"), first, ["component"], ["cid"]).select("cid", F.col("first").alias("least"))
    return result(total.groupBy("cid").agg(F.sum("links").alias("links")), least)


def op11_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings, whatever their labels."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "embedding", "vec_id")
