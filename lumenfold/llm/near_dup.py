"""Near-duplicate documents by a signature-coordinate inverted join.

1. Each text becomes a set of word-shingle hashes and a MinHash signature of `coordinates` values. Texts with equal sets (128 bits from
   two BLAKE2b hashes of each word) are one class; one document stands for it from here on.
2. Documents are posted under coordinate-value pairs. Two sets of the asked similarity agree in at least `threshold` coordinates,
   but for a chance of `loss`. A value that one document alone has can't agree; a document with fewer than threshold shared
   values drops out. The others are posted under a prefix only: their size - threshold + 1 rarest shared values, as two
   documents that agree in threshold values meet under one of these.
3. In each posting list, collisions are counted: the shortest of a document's own lists are merged, and the others are only looked
   at for those that can still reach the threshold. What does so, and whose sizes allow the similarity, joins a family. A list yields
   a forest, at most one row less than it has members, not its pairs.
4. In each family, links are confirmed on the texts' real words, again as a forest: members meet under the rarest shingles of their sets,
   and what meets is compared in full.

Lists and families that are too long for one task are first compared with one of their members. What is near it needs
no comparison among itself: those rows are dealt out, and only the rest meets all others. Where that would take many parts, the
rest meets others only under the rarest values (lists) or shingles (families) that it shares with some of them, by the same rule of prefixes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm._shared import SALTS, components, drop, extended, in_groups, saved
from lumenfold.llm._text import PART, Words, grams, lean, mix, pieces, ranges, sequences, splitmix, string_bytes, whole

COORDINATES, LOSS = 64, 1e-9
_XOR, _MUL = splitmix(11, 1024), splitmix(12, 1024) | np.uint64(1)
_I64 = pa.int64()


def threshold(num: int, den: int, coordinates: int = COORDINATES, loss: float = LOSS) -> int:
    """The most agreements that sets of similarity num / den miss with a chance of at most loss."""
    p, below = num / den, 0.0
    for k in range(coordinates + 1):
        below += math.comb(coordinates, k) * p**k * (1 - p) ** (coordinates - k)
        if below > loss:
            return max(1, k)
    return coordinates


def shingle_sets(text: pa.Array, k: int, limit: int = PART) -> Iterator[tuple[int, int, list[np.ndarray], list[np.ndarray], np.ndarray]]:
    """(first row, end row, two arrays of sorted distinct shingle hashes for each text, words of each text).

    Words of A-Z folded texts; a text with fewer than k words is one shingle of all its words, without words the set is empty.
    """
    data, offs = string_bytes(text)
    for i, j in pieces(offs, limit):
        words = Words(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
        lanes = []
        for h in words.hashes(lower=True, lanes=2):
            g = grams(h, k)
            ends = zip(words.at[:-1].tolist(), words.at[1:].tolist(), strict=True)
            lanes.append([_distinct(np.sort(g[a : b - k + 1])) if b - a >= k else whole(h[a:b]) if b > a else h[:0] for a, b in ends])
        yield i, j, *lanes, np.diff(words.at)


def _distinct(x: np.ndarray) -> np.ndarray:
    """Sorted values without repeats."""
    keep = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=keep[1:])
    return x[keep]


def signature(s: np.ndarray, coordinates: int) -> np.ndarray:
    """A value for each coordinate; equal sets agree in all, others in each with their similarity as the chance."""
    out = np.full(coordinates, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for a in range(0, len(s), 4096):
            x = s[None, a : a + 4096] ^ _XOR[:coordinates, None]
            x *= _MUL[:coordinates, None]
            np.minimum(out, x.min(axis=1), out=out)
        return mix(out + _XOR[:coordinates])


def _sum(s: np.ndarray) -> int:
    """64 bits of a set of hashes."""
    with np.errstate(over="ignore"):
        return int(mix(s).sum(dtype=np.uint64).view(np.int64))


def _features(k: int, coordinates: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, sets, others, words in shingle_sets(batch.column(1), k):
                # A text with fewer than k words is like none but those with equal words, so it needs no signature.
                keys = [signature(s, coordinates).view(np.int64) if n >= k else np.zeros(0, np.int64) for s, n in zip(sets, words.tolist(), strict=True)]
                at = np.cumsum([0, *map(len, keys)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(list(map(len, sets)), _I64), *(pa.array(list(map(_sum, x)), _I64) for x in (sets, others)), pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(keys), _I64))],
                    ["id", "n", "d1", "d2", "keys"],
                )

    return run


def _forest(n: int, joined, settled: np.ndarray | None = None) -> tuple[list[int], list[int]]:
    """Edges that connect what joined(i, left) -> the members, of those still left, that i joins, connects; each of n is asked once.

    settled: members that are connected already, which are asked but need no edges. joined sees a mask of those left.
    """
    left, a, b = np.ones(n, bool), [], []
    queue = np.flatnonzero(settled).tolist() if settled is not None else []
    left[queue] = False
    first = 0
    while True:
        while queue:
            i = queue.pop()
            new = joined(i, left)
            if len(new):
                a += [i] * len(new)
                b += new.tolist()
                queue += new.tolist()
                left[new] = False
        while first < n and not left[first]:
            first += 1
        if first == n:
            return a, b
        queue, left[first] = [first], False


def _edges(ids: np.ndarray, a: np.ndarray | list[int], b: np.ndarray | list[int]) -> pa.RecordBatch | None:
    """Each tree of a forest as a star around its least id. Edges come after those that lead to them."""
    if not len(a):
        return None
    a, b = (x if isinstance(x, list) else x.tolist() for x in (a, b))
    root: dict[int, int] = {}
    for x, y in zip(a, b, strict=True):
        root[y] = root.setdefault(x, x)
    member, tree = np.array(list(root.keys())), np.array(list(root.values()))
    order = np.argsort(tree, kind="stable")
    member, tree = ids[member[order]], tree[order]
    first = np.flatnonzero(np.append(True, tree[1:] != tree[:-1]))
    least = np.repeat(np.minimum.reduceat(member, first), np.diff(np.append(first, len(tree))))
    keep = member != least
    return pa.RecordBatch.from_arrays([pa.array(least[keep], _I64), pa.array(member[keep], _I64)], ["a", "b"])


class _Postings:
    """Which members hold a token, of those that are left; made anew whenever half of them are gone."""

    def __init__(self, tokens: np.ndarray, owners: np.ndarray, members: int) -> None:
        self.tokens, self.owners, self.size = tokens, owners, members
        self.top = int(tokens.max()) + 1 if len(tokens) else 0
        self._index()

    def _index(self) -> None:
        order = np.argsort(self.tokens, kind="stable")
        self.tokens, self.owners = self.tokens[order], self.owners[order]
        self.starts = np.searchsorted(self.tokens, np.arange(self.top + 1))

    def shrink(self, left: np.ndarray) -> None:
        n = int(left.sum())
        if 2 * n < self.size:
            keep = left[self.owners]
            self.tokens, self.owners, self.size = self.tokens[keep], self.owners[keep], n
            self._index()

    def lengths(self, tokens: np.ndarray) -> np.ndarray:
        return self.starts[tokens + 1] - self.starts[tokens]

    def owners_of(self, tokens: np.ndarray) -> np.ndarray:
        """The owners of all tokens, one list behind the other."""
        return self.owners[ranges(self.starts[tokens], self.lengths(tokens))]


def _agreeing(least: int, coordinates: int, num: int, den: int, direct: int = 256):
    """Edges between members of posting lists whose signatures agree in at least `least` coordinates and whose sizes allow the similarity.

    sig holds the low byte of each value, of which equal ones are counted: never fewer than agree. Lists of up to `direct` members
    are counted whole; in longer ones short lists are merged and long ones skipped.
    """

    def fits(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return den * np.minimum(x, y) >= num * np.maximum(x, y)

    def work(table: pa.Table) -> pa.RecordBatch | None:
        if table.num_rows < 2:
            return None
        key, block, ids, n = (table.column(c).to_numpy() for c in ("key", "block", "id", "n"))
        near = table.column("near").to_numpy()
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint8).reshape(-1, coordinates)
        starts = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (block[1:] != block[:-1])))
        sizes = np.diff(np.append(starts, len(key)))
        two = starts[sizes == 2]
        two = two[(ids[two] != ids[two + 1]) & fits(n[two], n[two + 1])]
        two = two[(sig[two] == sig[two + 1]).sum(axis=1) >= least]
        a, b = [two], [two + 1]
        for at, size in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            here, sizes_of, settled = sig[at : at + size], n[at : at + size], near[at : at + size]
            joined = _whole(here, sizes_of, least, fits) if size <= direct else _skipping(here, sizes_of, least, fits)
            x, y = _forest(size, joined, settled)
            a.append(np.array(x, np.int64) + at)
            b.append(np.array(y, np.int64) + at)
        return _edges(ids, np.concatenate(a), np.concatenate(b))

    return work


def _whole(sig: np.ndarray, n: np.ndarray, least: int, fits):
    def joined(i: int, left: np.ndarray) -> np.ndarray:
        others = np.flatnonzero(left)
        others = others[fits(n[others], n[i])]
        return others[(sig[others] == sig[i]).sum(axis=1) >= least]

    return joined


def _skipping(sig: np.ndarray, n: np.ndarray, least: int, fits):
    """The members that agree with i: what is in none of i's shortest lists can't reach the threshold in the others."""
    members, width = sig.shape
    tokens = sig.astype(np.int64) + 256 * np.arange(width)
    posted = _Postings(tokens.reshape(-1), np.repeat(np.arange(members), width), members)

    def joined(i: int, left: np.ndarray) -> np.ndarray:
        posted.shrink(left)
        order = np.argsort(posted.lengths(tokens[i]), kind="stable")
        short, long = order[: width - least + 1], order[width - least + 1 :]
        some, count = np.unique(posted.owners_of(tokens[i][short]), return_counts=True)
        keep = left[some] & fits(n[some], n[i])
        some, count = some[keep], count[keep]
        for a in range(0, len(long), 8):
            keep = count + len(long) - a >= least
            some, count = some[keep], count[keep]
            if not len(some):
                break
            part = long[a : a + 8]
            count = count + (sig[np.ix_(some, part)] == sig[i, part]).sum(axis=1)
        return some[count >= least]

    return joined


def _shingles(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(number of each text's distinct shingles, in parts; where each text's begin; how many numbers): equal numbers are equal words, without hashes."""
    data, offs = string_bytes(texts)
    words = Words(data, offs)
    code = words.codes(lower=True)[0].astype(np.int64)
    at = words.at
    n = np.maximum(np.diff(at) - k + 1, 0)
    start = ranges(at[:-1], n)
    number = sequences(code, start, k)
    top = int(number.max()) + 1 if len(number) else 1
    each = _distinct(np.sort(np.repeat(np.arange(len(n)), n) * top + number))
    owner, number = each // top, each % top
    return number, np.searchsorted(owner, np.arange(len(n) + 1)), top


def _confirmed(k: int, num: int, den: int):
    """Edges between the members of families whose full sets have the asked similarity."""

    def work(table: pa.Table) -> pa.RecordBatch | None:
        m = table.num_rows
        if m < 2:
            return None
        ids = table.column("id").to_numpy()
        family, block, near = (table.column(c).to_numpy() for c in ("family", "block", "near"))
        number, at, top = _shingles(table.column("text"), k)
        size = np.diff(at)
        group = np.append(0, np.cumsum((family[1:] != family[:-1]) | (block[1:] != block[:-1])))
        owner = np.repeat(np.arange(m), size)
        # A token is a shingle of a family; numbered from the rarest on.
        _, token, often = np.unique(group[owner] * top + number, return_inverse=True, return_counts=True)
        rank = np.empty(len(often), np.int64)
        rank[np.argsort(often, kind="stable")] = np.arange(len(often))
        token = rank[token]
        token = token[np.lexsort((token, owner))]
        # A member shares num / den of its own set at least with all it links to, so some of its rarest others.
        rarest = size - (num * size + den - 1) // den + 1
        ours = ranges(at[:-1], np.minimum(rarest, size))
        posted = _Postings(token[ours], owner[ours], m)
        mark = np.zeros(len(often), bool)

        def joined(i: int, left: np.ndarray) -> np.ndarray:
            posted.shrink(left)
            some = np.unique(posted.owners_of(token[at[i] : at[i] + min(rarest[i], size[i])]))
            some = some[left[some]]
            some = some[den * np.minimum(size[some], size[i]) >= num * np.maximum(size[some], size[i])]
            if not len(some):
                return some
            mine = token[at[i] : at[i + 1]]
            mark[mine] = True
            both = np.add.reduceat(mark[token[ranges(at[some], size[some])]], np.append(0, np.cumsum(size[some])[:-1]), dtype=np.int64)
            mark[mine] = False
            return some[den * both >= num * (size[some] + size[i] - both)]

        return _edges(ids, *_forest(m, joined, near))

    return work


def _near_agreeing(least: int, coordinates: int):
    """Whether a member's signature agrees with the hub's."""

    def near(hub: pa.Array, own: pa.Array) -> np.ndarray:
        a, b = (np.frombuffer(b"".join(x.to_pylist()), np.uint8).reshape(-1, coordinates) for x in (hub, own))
        return (a == b).sum(axis=1) >= least

    return near


def _near_confirmed(k: int, num: int, den: int):
    """Whether a member's set has the asked similarity with the hub's."""

    def near(hub: pa.Array, own: pa.Array) -> np.ndarray:
        out = []
        for a in range(len(own)):
            number, at, _ = _shingles(pa.array([hub[a].as_py(), own[a].as_py()], pa.string()), k)
            both = len(np.intersect1d(number[: at[1]], number[at[1] :], assume_unique=True))
            out.append(both > 0 and den * both >= num * (len(number) - both))
        return np.array(out, bool)

    return near


def _with_near(test, payload: str, columns: list[str]):
    """Rows with a flag: whether they are near the hub of their group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = test(batch.column("hub_payload"), batch.column(payload))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(near, pa.bool_())], [*columns, "near"])

    return run


def in_blocks(rows: DataFrame, keys: list[str], payload: str, weight: str, limit: int, test, tokens, most_parts: int = 32) -> tuple[DataFrame, DataFrame | None]:
    """(rows with columns block and near, edges): groups of more than `limit` of weight are cut into blocks.

    A long group's members are compared with its hub, the one with the least id: that takes one pass. Those near it are connected by the edges
    that are returned and needn't meet each other. The others have to meet all. Up to most_parts parts of a group meet in blocks of two parts; the
    members of a larger group meet only under the rarest of the tokens that they share in it, of which tokens(members) tells
    (keys, id, _d, need, token): members that belong together share at least `need` tokens of either.
    """
    sizes = saved(rows.groupBy(*keys).agg(F.sum(F.expr(weight)).alias("w"), F.count("*").alias("m"), F.min("id").alias("hub")).where("m > 1"), "sizes")
    plain = [*keys, "block", *[c for c in rows.columns if c not in keys], "near"]
    short = rows.join(sizes.where(F.col("w") <= limit).select(*keys), keys).withColumn("block", F.lit(0).cast("long")).withColumn("near", F.lit(False)).select(*plain)
    long = sizes.where(F.col("w") > limit)
    if not long.limit(1).count():
        return short, None
    members = saved(rows.join(long.select(*keys, "hub"), keys), "long-groups")
    hubs = saved(members.where("id = hub").groupBy(*keys).agg(F.first(payload).alias("hub_payload")), "hubs")
    schema = extended(members.schema, "near boolean")
    told = saved(members.join(hubs, keys).mapInArrow(lean(_with_near(test, payload, members.columns)), schema), "near-hub")
    counts = _parts(told, keys, weight, limit)
    out = short.union(_dealt(told, counts.where(F.col("_s") + F.col("_r") <= most_parts), keys).select(*plain))
    many = counts.where(F.col("_s") + F.col("_r") > most_parts).select(*keys)
    if many.limit(1).count():
        parted = saved(_under_tokens(told.join(many, keys).withColumn("_d", F.xxhash64(payload)), keys, tokens), "rarest")
        inner = [*keys, "_token"]
        cut = _dealt(parted, _parts(parted, inner, weight, limit), inner)
        out = out.union(cut.withColumn("block", F.xxhash64("_token", "block")).select(*plain))
    return out, told.where("near and id != hub").select(F.col("hub").alias("a"), F.col("id").alias("b"))


def _under_tokens(told: DataFrame, keys: list[str], tokens) -> DataFrame:
    """Members of groups with _token, once for each of the rarest tokens under which they meet others that aren't all near the hub.

    Of m tokens that a member shares with some other, its m - need + 1 rarest are enough: what shares `need` tokens with it holds one of these among its own.
    """
    row = [*keys, "id", "_d"]
    posted = saved(tokens(told).select(*row, "need", "token").distinct(), "tokens")
    # Dealt out by a salt, as a token may be in all members of a group.
    salt = F.pmod(F.xxhash64("id"), F.lit(SALTS))
    often = posted.groupBy(*keys, "token").agg(F.count("*").alias("count")).where("count > 1").withColumn("salt", F.explode(F.expr(f"sequence(0L, {SALTS - 1}L)")))
    sorted_ = F.array_sort(F.collect_list(F.struct("count", "token")))
    shared = posted.withColumn("salt", salt).join(often, [*keys, "token", "salt"]).groupBy(*row)
    rarest = shared.agg(F.slice(sorted_, 1, F.greatest(F.count("*") - F.max("need") + 1, F.lit(0)).cast("int")).alias("t"))
    under = rarest.select(*row, F.explode("t.token").alias("_token")).join(told.select(*row, "near").distinct(), row)
    meets = under.groupBy(*keys, "_token").agg(F.count("*").alias("c"), F.bool_and("near").alias("all")).where("c > 1 and not all").select(*keys, "_token")
    meets = meets.withColumn("salt", F.explode(F.expr(f"sequence(0L, {SALTS - 1}L)")))
    return under.drop("near").withColumn("salt", salt).join(meets, [*keys, "_token", "salt"]).drop("salt").join(told, row)


def _parts(told: DataFrame, keys: list[str], weight: str, limit: int) -> DataFrame:
    """How many parts of `limit` the near members (_s) and the others (_r) of each group make, where there are others."""
    parts = lambda near: F.ceil(F.sum(F.when(F.col("near") == near, F.expr(weight)).otherwise(0)) / limit).cast("long")
    return saved(told.groupBy(*keys).agg(parts(True).alias("_s"), parts(False).alias("_r")).where("_r > 0"), "parts")


def _dealt(told: DataFrame, counts: DataFrame, keys: list[str]) -> DataFrame:
    """Members with block: those that aren't near meet all parts and each other, two parts in a block."""
    dealt = told.join(counts, keys).withColumn("_p", F.pmod(F.xxhash64("id", F.lit(17)), F.when(F.col("near"), F.col("_s")).otherwise(F.col("_r"))))
    # Blocks p * _r + q of the others' parts p <= q, then one for each of their parts with each of the near ones'.
    mine = F.when(F.col("near"), F.expr("transform(sequence(0L, _r - 1), q -> _r * _r + q * _s + _p)")).otherwise(
        F.expr("concat(transform(sequence(0L, _r - 1), q -> least(_p, q) * _r + greatest(_p, q)), if(_s > 0, transform(sequence(0L, _s - 1), q -> _r * _r + _p * _s + q), array()))")
    )
    # A part meets itself in its blocks with others, if it has any.
    alone = (F.col("_r") > 1) | (F.col("_s") > 0)
    cut = dealt.withColumn("block", F.explode(mine))
    return cut.where(F.col("near") | ~alone | (F.col("block") != F.col("_p") * F.col("_r") + F.col("_p")))


def _shingle_tokens(k: int, num: int, den: int):
    """Each member's shingles by their hashes, as equal shingles have equal ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, sets, _, _ in shingle_sets(batch.column("text"), k):
                size = np.array(list(map(len, sets)), np.int64)
                at = np.append(0, np.cumsum(size)).astype(np.int32)
                own = batch.slice(i, j - i)
                found = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(sets).view(np.int64)))
                yield pa.RecordBatch.from_arrays([*(own.column(c) for c in ("family", "id", "_d")), pa.array((num * size + den - 1) // den), found], ["family", "id", "_d", "need", "tokens"])

    def tokens(told: DataFrame) -> DataFrame:
        each = told.select("family", "id", "_d", "text").mapInArrow(lean(run), "family long, id long, _d long, need long, tokens array<long>")
        return each.select("family", "id", "_d", "need", F.explode("tokens").alias("token"))

    return tokens


def _signature_tokens(classes: DataFrame, least: int):
    """Each member's other signature values."""

    def tokens(told: DataFrame) -> DataFrame:
        own = told.select("key", "id", "_d").distinct().join(classes.select(F.col("rep").alias("id"), "keys"), "id")
        return own.select("key", "id", "_d", F.lit(least - 1).alias("need"), F.explode("keys").alias("token")).where("token != key")

    return tokens


def near_duplicates(
    docs: DataFrame, id: str = "doc_id", text: str = "text", k: int = 5, num: int = 80, den: int = 100,
    coordinates: int = COORDINATES, loss: float = LOSS, list_rows: int = 4_000, family_bytes: int = 8 << 20, most_parts: int = 32,
) -> DataFrame:
    """A row for each document: id, n_shingles, component_id (the smallest id reachable over links, itself included) and kept.

    Linked are documents whose sets of k-word shingles have den * intersection >= num * union, where the union isn't empty. ids are integers. Texts
    without words, null ones too, are linked with nothing. Rows that repeat an id are one node of the links. Rows without an id are
    linked with nothing and kept, with a null component_id.

    list_rows, family_bytes: what a part of a long posting list or of a large family holds on average. most_parts: so many parts may meet two by two;
    members of larger lists and families meet under the rarest values or shingles that they share in it. None of these changes the result.
    """
    least = threshold(num, den, coordinates, loss)
    source = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    kind = docs.schema[id].dataType
    features = saved(source.mapInArrow(lean(_features(k, coordinates)), "id long, n long, d1 long, d2 long, keys array<long>"), "signatures")

    known = features.where("n > 0 and id is not null")
    classes = saved(known.groupBy("d1", "d2", "n").agg(F.min("id").alias("rep"), F.max("id").alias("last"), F.first("keys").alias("keys")), "classes")

    posted = classes.select("rep", F.explode("keys").alias("key"))
    shared = posted.groupBy("key").agg(F.count("*").alias("count")).where("count > 1")
    # A repeated id with several texts may have several classes; each keeps its own signature.
    rarest = F.slice(F.array_sort(F.collect_list(F.struct("count", "key"))), 1, F.greatest(F.count("*") - least + 1, F.lit(0)).cast("int"))
    prefixes = classes.select("rep", "d1", F.explode("keys").alias("key")).join(shared, "key").groupBy("rep", "d1").agg(rarest.alias("prefix")).where("size(prefix) > 0")
    low = F.expr("unhex(array_join(transform(keys, x -> lpad(hex(x & 255), 2, '0')), ''))")
    signed = prefixes.join(classes.select("rep", "d1", "n", low.alias("sig")), ["rep", "d1"])
    lists = saved(signed.select(F.col("rep").alias("id"), "n", "sig", F.explode("prefix").alias("p")).select("p.key", "id", "n", "sig"), "postings")
    blocks, edges = in_blocks(lists, ["key"], "sig", "1", list_rows, _near_agreeing(least, coordinates), _signature_tokens(classes, least), most_parts)
    candidates = in_groups(blocks, ["key", "block"], _agreeing(least, coordinates, num, den), "a long, b long", 5_000)
    families = saved(components(candidates if edges is None else candidates.union(edges), "families"), "families")
    drop(lists)

    wanted = families.select(F.col("node").alias("id"), F.col("component").alias("family"))
    # Families grow with the input, so they are never broadcast.
    texts = wanted.hint("merge").join(source, "id").groupBy("family", "id", "text").agg(F.lit(1)).select("family", "id", "text")
    members = saved(texts, "members")
    blocks, edges = in_blocks(members, ["family"], "text", "octet_length(text)", family_bytes, _near_confirmed(k, num, den), _shingle_tokens(k, num, den), most_parts)
    links = in_groups(blocks, ["family", "block"], _confirmed(k, num, den), "a long, b long", 1 << 19, "text")
    links = links if edges is None else links.union(edges)

    # Equal sets link too: a class's documents with its representative; those of one id alone don't matter.
    linked = components(links, "links").select(F.col("node").alias("rep"), "component")
    # Read from the written classes, so that the joins below can split a class that holds many rows.
    same = classes.where("rep < last").select("d1", "d2", "n", "rep")
    # ids of several classes join these; only ids with several texts have that.
    several = known.groupBy("id").agg(F.min("d1").alias("x"), F.max("d1").alias("y")).where("x != y").select("id")
    bridges = known.join(several, "id", "left_semi").join(same, ["d1", "d2", "n"]).select(F.col("id").alias("a"), F.col("rep").alias("b"))
    if bridges.limit(1).count():
        linked = components(bridges.union(linked.select("rep", "component")), "bridged").select(F.col("node").alias("rep"), "component")
    of = features.select("id", "n", "d1", "d2").join(same, ["d1", "d2", "n"], "left").withColumn("rep", F.when(F.col("n") > 0, F.coalesce("rep", "id")))
    out = of.join(linked, "rep", "left")
    component = F.coalesce("component", "rep", "id")
    return out.select(F.col("id").cast(kind).alias(id), F.col("n").alias("n_shingles"), component.cast(kind).alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def op2_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their component under links of 85 % of 3-word shingles."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=3, num=85, den=100)
