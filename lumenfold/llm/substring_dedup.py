"""Repeated word windows by prefix-partitioned suffix trees.

Suffixes are indexed at anchors: in each window of `window` words, the first least hash of its runs of `prefix` words. Equal windows
have equal anchors, so each window is judged at one suffix, and most suffixes need no place in a tree.

1. The words at an anchor are the suffix's prefix, and suffixes are dealt out by it. A prefix that occurs once has no repeats.
2. A prefix of more than group_rows suffixes is made longer: its windows become suffixes of their own, dealt out by their first
   words, half of the way to the window more each time, until a group fits.
3. Each group becomes a subtree: sorting the words from the prefix on gives a suffix array, whose common
   prefixes with the neighbours are the tree's internal nodes; the words before the prefix, backwards, give a second tree. A window whose
   anchor is its word o + 1 is a node at depth window - o of one and a node at depth o of the other. Where several suffixes share both
   nodes the window repeats, and all but the first are duplicates. Duplicate windows that overlap make up a maximal repeat.
4. Where even the whole window has more occurrences, the group is one node and only its first
   occurrence is needed, so it is an aggregation, of any size.

Suffixes carry their words, and trees compare these; hashes only choose anchors and deal out. A word of more than LONG bytes stands as 256 bits of its BLAKE2b
digest. Texts that are equal as word sequences (128 bits) are one class with one place in the trees.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm._shared import drop, extended, in_groups, saved
from lumenfold.llm._text import Words, filled, grams, lean, light_hashes, pieces, ranges, sequences, string_bytes

_LAST = (1 << 63) - 1  # rows without an id come after all others
_I64 = pa.int64()
LONG = 80  # bytes of a word that a tree holds as it is


class _Batch:
    """Words, their hashes, and the anchor of each window of several texts."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, window: int, prefix: int) -> None:
        self.words, self.window, self.prefix = Words(data, offs), window, prefix
        self.code, distinct = self.words.codes()
        self.hashes = light_hashes(distinct)[self.code]
        at = self.words.at
        n = len(self.hashes)
        self.keys = grams(self.hashes, prefix)
        w = window - prefix + 1
        if n < window:
            self.starts = self.anchor = np.zeros(0, np.int64)
            return
        views = np.lib.stride_tricks.sliding_window_view(self.keys, w)
        # argmin copies what it looks at: some rows at a time.
        least = np.concatenate([views[a : a + 8192].argmin(axis=1) for a in range(0, len(views), 8192)])[: n - window + 1] + np.arange(n - window + 1)
        inside = np.arange(n - window + 1) + window <= np.repeat(at[1:], np.diff(at))[: n - window + 1]
        self.starts = np.flatnonzero(inside)
        self.anchor = least[self.starts]

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word number of each anchor, first and last start of the windows it stands for).

        Anchors whose windows all repeat earlier ones of their own text are left out, see inner().
        """
        word, low, high = self._every()
        again = np.append(0, np.cumsum(self._again()))
        mine = np.searchsorted(self.starts, low)
        fresh = again[mine + high - low + 1] - again[mine] < high - low + 1
        return word[fresh], low[fresh], high[fresh]

    def inner(self) -> np.ndarray:
        """Starts of windows that repeat an earlier one of the same text."""
        return self.starts[self._again()]

    def _every(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not len(self.anchor):
            return (np.zeros(0, np.int64),) * 3
        new = np.append(True, (self.anchor[1:] != self.anchor[:-1]) | (self.starts[1:] != self.starts[:-1] + 1))
        first = np.flatnonzero(new)
        return self.anchor[first], self.starts[first], self.starts[np.append(first[1:], len(new)) - 1]

    def _again(self) -> np.ndarray:
        """Which windows repeat an earlier one of their text; only texts with a repeated prefix are looked at."""
        out = np.zeros(len(self.starts), bool)
        word, low, high = self._every()
        if not len(word):
            return out
        text = np.searchsorted(self.words.at, word, side="right") - 1
        order = np.lexsort((self.keys[word], text))
        same = (text[order[1:]] == text[order[:-1]]) & (self.keys[word][order[1:]] == self.keys[word][order[:-1]])
        some = np.zeros(len(word), bool)
        some[order[1:][same]] = some[order[:-1][same]] = True
        if not some.any():
            return out
        n = (high - low + 1)[some]
        at = np.repeat(np.searchsorted(self.starts, low[some]) - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        number, owner = sequences(self.code, self.starts[at], self.window), np.repeat(text[some], n)
        order = np.lexsort((at, number, owner))
        out[at[order[1:][(owner[order[1:]] == owner[order[:-1]]) & (number[order[1:]] == number[order[:-1]])]]] = True
        return out

    def joined(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(all words with a space behind each, where each begins, where it ends); long words as their digests."""
        w = self.words
        size = w.end - w.start
        packed = w.data[filled(len(w.data), w.start, w.end)]
        if len(size) and size.max() > LONG:
            at, chunks, done = np.append(0, np.cumsum(size)), [], 0
            for k in np.flatnonzero(size > LONG).tolist():
                short = b"\xff" + blake2b(packed[at[k] : at[k + 1]].tobytes(), digest_size=32).hexdigest().encode()
                chunks += [packed[done : at[k]], np.frombuffer(short, np.uint8)]
                done = at[k + 1]
            packed = np.concatenate([*chunks, packed[done:]])
            size = np.where(size > LONG, 65, size)
        end = np.cumsum(size + 1) - 1
        out = np.full(int(size.sum()) + len(size), 0x20, np.uint8)
        out[filled(len(out), end - size, end)] = packed
        return out, end - size, end

    def digests(self) -> tuple[np.ndarray, np.ndarray]:
        """128 bits of each text's word sequence."""
        data, start, _ = self.joined()
        at = np.append(start, len(data))[self.words.at].tolist()
        raw = memoryview(data)
        out = np.frombuffer(b"".join([blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(at, at[1:], strict=False)]), np.int64).reshape(-1, 2)
        return out[:, 0], out[:, 1]

    def slices(self, first: np.ndarray, last: np.ndarray) -> pa.Array:
        """The words first to last of each pair, each with a space behind it."""
        data, start, end = self.joined()
        n = end[last] + 1 - start[first]
        at = np.append(0, np.cumsum(n)).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data[ranges(start[first], n)]))])


def _ragged(values: np.ndarray, at: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values, kind))


def _batches(text: pa.Array, window: int, prefix: int) -> Iterator[tuple[int, int, _Batch]]:
    data, offs = string_bytes(text)
    for i, j in pieces(offs):
        yield i, j, _Batch(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], window, prefix)


def _features(window: int, prefix: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for i, j, b in _batches(rows.column("text"), window, prefix):
                where, _, _ = b.anchors()
                at = np.searchsorted(where, b.words.at)
                d1, d2 = b.digests()
                inner = where - np.repeat(b.words.at[:-1], np.diff(at))
                yield pa.RecordBatch.from_arrays(
                    [rows.column("id").slice(i, j - i), rows.column("t").slice(i, j - i), pa.array(d1), pa.array(d2), pa.array(np.diff(b.words.at), _I64), _ragged(b.keys[where].view(np.int64), at, _I64), _ragged(inner, at, pa.int32())],
                    ["id", "t", "d1", "d2", "n", "keys", "places"],
                )

    return run


def _chosen(batch: _Batch, digests: np.ndarray, wanted: np.ndarray, places: pa.ListArray) -> tuple[np.ndarray, ...]:
    """(text, word, first start, last start) of the anchors at the asked places, for texts with the asked digests."""
    word, low, high = batch.anchors()
    at = batch.words.at
    ends = places.offsets.to_numpy().astype(np.int64)
    text = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    asked = places.flatten().to_numpy() + at[text]
    asked = asked[(digests == wanted)[text]]
    found = np.isin(word, asked)
    word = word[found]
    return np.searchsorted(at, word, side="right") - 1, word, low[found], high[found]


SUFFIX = "key long, id long, t long, d1 long, place int, least short, most short, words binary, longer array<long>"


def _suffixes(window: int, prefix: int):
    """Each asked anchor: its prefix's key, its place, the offsets of its windows, and the words of these.

    Of anchors with a common prefix, each window: the keys of its longer prefixes, its place, and its words.
    """

    def made(part: pa.RecordBatch, d1: np.ndarray, text: np.ndarray, key: np.ndarray, place: np.ndarray, least: np.ndarray, most: np.ndarray, words: pa.Array, longer: pa.Array) -> pa.RecordBatch:
        at = pa.array(text)
        columns = [pa.array(key.view(np.int64)), part.column("id").take(at), part.column("t").take(at), pa.array(d1[text]), pa.array(place.astype(np.int32)), pa.array(least.astype(np.int16)), pa.array(most.astype(np.int16)), words, longer]
        return pa.RecordBatch.from_arrays(columns, ["key", "id", "t", "d1", "place", "least", "most", "words", "longer"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for i, j, b in _batches(rows.column("text"), window, prefix):
                part = rows.slice(i, j - i)
                d1, asked, at = b.digests()[0], part.column("d1").to_numpy(), b.words.at
                text, word, low, high = _chosen(b, d1, asked, part.column("places"))
                if len(word):
                    yield made(part, d1, text, b.keys[word], word - at[text], word - high, word - low, b.slices(low, high + window - 1), pa.nulls(len(word), pa.list_(_I64)))
                text, word, low, high = _chosen(b, d1, asked, part.column("common"))
                if len(word):
                    n = high - low + 1
                    start, text = ranges(low, n), np.repeat(text, n)
                    keys = np.stack([grams(b.hashes, k)[start] for k in lengths(prefix, window)], axis=1)
                    longer = _ragged(keys.reshape(-1).view(np.int64), np.arange(len(start) + 1) * keys.shape[1], _I64)
                    none = np.zeros(len(start), np.int64)
                    yield made(part, d1, text, none, start - at[text], none, none, b.slices(start, start + window - 1), longer)

    return run


def lengths(prefix: int, window: int) -> list[int]:
    """The longer prefixes: half of the way to the window more each time, then the window."""
    out = []
    while window - prefix > 4:
        prefix = (prefix + window) // 2
        out.append(prefix)
    return [*out, window]


def _nodes(keys: np.ndarray, words: np.ndarray, depths: range) -> dict[int, np.ndarray]:
    """For each depth, the tree node of each suffix: equal for suffixes with the same key and that many first words."""
    n = len(words)
    group = np.append(0, np.cumsum(keys[1:] != keys[:-1]))
    order = np.lexsort((*words.T[::-1], group))
    same = words[order[1:]] == words[order[:-1]]
    common = np.where(group[order[1:]] == group[order[:-1]], np.logical_and.accumulate(same, axis=1).sum(axis=1), -1)
    out = {}
    for d in depths:
        node = np.empty(n, np.int64)
        node[order] = np.append(0, np.cumsum(common < d))
        out[d] = node
    return out


def _repeats(window: int, prefix: int):
    """The windows of whole groups that occur earlier: a bit for each offset of their anchor."""
    side = window - prefix

    def work(table: pa.Table) -> pa.RecordBatch | None:
        if table.num_rows < 2:
            return None
        key, id, t, d1, place, least, most = (table.column(c).to_numpy() for c in ("key", "id", "t", "d1", "place", "least", "most"))
        words = Words(*string_bytes(table.column("words")))
        code, at = words.codes()[0] + 1, words.at
        order = np.lexsort((place, d1, t, id, key))
        new = np.append(True, np.diff(np.stack([key[order], id[order], t[order], d1[order], place[order]]), axis=1).any(axis=0))
        order = order[new]  # a row that repeats an id and its text is the same document
        key, id, t, d1, place, least, most = (x[order] for x in (key, id, t, d1, place, least, most))
        anchor, k = (at[:-1][order] + most)[:, None], np.arange(window)
        left = np.where(k[:side] < most[:, None], code[np.maximum(anchor - 1 - k[:side], 0)], 0)
        right = np.where(k < window - least[:, None], code[np.minimum(anchor + k, len(code) - 1)], 0)
        back, ahead = _nodes(key, left, range(side + 1)), _nodes(key, right, range(prefix, window + 1))
        rank = np.argsort(np.lexsort((place, d1, t, id)))
        bits = np.zeros(len(key), np.int64)
        for o in range(side + 1):
            here = np.flatnonzero((least <= o) & (o <= most))
            if len(here) < 2:
                continue
            node = ahead[window - o][here] * len(key) + back[o][here]
            by = np.lexsort((rank[here], node))
            again = node[by[1:]] == node[by[:-1]]
            bits[here[by[1:][again]]] |= np.int64(1) << np.int64(o)
        hit = bits != 0
        if not hit.any():
            return None
        return pa.RecordBatch.from_arrays([pa.array(x[hit]) for x in (id, t, d1, place, bits)], ["id", "t", "d1", "place", "bits"])

    return work


def _cleaned(window: int, prefix: int, text: str, layout: bool):
    """Texts without the words that duplicate windows cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            data, offs = string_bytes(rows.column(text))
            for i, j in pieces(offs):
                part = rows.slice(i, j - i)
                b = _Batch(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], window, prefix)
                at, n = b.words.at, len(b.words)
                d1 = b.digests()[0]
                starts, alone = _marked(part.column("_lf_found"), at, d1, window - prefix)
                starts = np.concatenate([starts, b.inner()])
                cover = np.bincount(starts, minlength=n + 1) - np.bincount(starts + window, minlength=n + 1)
                cover += np.bincount(at[alone], minlength=n + 1) - np.bincount(at[alone + 1], minlength=n + 1)
                removed = np.cumsum(cover[:n]) > 0
                made = (_without_layout if not layout else _with_layout)(b.words, offs[i : j + 1] - offs[i], removed)
                gone = np.append(0, np.cumsum(removed))
                columns = [part.column(k) for k in part.schema.names if k not in (text, "_lf_found")]
                names = [k for k in part.schema.names if k not in (text, "_lf_found")]
                yield pa.RecordBatch.from_arrays([*columns, made, pa.array(np.diff(at), _I64), pa.array(gone[at[1:]] - gone[at[:-1]], _I64)], [*names, "kept_text", "n_words", "n_removed"])

    return run


def _marked(found: pa.ListArray, at: np.ndarray, d1: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray]:
    """(word numbers at which duplicate windows start, texts that are copies of an earlier one)."""
    sizes = np.nan_to_num(pc.list_value_length(found).to_numpy(zero_copy_only=False)).astype(np.int64)
    text = np.repeat(np.arange(len(found)), sizes)
    values = found.flatten()
    digest, place, bits = (values.field(k).to_numpy(zero_copy_only=False) for k in range(3))
    ours = digest == d1[text]
    text, place, bits = text[ours], place[ours].astype(np.int64), bits[ours]
    starts = [at[text[one]] + place[one] for one in [(place >= 0) & (bits == 0)]]
    for o in range(side + 1):
        here = (bits >> o) & 1 == 1
        starts.append(at[text[here]] + place[here] - o)
    return np.concatenate(starts), np.unique(text[place < 0])


def _strings(data: np.ndarray, keep: np.ndarray, offs: np.ndarray) -> pa.Array:
    sums = np.append(0, np.cumsum(keep))
    at = sums[offs].astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(offs) - 1, [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data[keep]))])


def _without_layout(words: Words, offs: np.ndarray, removed: np.ndarray) -> pa.Array:
    """The kept words, joined by one space."""
    data = words.data.copy()
    start, end = words.start[~removed], words.end[~removed]
    keep = filled(len(data), start, end)
    text = np.searchsorted(offs, start, side="right")
    inner = end[:-1][text[1:] == text[:-1]]  # a kept word follows in the same text, so this byte is white space
    keep[inner] = True
    data[inner] = 0x20
    return _strings(data, keep, offs)


def _with_layout(words: Words, offs: np.ndarray, removed: np.ndarray) -> pa.Array:
    """The texts without the removed words and the white space behind each; untouched texts stay as they are."""
    text = np.searchsorted(offs, words.start, side="right")
    until = np.append(words.start[1:], len(words.data))
    until = np.minimum(until, offs[np.minimum(text, len(offs) - 1)])
    return _strings(words.data, ~filled(len(words.data), words.start[removed], until[removed]), offs)


def without_repeats(
    docs: DataFrame, id: str = "doc_id", text: str = "text", window: int = 50, prefix: int = 6, layout: bool = True,
    group_rows: int = 4_096, at_once: int = 8_192,
) -> DataFrame:
    """docs with kept_text, n_words and n_removed: without the words of windows that also start earlier, by id, then by place.

    Words are runs of bytes other than 0x20 and 0x09-0x0D, compared as they are. Windows are judged on the input. A text shorter than the window
    and an empty or null one lose nothing; kept_text of null is empty. Rows without an id come last. Rows that repeat an id and a text are
    the same document; rows that repeat an id with other texts are in order of their texts' hashes. layout: keep the white space
    between kept words, else join them by one space. Existing columns of the new names are replaced. group_rows: the most suffixes of a subtree; it
    changes no result.
    """
    prefix = max(prefix, window - 60)  # offsets fit 63 bits
    if window <= prefix:
        raise ValueError("the window must be longer than the prefix")
    key = [F.coalesce(F.col(id).cast("long"), F.lit(_LAST)).alias("id"), _hash(F.col(text)).alias("t")]
    source = docs.select(*key, F.col(text).alias("text"))
    found = _found(source, window, prefix, group_rows, at_once)
    rows = docs.drop("kept_text", "n_words", "n_removed")
    listed = found.groupBy("id", "t").agg(F.collect_list(F.struct("d1", "place", "bits")).alias("_lf_found")).toDF("_lf_id", "_lf_t", "_lf_found")
    joined = rows.join(listed, (key[0] == F.col("_lf_id")) & (key[1] == F.col("_lf_t")), "left").drop("_lf_id", "_lf_t")
    kept = [f for f in rows.schema if f.name != text]
    work = joined.select(*(f"`{f.name}`" for f in kept), F.col(text), "_lf_found")
    return work.mapInArrow(lean(_cleaned(window, prefix, text, layout)), extended(rows.schema, "kept_text string, n_words long, n_removed long", (text,)))


def _hash(text: Column) -> Column:
    """64 bits that keep apart the texts of an id, or of the rows without one."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _found(source: DataFrame, window: int, prefix: int, group_rows: int, at_once: int) -> DataFrame:
    """(id, t, d1, place, bits): duplicate windows by anchor and offsets, by start (bits 0), or all of a copy (place -1)."""
    features = saved(source.mapInArrow(lean(_features(window, prefix)), "id long, t long, d1 long, d2 long, n long, keys array<long>, places array<int>"), "anchors")
    places = _repeated(features, window, group_rows)
    repeats = features.groupBy("id", "t").agg(F.count("*").alias("c")).where("c > 1").limit(1).count()
    texts = source.dropDuplicates(["id", "t", "text"]) if repeats else source
    # Both grow with the input, so neither side is broadcast.
    suffixes = texts.join(places.hint("merge"), ["id", "t"]).mapInArrow(lean(_suffixes(window, prefix)), SUFFIX)
    more = None
    if places.where("size(common) > 0").limit(1).count():
        every = saved(suffixes, "suffixes")
        suffixes, rest = every.where("longer is null"), every.where("longer is not null")
        for k in range(len(lengths(prefix, window))):
            rest = rest.withColumn("key", F.col("longer")[k])
            hot = saved(rest.groupBy("key").agg(F.count("*").alias("c")).where(F.col("c") > group_rows).select("key"), "common-prefixes")
            suffixes, rest = suffixes.union(rest.join(hot, "key", "left_anti").select(suffixes.columns)), rest.join(hot, "key", "left_semi").select(suffixes.columns)
        # The whole window is the prefix: one node, and its first occurrence.
        this = F.struct("id", "t", "d1", "place")
        rest = saved(rest, "common-windows")
        first = saved(rest.groupBy("key", "words").agg(F.min(this).alias("first")), "first-windows")
        more = rest.join(first, ["key", "words"]).where(this > F.col("first")).select("id", "t", "d1", "place", F.lit(0).cast("long").alias("bits"))
    found = in_groups(suffixes.drop("longer"), ["key"], _repeats(window, prefix), "id long, t long, d1 long, place int, bits long", at_once)
    copies = features.where(F.col("n") >= window).select("id", "t", "d1", "d2")
    first = copies.groupBy("d1", "d2").agg(F.min(F.struct("id", "t")).alias("rep"), F.max(F.struct("id", "t")).alias("last")).where("rep < last")
    copies = copies.join(first, ["d1", "d2"]).where(F.struct("id", "t") > F.col("rep")).select("id", "t", "d1").distinct()
    found = found.union(copies.select("id", "t", "d1", F.lit(-1).alias("place"), F.lit(0).cast("long").alias("bits")))
    return saved(found if more is None else found.union(more), "found")


def _repeated(features: DataFrame, window: int, group_rows: int) -> DataFrame:
    """(id, t, d1, places, common): anchors of one text of each class whose prefix occurs again, and those whose prefix does so more than group_rows times."""
    long = features.where(F.col("n") >= window)
    # Texts that occur once need no join: only classes of several rows lose some.
    several = long.groupBy("d1", "d2").agg(F.min(F.struct("id", "t")).alias("rep"), F.count("*").alias("c")).where("c > 1").select("d1", "d2", "rep")
    ours = long.join(several, ["d1", "d2"], "left").where(F.col("rep").isNull() | (F.col("rep") == F.struct("id", "t")))
    ours = saved(ours.select("id", "t", "d1", "keys", "places").dropDuplicates(["id", "t", "d1"]), "classes")
    each = ours.select("id", "t", "d1", F.inline(F.arrays_zip("keys", "places"))).withColumnRenamed("keys", "key").withColumnRenamed("places", "place")
    counts = ours.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    listed = lambda test: F.collect_list(F.when(test, F.col("place")))
    again = each.join(counts, "key").groupBy("id", "t", "d1").agg(listed(F.col("c") <= group_rows).alias("places"), listed(F.col("c") > group_rows).alias("common"))
    out = saved(again, "places")
    drop(ours)
    return out


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the words of 20-word windows that occur earlier."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = without_repeats(docs, window=20, layout=False)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
