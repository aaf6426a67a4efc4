"""Language identification by n-gram Bloom filters whose slots hold a bit for each language.

A slot is a bit mask over languages; an n-gram's mask is the AND of its slots, so one lookup returns all
languages that hold it. A text's mask bits are counted per language, each count is corrected for the share
that its filter would give by chance, and the largest corrected share decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm._shared import drop, extended, saved
from lumenfold.llm._text import PART, lean, mix, pieces, splitmix, string_bytes
from lumenfold.llm.bpe import LETTER, classes

SIZES = (3, 4)
SHIFTS, SLOTS = (4, 34), 22  # bits of a hash that the probes leave out; a filter has at most 2^SLOTS slots, and its chance is corrected however full it is
_MUL = splitmix(7, 16) | np.uint64(1)
UNKNOWN = "und"
MOST_LANGUAGES = 1024


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of all texts' n-grams, offsets of each size and text in them, letters of each text).

    Lower-cased codepoints; what is no letter counts as one kind of edge. An n-gram may begin and end with an
    edge but has letters inside, so no n-gram spans two words. Offsets: a row for each size.
    """
    lowered = [t.lower() for t in texts]
    points = np.frombuffer(("\n" + "\n".join(lowered) + "\n").encode("utf-32-le"), np.uint32)
    letter = classes()[points] == LETTER
    value = np.where(letter, points, 0).astype(np.uint64)
    first = np.cumsum([1, *(len(t) + 1 for t in lowered)])  # where each text starts
    sums = np.append(0, np.cumsum(letter))
    out, at, base = [], [], 0
    with np.errstate(over="ignore"):
        for n in SIZES:
            m = len(value) - n + 1
            if m <= 0:
                at.append(np.full(len(first), base))
                continue
            inside = letter[1 : m + 1].copy()
            for k in range(2, n - 1):
                inside &= letter[k : m + k]
            where = np.flatnonzero(inside)
            h = np.full(len(where), n, np.uint64)
            for k in range(n):
                h += value[where + k] * _MUL[k + n]
            out.append(mix(h))
            at.append(base + np.searchsorted(where, first - 1))
            base += len(where)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.array(at), sums[first[1:] - 1] - sums[first[:-1]]


@dataclass
class Filters:
    """languages, and masks: for each 64 languages an array of slots; chance: each language's rate of false positives."""

    languages: list[str]
    masks: list[np.ndarray]
    chance: np.ndarray

    @staticmethod
    def build(languages: list[str], members: dict[str, np.ndarray], bits: int = 20) -> Filters:
        """From each language's n-grams."""
        found = [(np.full(len(g), k), p) for k, name in enumerate(languages) for g in [members[name].astype(np.uint64)] for p in _probes(g, bits)]
        code = np.concatenate([k for k, _ in found]) if found else np.zeros(0, np.int64)
        return Filters.of_slots(languages, bits, code // 64, np.concatenate([p for _, p in found]) if found else code, np.uint64(1) << (code % 64).astype(np.uint64))

    @staticmethod
    def of_slots(languages: list[str], bits: int, part: np.ndarray, slot: np.ndarray, mask: np.ndarray) -> Filters:
        """From the masks of some slots, each of which is one of 64 languages; masks of one slot are joined."""
        masks, chance = [], []
        for a in range(0, len(languages), 64):
            n = min(64, len(languages) - a)
            kind = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if np.iinfo(t).bits >= n)
            slots, own = np.zeros(1 << bits, kind), part == a // 64
            np.bitwise_or.at(slots, slot[own], mask[own].astype(kind))
            masks.append(slots)
            chance += [float(((slots >> kind(k)) & kind(1)).mean()) ** 2 for k in range(n)]
        return Filters(languages, masks, np.array(chance))

    def shares(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(corrected share of each text's n-grams in each language, letters of each text)."""
        h, at, letters = ngrams(texts)
        total = (at[:, 1:] - at[:, :-1]).sum(axis=0)
        counts = np.zeros((len(texts), len(self.languages)))
        for a, slots in enumerate(self.masks):
            one, two = _probes(h, int(np.log2(len(slots))))
            mask = slots[one] & slots[two]
            for k in range(min(64, len(self.languages) - 64 * a)):
                sums = np.zeros(len(mask) + 1, np.int64)
                np.cumsum((mask >> mask.dtype.type(k)) & mask.dtype.type(1), out=sums[1:])
                counts[:, 64 * a + k] = (sums[at[:, 1:]] - sums[at[:, :-1]]).sum(axis=0)
        share = counts / np.maximum(total, 1)[:, None]
        return np.clip((share - self.chance) / (1 - self.chance), 0, 1), letters


def _probes(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    keep = np.uint64((1 << bits) - 1)
    one, two = (((h >> np.uint64(by)) & keep).astype(np.int64) for by in SHIFTS)
    return one, two


def _small(text: pa.Array, limit: int = PART) -> Iterator[tuple[int, int, list[str]]]:
    """Rows of at most limit bytes of text, or one longer row."""
    _, offs = string_bytes(text)
    for i, j in pieces(offs, limit):
        yield i, j, [t or "" for t in text.slice(i, j - i).to_pylist()]


def learn(docs: DataFrame, per_language: int = 1000, contrast: float = 0.1) -> Filters | None:
    """Filters from the columns lang and text of labelled rows; None if there are none.

    A bounded sample: of each language about per_language rows, those with the smallest hashes (of 62 bits) of their
    doc_id. All n-grams of the sample count. A language holds an n-gram whose rate in its texts is at least `contrast` times the rate in any
    other's, so that a few rows with a wrong label don't put the other language's common n-grams there. The slots are made on the
    executors; the driver gets a mask for each slot in use, of at most 2^SLOTS for 64 languages, and a few rows a language, of which there
    may be MOST_LANGUAGES.
    Languages are in order of their rows, so that nothing known falls to the most frequent one. A label `und` is a language like others.
    """
    rows = docs.where("lang is not null and text is not null")
    found = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()
    if not found:
        return None
    if len(found) > MOST_LANGUAGES:
        raise ValueError(f"{len(found)} labels are more than the {MOST_LANGUAGES} languages whose filters fit the driver")
    names = [r["lang"] for r in found]
    share = F.create_map(*[x for r in found for x in (F.lit(r["lang"]), F.lit(min(1.0, per_language / r["count"])))])
    code = F.create_map(*[x for k, name in enumerate(names) for x in (F.lit(name), F.lit(k))])
    sample = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 62)) < share[F.col("lang")] * (1 << 62)).select(code[F.col("lang")].alias("k"), "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column("k").to_pylist()
            for i, j, texts in _small(batch.column("text")):
                for k in sorted(set(langs[i:j])):
                    h, n = np.unique(ngrams([t for t, x in zip(texts, langs[i:j], strict=True) if x == k])[0], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), k, np.int32)), pa.array(h.view(np.int64)), pa.array(n)], ["k", "gram", "n"])

    counted = saved(sample.mapInArrow(lean(count), "k int, gram long, n long").groupBy("k", "gram").agg(F.sum("n").alias("n")), "ngrams")
    sums = {r["k"]: r for r in counted.groupBy("k").agg(F.sum("n").alias("all"), F.count("*").alias("grams")).collect()}
    most = max((r["grams"] for r in sums.values()), default=0)
    bits = min(SLOTS, max(20, (32 * most).bit_length()))
    total = F.create_map(*[x for k in range(len(names)) for x in (F.lit(k), F.lit(float(sums[k]["all"]) if k in sums else 1.0))])
    rate = F.col("n") / total[F.col("k")]
    held = counted.groupBy("gram").agg(F.max(rate).alias("top"), F.collect_list(F.struct("k", rate.alias("rate"))).alias("in"))
    held = held.select("gram", "top", F.inline("in")).where(F.col("rate") >= contrast * F.col("top"))
    keep = F.lit((1 << bits) - 1)
    probes = F.array(*(F.shiftrightunsigned("gram", by).bitwiseAND(keep) for by in SHIFTS))
    slots = held.select(F.explode(probes).alias("slot"), F.floor(F.col("k") / 64).cast("int").alias("part"), F.expr("shiftleft(1L, k % 64)").alias("mask"))
    got = slots.groupBy("part", "slot").agg(F.bit_or("mask").alias("mask")).toPandas()
    drop(counted)
    return Filters.of_slots(names, bits, got["part"].to_numpy(), got["slot"].to_numpy().astype(np.int64), got["mask"].to_numpy().astype(np.int64).view(np.uint64))


def predict(df: DataFrame, filters: Filters | None, text: str = "text", shares: bool = False) -> DataFrame:
    """df with lang_pred and score; replaces columns of these names.

    `und` and 0 if the text is null or has no letter (or nothing was learned). Equal shares go to the more frequent language. shares: also the
    shares of all languages, in the order of filters.languages. The filters are a broadcast variable of at most 2^SLOTS slots, of 8 bytes at most, for 64 languages.
    """
    rows = df.drop("lang_pred", "score", *(["shares"] if shares else []))
    sent = df.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = sent.value
        for batch in batches:
            for i, j, texts in _small(batch.column(text)):
                if filters is None:
                    share, names, score = np.zeros((len(texts), 0)), [UNKNOWN] * len(texts), np.zeros(len(texts))
                else:
                    share, letters = filters.shares(texts)
                    best = share.argmax(axis=1)
                    names = [filters.languages[b] if n else UNKNOWN for b, n in zip(best, letters, strict=True)]
                    score = np.where(letters > 0, share[np.arange(len(texts)), best], 0.0)
                part = batch.slice(i, j - i)
                more = [pa.array(list(share), pa.list_(pa.float64()))] if shares else []
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names, pa.string()), pa.array(score, pa.float64()), *more], [*part.schema.names, "lang_pred", "score", *(["shares"] if shares else [])])

    return rows.mapInArrow(lean(run), extended(rows.schema, "lang_pred string, score double" + ", shares array<double>" * shares))


def held_out(doc_id: Column) -> Column:
    """A third of the ids, and null, which nothing is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents, learned from those that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    filters = learn(docs.where(~held_out(F.col("doc_id"))))
    return predict(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), filters).drop("text")
