"""Byte-level BPE by vectorised pre-tokenisation and cached pair merging.

The texts of a batch are one codepoint array. Each codepoint becomes a symbol: its class (letter, number,
white space, other) with what the next codepoints decide. A symbol is a function from state to state;
composing functions is associative, so blocks are composed on their own, the blocks' functions are combined
by a prefix scan, and each block is then run from its known state. No regular expression sees the text.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm._shared import extended
from lumenfold.llm._text import SPACE, lean, pieces, string_bytes

# Classes of codepoints, and the symbols made of them.
LETTER, NUMBER, OTHER, SHORT, LONG, SPACE_BEFORE, BLANK_BEFORE, BLANK = range(8)
# SHORT, LONG: an apostrophe with one or two letters of a contraction behind it. SPACE_BEFORE: U+0020
# before a non-blank. BLANK_BEFORE: another white space before a non-blank. BLANK: any other white space.
FREE, IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_BLANKS, AFTER_SPACE, ONE_LEFT, TWO_LEFT = range(8)
FIRST = 8  # added to the symbol of a text's first codepoint
CONTRACTIONS = ("s", "t", "m", "d"), ("re", "ve", "ll")


def _machine() -> tuple[np.ndarray, np.ndarray]:
    """(next state, whether a piece starts here), both by symbol * 8 + state."""
    to, starts = np.zeros((16, 8), np.uint8), np.ones((16, 8), bool)
    for symbol, state, also in ((LETTER, IN_LETTERS, ()), (NUMBER, IN_NUMBERS, ()), (OTHER, IN_OTHERS, ())):
        to[symbol] = state
        starts[symbol, [state, AFTER_SPACE, *also]] = False
    to[LETTER, ONE_LEFT], to[LETTER, TWO_LEFT] = FREE, ONE_LEFT
    starts[LETTER, [ONE_LEFT, TWO_LEFT]] = False
    for symbol, state in ((SHORT, ONE_LEFT), (LONG, TWO_LEFT)):
        to[symbol] = state
        to[symbol, [IN_OTHERS, AFTER_SPACE]] = IN_OTHERS
        starts[symbol, [IN_OTHERS, AFTER_SPACE]] = False
    to[SPACE_BEFORE], to[BLANK_BEFORE], to[BLANK] = AFTER_SPACE, FREE, IN_BLANKS
    starts[BLANK, IN_BLANKS] = False
    to[FIRST:] = to[:FIRST, [FREE]]
    return to.ravel(), starts.ravel()


_TO, _STARTS = _machine()


@cache
def classes() -> np.ndarray:
    """LETTER, NUMBER, OTHER or BLANK for every codepoint, by Unicode property."""
    import regex

    out = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))
    for prop, value in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\p{White_Space}+", BLANK)):
        for m in regex.finditer(prop, every):
            out[ord(m[0][0]) : ord(m[0][-1]) + 1] = value
    return out


def symbols(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Symbols of codepoints; first: the index of each non-empty text's first codepoint."""
    kind = classes()[points]
    n = len(points)
    ends = np.zeros(n, bool)  # the last codepoint of a text
    ends[first[1:] - 1] = True
    ends[-1:] = True
    before = np.zeros(n, bool)  # a non-blank of the same text follows
    before[:-1] = (kind[1:] != BLANK) & ~ends[:-1]
    blank = kind == BLANK
    out = kind.copy()
    out[blank & before] = BLANK_BEFORE
    out[blank & before & (points == 0x20)] = SPACE_BEFORE
    marks = np.flatnonzero(points == ord("'"))
    if len(marks):
        one = np.where(marks + 1 < n, points[np.minimum(marks + 1, n - 1)], 0)
        two = np.where(marks + 2 < n, points[np.minimum(marks + 2, n - 1)], 0)
        has1 = ~ends[marks]
        has2 = has1 & ~ends[np.minimum(marks + 1, n - 1)]
        for c in CONTRACTIONS[0]:
            out[marks[has1 & (one == ord(c))]] = SHORT
        for a, b in CONTRACTIONS[1]:
            out[marks[has2 & (one == ord(a)) & (two == ord(b))]] = LONG
    out[first] += FIRST
    return out


def scan_starts(symbol: np.ndarray, block: int = 256) -> np.ndarray:
    """Indices at which pieces start."""
    n = len(symbol)
    if not n:
        return np.zeros(0, np.int64)
    rows = -(-n // block)
    padded = np.full(rows * block, BLANK, np.uint8)
    padded[:n] = symbol
    columns = np.ascontiguousarray(padded.reshape(rows, block).T).astype(np.int16) * 8
    # Each block as one function of its first state.
    whole = np.broadcast_to(np.arange(8, dtype=np.int16), (rows, 8))
    for c in columns:
        whole = _TO[c[:, None] + whole]
    # Prefix scan: after step s, whole[r] covers blocks r - 2s + 1 to r.
    step = 1
    while step < rows:
        joined = whole.copy()
        joined[step:] = np.take_along_axis(whole[step:], whole[:-step].astype(np.int64), axis=1)
        whole, step = joined, step * 2
    state = np.zeros(rows, np.int16)
    state[1:] = whole[:-1, FREE]
    out = np.empty((block, rows), bool)
    for k, c in enumerate(columns):
        at = c + state
        out[k] = _STARTS[at]
        state = _TO[at].astype(np.int16)
    return np.flatnonzero(out.T.ravel()[:n])


def safe_cuts(row: np.ndarray, limit: int) -> list[int]:
    """Byte offsets that cut a text into parts of about limit bytes where a piece starts in any case.

    No piece holds anything but letters behind a letter, nor white space after a non-blank, and what comes later depends on later text
    alone; so the end of each run of letters, in any script, will do, and each U+0020 behind an ASCII non-blank. Without one, the part grows.
    """
    cuts, at = [], 0
    while len(row) - at > limit:
        found = -1
        for a in range(at + limit, len(row), 1 << 16):
            first, end = _char_start(row, a - 1), _char_start(row, a + (1 << 16))
            part = row[first:end]
            points = np.frombuffer(part.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
            letter = classes()[points] == LETTER
            before = points[:-1]
            blank = (points[1:] == 0x20) & (before < 0x80) & ~SPACE[np.minimum(before, 0x7F)]
            ok = np.flatnonzero((letter[:-1] & ~letter[1:]) | blank)
            if len(ok):
                found = first + int(np.flatnonzero((part & 0xC0) != 0x80)[ok[0] + 1])
                break
        if found < 0:
            break
        cuts.append(found)
        at = found
    return cuts


def _char_start(row: np.ndarray, at: int) -> int:
    """Where the character of a byte begins."""
    if at >= len(row):
        return len(row)
    while row[at] & 0xC0 == 0x80:
        at -= 1
    return at


class Vocabulary:
    """Ranks of byte strings, read from a file of base64 and number pairs."""

    def __init__(self, path: str, keep: int = 300_000) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.keep = keep
        self.known: dict[bytes, tuple[int, ...]] = {}
        size = max(self.ranks.values()) + 1
        words = [b""] * size
        for word, rank in self.ranks.items():
            words[rank] = word
        self.words = pa.array(words, pa.binary())
        self.sizes = np.array([len(w) for w in words])

    def merged(self, piece: bytes) -> tuple[int, ...]:
        """The ids of one piece; of equal ranks the leftmost pair merges first."""
        got = self.known.get(piece)
        if got is None:
            rank = self.ranks.get(piece)
            got = (rank,) if rank is not None else self._merge(piece)
            if len(piece) <= 64:
                if len(self.known) >= self.keep:
                    self.known.clear()
                self.known[piece] = got
        return got

    def _merge(self, piece: bytes) -> tuple[int, ...]:
        n, ranks = len(piece), self.ranks
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapify(heap)
        alive = [True] * n
        while heap:
            _, i, end = heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or after[j] != end:  # one of the two has merged since
                continue
            alive[j] = False
            after[i] = end
            if end < n:
                before[end] = i
                if (r := ranks.get(piece[i : after[end]])) is not None:
                    heappush(heap, (r, i, after[end]))
            if (h := before[i]) >= 0 and (r := ranks.get(piece[h:end])) is not None:
                heappush(heap, (r, h, end))
        return tuple(ranks[piece[i : after[i]]] for i in range(n) if alive[i])

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets of each text's ids) of UTF-8 texts."""
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(offs), np.int64)
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        at_byte = np.flatnonzero((data & 0xC0) != 0x80)
        texts = np.searchsorted(at_byte, offs)
        starts = scan_starts(symbols(points, np.unique(texts[:-1][np.diff(texts) > 0])))
        cut = np.append(at_byte[starts], len(data)).astype(np.int32)
        slices = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(cut), pa.py_buffer(np.ascontiguousarray(data))])
        coded = slices.dictionary_encode()
        ids = [self.merged(p) for p in coded.dictionary.to_pylist()]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.int32, int(size.sum()))
        which = coded.indices.to_numpy()
        counts = size[which]
        ends = np.cumsum(counts)
        total = int(ends[-1])
        out = flat[np.repeat((np.cumsum(size) - size)[which] - (ends - counts), counts) + np.arange(total)]
        return out, np.append(0, ends)[np.searchsorted(starts, texts)]


@cache
def vocabulary(path: str) -> Vocabulary:
    """Read once in each Python worker."""
    return Vocabulary(path)


def _encoded(path: str, text: str, limit: int, offsets: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            data, offs = string_bytes(batch.column(text))
            for i, j in pieces(offs, limit):
                part = data[offs[i] : offs[j]]
                inner = offs[i : j + 1] - offs[i]
                if j == i + 1 and len(part) > limit:
                    edges = [0, *safe_cuts(part, limit), len(part)]
                    ids = [vocab.encode(part[a:b], np.array([0, b - a]))[0] for a, b in zip(edges, edges[1:], strict=False)]
                    ids = np.concatenate(ids)
                    at = np.array([0, len(ids)])
                else:
                    ids, at = vocab.encode(part, inner)
                rows = batch.slice(i, j - i)
                column = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids, pa.int32()))
                columns, names = [*rows.columns, column], [*rows.schema.names, "ids"]
                if offsets:
                    ends = np.append(0, np.cumsum(vocab.sizes[ids]))
                    ends = ends[1:] - np.repeat(ends[at[:-1]], np.diff(at))
                    columns.append(pa.ListArray.from_arrays(column.offsets, pa.array(ends.astype(np.int32))))
                    names.append("ends")
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _decoded(path: str, keep_ends: bool = True):
    """Rows with `decoded`. Where the tokens' offsets are retained, a text is as long as its last one says, and the tokens have to fill it to that byte."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path).words
        for batch in batches:
            ids = batch.column("ids")
            joined = words.take(ids.flatten())
            _, ends, data = joined.buffers()
            ends = np.frombuffer(ends, np.int32)[: len(joined) + 1] if len(joined) else np.zeros(1, np.int32)
            cuts = ids.offsets.to_numpy() - ids.offsets[0].as_py()
            at, names = ends[cuts], batch.schema.names
            if "ends" in names:
                told = np.append(0, batch.column("ends").flatten().to_numpy())
                lengths = np.where(np.diff(cuts) > 0, told[cuts[1:]], 0)
                if (np.append(0, np.cumsum(lengths)) != at - at[0]).any():
                    raise ValueError("the tokens' offsets and their bytes differ")
                names = names if keep_ends else [c for c in names if c != "ends"]
            column = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(at.astype(np.int32)), data])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), column], [*names, "decoded"])

    return run


def encode(df: DataFrame, path: str, text: str = "text", keep: list[str] | None = None, decode: bool = False, offsets: bool = False, limit: int = 1 << 20) -> DataFrame:
    """The columns keep (by default all) and `ids`, the token ids of the text; with offsets also `ends`, the byte of the text at which each
    token ends, so that any run of tokens can be decoded or found in the text on its own; with decode also `decoded`.

    A null text gives no ids, as an empty one does. Longer texts than limit bytes are encoded in parts. Existing columns
    `ids`, `ends` and `decoded` are replaced. path: a vocabulary file that each executor has.
    """
    keep = [c for c in (df.columns if keep is None else keep) if c not in ("ids", "ends", "decoded")]
    rows = df.select(*dict.fromkeys([*keep, text]))
    schema = extended(rows.schema, "ids array<int>" + ", ends array<int>" * offsets)
    made = [*keep, "ids", *["ends"] * offsets]
    if not decode:
        return rows.mapInArrow(lean(_encoded(path, text, limit, offsets)), schema).select(*made)
    # Decoding goes by the offsets, which leave the task only if they are asked for.
    work, back = _encoded(path, text, limit, True), _decoded(path, offsets)
    return rows.mapInArrow(lean(lambda batches: back(work(batches))), extended(schema, "decoded binary")).select(*made, "decoded")


def decode(df: DataFrame, path: str) -> DataFrame:
    """df and `decoded`, the bytes of the column ids (null: none)."""
    rows = df.drop("decoded").withColumn("ids", F.coalesce("ids", F.array().cast("array<int>")))
    return rows.mapInArrow(lean(_decoded(path)), extended(rows.schema, "decoded binary"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of all documents' ids and of what they decode to."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digests(encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), keep=["doc_id"], decode=True))


def digests(coded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 from encode(..., decode=True)."""
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
