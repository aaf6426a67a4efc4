"""GIF columns: LZW streams to timed frames with palettes, disposal, transparency and colour histograms."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenfold.llm._shared import extended
from lumenfold.llm._text import lean, pieces, string_bytes

CLEAR, END, MOST = 256, 257, 4096
BINS = 8
GRAY = np.repeat(np.arange(256, dtype=np.uint8), 3).reshape(256, 3)


def _widths(n: int, low: int) -> np.ndarray:
    """Bits of the first n codes after a clear code, if literals have low bits."""
    known = np.arange(n) + (1 << low) + 1  # entries that the decoder has before each code, at most
    return np.clip(np.frexp(known.astype(float))[1], low + 1, 12)


_WIDTHS = _widths(1 << 14, 8)


def lzw_encode(samples: bytes) -> bytes:
    """The codes of 8-bit samples, from the first clear code to the end code, packed from the low bits."""
    out, runs = [CLEAR], [1]  # codes, and the number of codes up to and with each clear code
    table: dict[int, int] = {}
    get, add = table.get, out.append
    free, prefix = CLEAR + 2, samples[0] if samples else -1
    for c in samples[1:]:
        key = prefix << 8 | c
        code = get(key)
        if code is None:
            add(prefix)
            if free < MOST:
                table[key] = free
                free += 1
            else:
                add(CLEAR)
                runs.append(len(out))
                table.clear()
                free = CLEAR + 2
            prefix = c
        else:
            prefix = code
    if samples:
        add(prefix)
    add(END)
    runs.append(len(out))
    codes = np.array(out, np.int64)
    widths = np.concatenate([[9], *(_WIDTHS[: b - a] for a, b in pairwise(runs))])
    at = np.cumsum(widths) - widths
    value = codes << (at & 7)
    size = int((at[-1] + widths[-1] + 7) >> 3)
    byte = at >> 3
    packed = sum(np.bincount(byte + k, (value >> (8 * k)) & 0xFF, size + 3)[: size + 3] for k in range(3))
    return packed[:size].astype(np.uint8).tobytes()


def _expanded(codes: np.ndarray, clear: int) -> np.ndarray:
    """The samples that the codes between two clear codes stand for.

    A code for the table's j-th entry repeats what the j-th code wrote and one sample more, so it copies earlier output.
    Lengths, and then the samples' sources, are followed back to literals by pointer jumping.
    """
    n = len(codes)
    at = np.arange(n)
    literal = codes < clear
    of = np.where(literal, at, codes - (clear + 2))
    if (of[~literal] >= at[~literal]).any() or (of < 0).any():
        raise ValueError("a code that the LZW table doesn't have yet")
    more, jump = (~literal).astype(np.int64), of
    while not literal[jump].all():
        more, jump = more + more[jump], jump[jump]
    length = more + 1
    start = np.cumsum(length) - length
    owner = np.repeat(at, length)
    place = np.arange(len(owner))
    source = np.where(literal[owner], place, place + (start[of] - start)[owner])
    while True:
        further = source[source]
        if np.array_equal(further, source):
            return codes[owner[source]].astype(np.uint8)
        source = further


def lzw_decode(stream: bytes, low: int, most: int) -> bytes:
    """Up to `most` samples of a stream with literals of low bits; fewer if it ends early."""
    data = np.frombuffer(stream + bytes(4), np.uint8).astype(np.int64)
    bits = 8 * len(stream)
    clear = 1 << low
    widths = _WIDTHS if low == 8 else _widths(1 << 14, low)
    sums = np.cumsum(widths)
    at, total, out = 0, 0, []
    while at < bits and total < most:
        n = int(np.searchsorted(sums, bits - at, side="right"))
        steps = widths[:n]
        where = at + sums[:n] - steps
        byte = where >> 3
        codes = ((data[byte] | data[byte + 1] << 8 | data[byte + 2] << 16) >> (where & 7)) & ((1 << steps) - 1)
        stops = np.flatnonzero((codes == clear) | (codes == clear + 1))
        n = int(stops[0]) if len(stops) else len(codes)
        if n:
            out.append(_expanded(codes[:n], clear))
            total += len(out[-1])
        if not len(stops):
            if n < len(widths):
                break
            # No clear code yet: the table is full and its codes go on.
            total -= len(out.pop())
            widths = _widths(2 * len(widths), low)
            sums = np.cumsum(widths)
            continue
        if codes[n] == clear + 1:
            break
        at = int(where[n] + steps[n])
    return b"".join(x.tobytes() for x in out)[:most]


@dataclass
class Frame:
    """One shown picture: its own rectangle, time and disposal, and the canvas after it was drawn."""

    start_cs: int
    delay_cs: int
    disposal: int
    transparent: int
    left: int
    top: int
    width: int
    height: int
    samples: np.ndarray  # height x width palette indices
    canvas: np.ndarray  # canvas height x width x RGBA
    palette: np.ndarray

    def rectangle(self) -> np.ndarray:
        return self.canvas[self.top : self.top + self.height, self.left : self.left + self.width]

    def own_histogram(self) -> np.ndarray:
        """histogram() of the rectangle; without transparency it follows from how often each palette index occurs."""
        if self.transparent >= 0 or self.rectangle().shape[:2] != self.samples.shape:
            return histogram(self.rectangle())
        counts = np.bincount(np.minimum(self.samples.ravel(), len(self.palette) - 1), minlength=len(self.palette))
        return np.concatenate([np.bincount(self.palette[:, c] >> 5, counts, BINS) for c in range(3)]).astype(np.int64)


#: What is raised for a GIF that is cut off or not made as the format says.
MALFORMED = (ValueError, IndexError, struct.error)
PIXELS = 1 << 26  # of a canvas; a header that asks for more is taken as malformed


def frames(gif: bytes, keep: bool = True) -> Iterator[Frame]:
    """The frames of a GIF 87a or 89a in order. Without keep, a frame's canvas is good until the next one is asked for."""
    if gif[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, flags = struct.unpack_from("<HHB", gif, 6)
    at, common = 13, None
    if flags & 0x80:
        size = 3 * (2 << (flags & 7))
        common = np.frombuffer(gif[at : at + size], np.uint8).reshape(-1, 3)
        at += size
    if width * height > PIXELS:
        raise ValueError("canvas too large")
    canvas = np.zeros((height, width, 4), np.uint8)
    time = delay = disposal = 0
    transparent = -1
    while at < len(gif) and gif[at] != 0x3B:
        if gif[at] == 0x21:
            if gif[at + 1] == 0xF9:
                flags, delay, index = struct.unpack_from("<BHB", gif, at + 3)
                disposal, transparent = flags >> 2 & 7, index if flags & 1 else -1
            _, at = _blocks(gif, at + 2)
            continue
        if gif[at] != 0x2C:
            raise ValueError("unknown block")
        left, top, w, h, flags = struct.unpack_from("<HHHHB", gif, at + 1)
        at += 10
        palette = common
        if flags & 0x80:
            size = 3 * (2 << (flags & 7))
            palette = np.frombuffer(gif[at : at + size], np.uint8).reshape(-1, 3)
            at += size
        if palette is None:
            raise ValueError("no palette")
        if not 2 <= gif[at] <= 8 or w * h > PIXELS:
            raise ValueError("no such picture")
        stream, at_next = _blocks(gif, at + 1)
        raw = lzw_decode(stream, gif[at], w * h)
        at = at_next
        samples = np.zeros(w * h, np.uint8)
        samples[: len(raw)] = np.frombuffer(raw, np.uint8)
        samples = samples.reshape(h, w)
        if flags & 0x40:  # interlaced
            order = [y for a, s in ((0, 8), (4, 8), (2, 4), (1, 2)) for y in range(a, h, s)]
            straight = np.empty_like(samples)
            straight[order] = samples
            samples = straight
        saved = canvas.copy() if disposal == 3 else None
        y, x = min(top + h, height), min(left + w, width)
        part = samples[: y - top, : x - left]
        colours = np.full((256, 4), 255, np.uint8)
        colours[: len(palette), :3] = palette
        colours[len(palette) :, :3] = palette[-1]
        target = canvas[top:y, left:x]
        if transparent < 0:
            target[:] = colours[part]
        else:
            shown = part != transparent
            target[shown] = colours[part[shown]]
        yield Frame(time, delay, disposal, transparent, left, top, w, h, samples, canvas.copy() if keep else canvas, palette)
        if disposal == 2:
            canvas[top:y, left:x] = 0
        elif saved is not None:
            canvas = saved
        time, delay, disposal, transparent = time + delay, 0, 0, -1


def _blocks(gif: bytes, at: int) -> tuple[bytes, int]:
    """The joined sub-blocks that begin at an offset, and where they end."""
    out = []
    while gif[at]:
        out.append(gif[at + 1 : at + 1 + gif[at]])
        at += 1 + gif[at]
    return b"".join(out), at + 1


def write_gif(samples: bytes, width: int = 24, rows: int = 480, delay_cs: int = 10) -> bytes:
    """A gray GIF of frames of up to width x rows samples; len(samples) is a multiple of width."""
    count = len(samples) // width
    out = [b"GIF89a", struct.pack("<HHBBB", width, min(rows, count), 0xF7, 0, 0), GRAY.tobytes()]
    for a in range(0, count, rows):
        part = samples[a * width : (a + rows) * width]
        stream = lzw_encode(part)
        out += [b"\x21\xf9\x04", struct.pack("<BHB", 1 << 2, delay_cs, 0), b"\x00", b"\x2c", struct.pack("<HHHHB", 0, 0, width, len(part) // width, 0), b"\x08"]
        out += [bytes([len(stream[k : k + 255])]) + stream[k : k + 255] for k in range(0, len(stream), 255)]
        out.append(b"\x00")
    return b"".join([*out, b"\x3b"])


def histogram(rgb: np.ndarray) -> np.ndarray:
    """BINS counts for each of red, green and blue."""
    return np.concatenate([np.bincount(rgb[..., c].ravel() >> 5, minlength=BINS) for c in range(3)])


def padded(text: bytes, block: int) -> bytes:
    """text and bytes 255 up to a positive multiple of block."""
    return text + b"\xff" * (-len(text) % block if text else block)


def with_gif(df: DataFrame, text: str = "text", width: int = 24, block: int = 576, column: str = "gif") -> DataFrame:
    """df without its text, but with the text's padded UTF-8 bytes as the samples of a GIF (null text: empty)."""
    rows = df.drop(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = string_bytes(batch.column(text))
            names = [k for k in batch.schema.names if k != text]
            for i, j in pieces(offs, 4 << 20):
                made = [write_gif(padded(data[offs[k] : offs[k + 1]].tobytes(), block), width) for k in range(i, j)]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(i, j - i) for k in names), pa.array(made, pa.binary())], [*names, column])

    return rows.mapInArrow(lean(run), extended(rows.schema, f"`{column}` binary", (text,)))


FRAME = "frame int, start_cs long, delay_cs int, disposal int, transparent int, `left` int, top int, width int, height int, rgba binary, histogram array<long>, error string"


def gif_frames(df: DataFrame, key: str, column: str = "gif") -> DataFrame:
    """A row for each frame of each GIF: key and FRAME's columns; rgba is the whole canvas. Null and empty values have no frames.

    A malformed GIF has the frames before its fault, and a last row with nothing but key and error. A key named as one of FRAME's columns comes back as `key`.
    """
    names = [f.name for f in T.StructType.fromDDL(FRAME)]
    rows = df.select(F.col(key).alias("key" if key in names else key), column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int32(), pa.int64(), *[pa.int32()] * 7, pa.binary(), pa.list_(pa.int64()), pa.string()]

        def made(batch: pa.RecordBatch, who: object, values: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip([who, *values], [batch.schema.field(0).type, *types], strict=True)], [batch.schema.names[0], *names])

        for batch in batches:
            for who, gif in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    for k, f in enumerate(frames(gif) if gif else ()):
                        yield made(batch, who, [k, f.start_cs, f.delay_cs, f.disposal, f.transparent, f.left, f.top, f.width, f.height, f.canvas.tobytes(), histogram(f.canvas).tolist(), None])
                except MALFORMED as e:
                    yield made(batch, who, [None] * (len(names) - 1) + [str(e) or type(e).__name__])

    return rows.mapInArrow(lean(run), extended(rows.schema, FRAME, (column,)))


def with_gif_features(df: DataFrame, column: str = "gif") -> DataFrame:
    """df and what is read back from its GIFs: payload_bytes, payload_sha256, tail_crc32 (of the last 32 samples), frames, duration_cs, histogram.

    The payload is the red of each frame's rectangle, in order. Of a malformed GIF all are null but gif_error; of null and empty values that is null too.
    Existing columns of these names are replaced.
    """
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "frames", "duration_cs", "histogram", "gif_error"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.string()]
    rows = df.drop(*names)

    def read(gif: bytes) -> tuple:
        sha, size, tail, count, lasts, bins = hashlib.sha256(), 0, b"", 0, 0, np.zeros(3 * BINS, np.int64)
        for f in frames(gif, keep=False):
            part = np.ascontiguousarray(f.rectangle()[..., 0]).tobytes()
            sha.update(part)
            size, tail, count, lasts = size + len(part), (tail + part)[-32:], count + 1, f.start_cs + f.delay_cs
            bins += f.own_histogram()
        return size, sha.hexdigest(), zlib.crc32(tail), count, lasts, bins.tolist(), None

    def tried(gif: bytes | None) -> tuple:
        try:
            return read(gif) if gif else (None,) * 7
        except MALFORMED as e:
            return *(None,) * 6, str(e) or type(e).__name__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [tried(g) for g in batch.column(column).to_pylist()]
            more = [pa.array([g[k] for g in got], t) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, *names])

    return rows.mapInArrow(lean(run), extended(rows.schema, "payload_bytes long, payload_sha256 string, tail_crc32 long, frames int, duration_cs long, histogram array<long>, gif_error string"))


def op7_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as GIFs and what is read back from them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    read = with_gif_features(with_gif(docs))
    return read.select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32",
        F.octet_length("gif").cast("long").alias("media_bytes"),
        F.sha2("gif", 256).alias("media_sha256"),
        F.concat_ws(";", F.concat(F.lit("frames="), "frames"), F.concat(F.lit("cs="), "duration_cs"), F.concat(F.lit("rgb="), F.array_join(F.col("histogram").cast("array<string>"), ","))).alias("feature"),
    )
