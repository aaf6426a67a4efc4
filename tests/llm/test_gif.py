import hashlib
import os
import struct
import zlib

import numpy as np
from pyspark.sql import functions as F

from lumenfold.llm.gif import BINS, frames, gif_frames, histogram, lzw_decode, lzw_encode, op7_gif, padded, with_gif, with_gif_features, write_gif

SF = "/root/testdata/sf0.001"


def test_lzw_round_trip():
    for data in (b"", b"a", b"a" * 9000, os.urandom(9000), bytes(range(256)) * 40, b"ab" * 20_000):
        assert lzw_decode(lzw_encode(data), 8, len(data)) == data


def gif_of(images, size=(4, 2), palette=((255, 0, 0), (0, 255, 0), (0, 0, 255), (9, 9, 9))):
    out = [b"GIF89a", struct.pack("<HHBBB", *size, 0x81, 0, 0), bytes(x for c in palette for x in c)]
    for left, top, w, h, samples, disposal, transparent, delay, interlaced in images:
        stream = lzw_encode(bytes(samples))
        out += [b"\x21\xf9\x04", struct.pack("<BHB", disposal << 2 | (transparent >= 0), delay, max(transparent, 0)), b"\x00", b"\x2c", struct.pack("<HHHHB", left, top, w, h, 0x40 * interlaced), b"\x08"]
        out += [bytes([len(stream)]), stream, b"\x00"]
    return b"".join([*out, b"\x3b"])


def test_disposal_transparency_and_time():
    got = list(frames(gif_of([(0, 0, 4, 2, [0] * 8, 1, -1, 5, 0), (1, 0, 2, 1, [1, 2], 2, 2, 7, 0), (0, 1, 1, 1, [2], 3, -1, 1, 0), (3, 0, 1, 1, [3], 0, -1, 2, 0)])))
    assert [(f.start_cs, f.delay_cs, f.disposal) for f in got] == [(0, 5, 1), (5, 7, 2), (12, 1, 3), (13, 2, 0)]
    assert got[1].canvas[0, 1].tolist() == [0, 255, 0, 255] and got[1].canvas[0, 2].tolist() == [255, 0, 0, 255]
    assert got[2].canvas[0, 1].tolist() == [0, 0, 0, 0] and got[2].canvas[1, 0].tolist() == [0, 0, 255, 255]
    assert all(f.own_histogram().tolist() == histogram(f.rectangle()).tolist() for f in got)
    assert got[3].canvas[1, 0].tolist() == [255, 0, 0, 255] and got[3].canvas[0, 3].tolist() == [9, 9, 9, 255]


def test_interlaced_rows():
    straight = np.repeat(np.arange(4), 4) % 4
    order = [0, 2, 1, 3]  # rows of a picture of four as they are stored
    f = next(frames(gif_of([(0, 0, 4, 4, [v for y in order for v in [y] * 4], 0, -1, 0, 1)], size=(4, 4))))
    assert f.samples.ravel().tolist() == straight.tolist()


def test_columns_on_odd_rows(spark):
    texts = [None, "", "a", "é" * 40_000, "same", "same", "x" * 576]
    df = spark.createDataFrame([(i, t, "old") for i, t in enumerate(texts)], "k int, text string, frames string")
    made = with_gif(df)
    got = {r.k: r for r in with_gif_features(made).collect()}
    for i, t in enumerate(texts):
        p = padded((t or "").encode(), 576)
        assert (got[i].payload_bytes, got[i].payload_sha256, got[i].tail_crc32) == (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
    assert got[4].gif == got[5].gif and with_gif(df.limit(0)).count() == 0
    rows = gif_frames(made.where("k = 3"), "k").orderBy("frame").collect()
    assert len(rows) == -(-80_064 // 11_520) and rows[1].start_cs == 10 and sum(rows[0].histogram) == 3 * 11_520
    assert gif_frames(spark.createDataFrame([(1, None)], "k int, gif binary"), "k").collect() == []


def foreign(gif):
    """The samples of each image of a plain GIF, and their delays, by the textbook's decoder: a table of strings, a code at a time."""
    assert gif[:6] in (b"GIF87a", b"GIF89a")
    at = 13 + (3 << (gif[10] & 7) + 1 if gif[10] & 128 else 0)
    images, delays, delay = [], [], 0
    while gif[at] != 0x3B:
        if gif[at] == 0x21:
            if gif[at + 1] == 0xF9:
                delay = gif[at + 4] | gif[at + 5] << 8
            at += 2
        else:
            assert gif[at] == 0x2C
            at += 10 + (3 << (gif[at + 9] & 7) + 1 if gif[at + 9] & 128 else 0)
            low, at = gif[at], at + 1
            images.append(low)
            delays.append(delay)
        body = b""
        while gif[at]:
            body += gif[at + 1 : at + 1 + gif[at]]
            at += 1 + gif[at]
        at += 1
        if images and isinstance(images[-1], int):
            low, value, bits, out, before = images[-1], 0, 0, [], None
            clear, width, table = 1 << low, low + 1, {}
            for byte in body:
                value, bits = value | byte << bits, bits + 8
                while bits >= width:
                    code, value, bits = value & (1 << width) - 1, value >> width, bits - width
                    if code == clear:
                        table, width, before = {k: bytes([k]) for k in range(clear)}, low + 1, None
                        continue
                    if code == clear + 1:
                        break
                    now = table[code] if code in table else before + before[:1]
                    if before is not None and len(table) + 2 < 4096:
                        table[len(table) + 2] = before + now[:1]
                    if len(table) + 2 == 1 << width and width < 12:
                        width += 1
                    out.append(now)
                    before = now
            images[-1] = b"".join(out)
    return images, delays


def test_query(spark):
    docs = {r.doc_id: r.text.encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    media = {r.doc_id: bytes(r.gif) for r in with_gif(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")).collect()}
    long = 0
    for r in op7_gif(spark, SF).collect():
        p = docs[r.doc_id] + b"\xff" * (-len(docs[r.doc_id]) % 576 or (576 if not docs[r.doc_id] else 0))
        gif = media[r.doc_id]
        images, delays = foreign(gif)
        assert b"".join(images) == p and (r.media_bytes, r.media_sha256) == (len(gif), hashlib.sha256(gif).hexdigest())
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(docs[r.doc_id]), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
        bins = np.bincount(np.frombuffer(p, np.uint8) // (256 // BINS), minlength=BINS).tolist()
        assert r.feature == f"frames={len(images)};cs={sum(delays)};rgb={','.join(map(str, bins * 3))}"
        long += len(images) > 1
    assert long


#: A picture that is often used to explain the format: 10 x 10, four colours, written by hand.
SAMPLE = bytes.fromhex("47494638396 10a000a00910000ffffffff00000000ff00000021f90400000000002c000000000a000a000002168c2d99872a1cdc33a00275ec95faa8de608c04914c01003b".replace(" ", ""))


def test_a_stream_written_by_hand():
    rows = [[1] * 5 + [2] * 5] * 3 + [[1] * 3 + [0] * 4 + [2] * 3] * 2
    f = next(frames(SAMPLE))
    assert f.samples.tolist() == rows + [[3 - v if v else 0 for v in r] for r in rows[::-1]]
    assert f.canvas[0, 0].tolist() == [255, 0, 0, 255] and f.canvas[0, 9].tolist() == [0, 0, 255, 255] and f.canvas[4, 4].tolist() == [255, 255, 255, 255]


def test_late_clear_codes():
    data = os.urandom(40_000)
    # Literals alone, without a clear code after the first: the table fills up and stays.
    codes, bits, value = [256, *data, 257], 0, 0
    for k, c in enumerate(codes):
        value |= c << bits
        bits += min(12, (258 + max(0, k - 2)).bit_length()) if k else 9
    stream = value.to_bytes((bits + 7) // 8, "little")
    assert lzw_decode(stream, 8, len(data)) == data


def test_malformed_gifs(spark):
    good = write_gif(padded(b"some text", 576))
    bad = [b"PNG", good[:9], good[:-40], good[:13 + 768] + b"\x99", good[:6] + b"\xff" * 4 + good[10:], SAMPLE[:60]]
    df = spark.createDataFrame([(i, g) for i, g in enumerate([good, None, b"", *bad])], "frame int, gif binary")
    got = {r.frame: r for r in gif_frames(df.where("frame > 2"), "frame").where("error is not null").select(F.col("key").alias("frame"), "error").collect()}
    assert set(got) == set(range(3, 9))
    read = with_gif_features(df.withColumnRenamed("frame", "k")).collect()
    assert [(r.payload_bytes, bool(r.gif_error)) for r in sorted(read, key=lambda r: r.k)] == [(576, False), (None, False), (None, False), *[(None, True)] * 6]
