"""Token counts of whole texts; huge texts are encoded in overlapping chunks that are spliced."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm._shared import extended
from lumenfold.llm._text import lean

CHUNK, OVERLAP = 16_384, 256


@cache
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core a task
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@cache
def _can_splice(path: str) -> bool:
    """Whether white space after a non-blank always starts a piece: byte-level pre-tokenising by the library's
    pattern, no normaliser, and no added token that holds or swallows white space."""
    import json

    with open(path, encoding="utf-8") as f:
        x = json.load(f)
    pre = x.get("pre_tokenizer") or {}
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not x.get("normalizer")
    return bool(plain) and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or any(c.isspace() for c in t["content"]) for t in x.get("added_tokens", []))


def _starts(encoding, base: int) -> np.ndarray:
    """Offsets in the text at which tokens start."""
    return np.fromiter((a for a, _ in encoding.offsets), np.int64, len(encoding)) + base


def _common(text: str, left: np.ndarray, right: np.ndarray, low: int) -> int:
    """The first offset above low at which both start a token on white space behind a non-blank, or -1.

    There a piece starts whatever surrounds it, and neither side's tokens depend on the other's text.
    """
    for b in np.intersect1d(left[left > low], right):
        if text[b].isspace() and not text[b - 1].isspace() and text[b] not in "\x1c\x1d\x1e\x1f":
            return int(b)
    return -1


def count_spliced(tokenizer, text: str, chunk: int = CHUNK, overlap: int = OVERLAP, at_once: int = 16) -> int:
    """Tokens of a huge text. Overlaps that have no stable common boundary are doubled, in the end to the whole rest."""
    edges = list(range(0, len(text), chunk))
    encode = lambda a, b: _starts(tokenizer.encode(text[a:b], add_special_tokens=False), a)
    total, since, k = 0, 0, 0
    ready: dict[int, np.ndarray] = {}
    while True:
        if k not in ready:
            ready.clear()
            group = range(k, min(k + at_once, len(edges)))
            for i, e in zip(group, tokenizer.encode_batch([text[edges[i] : edges[i] + chunk + overlap] for i in group], add_special_tokens=False), strict=True):
                ready[i] = _starts(e, edges[i])
        here, end, after, wide = ready[k], edges[k] + chunk + overlap, k + 1, overlap
        while True:
            while after < len(edges) and edges[after] + chunk + overlap <= end:  # swallowed by the widened chunk
                after += 1
            if after >= len(edges) or end >= len(text):
                if end < len(text):
                    here = encode(edges[k], len(text))
                return total + int((here >= since).sum())
            right = ready.get(after)
            if right is None:
                right = ready[after] = encode(edges[after], edges[after] + chunk + overlap)
            cut = _common(text, here, right, max(since, edges[after]))
            if cut >= 0:
                total += int(((here >= since) & (here < cut)).sum())
                since, k = cut, after
                break
            wide *= 2
            end = edges[k] + chunk + wide
            here = encode(edges[k], end)


def _counted(path: str, text: str, chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, splice = _tokenizer(path), _can_splice(path)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                rows = batch.slice(a, 256)
                texts = [t or "" for t in rows.column(text).to_pylist()]
                huge = {i for i, t in enumerate(texts) if splice and len(t) > 2 * chunk}
                counts = iter(tokenizer.encode_batch_fast([t for i, t in enumerate(texts) if i not in huge], add_special_tokens=False))
                n = [count_spliced(tokenizer, t, chunk, overlap) if i in huge else len(next(counts)) for i, t in enumerate(texts)]
                yield pa.RecordBatch.from_arrays([*(c for c, k in zip(rows.columns, rows.schema.names, strict=True) if k != text), pa.array(n, pa.int64())], [*(k for k in rows.schema.names if k != text), "n_tokens"])

    return run


def with_token_counts(df: DataFrame, path: str, text: str = "text", keep: list[str] | None = None, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """The columns keep (by default all but the text) and `n_tokens` of the text (null: 0), without begin, end or added tokens.

    path: a tokenizers JSON file that each executor has. Special strings in a text count as the library's default has them.
    An existing column n_tokens is replaced.
    """
    keep = [c for c in (df.columns if keep is None else keep) if c not in (text, "n_tokens")]
    rows = df.select(*keep, text)
    return rows.mapInArrow(lean(_counted(path, text, chunk, overlap)), extended(rows.schema, "n_tokens long", (text,)))


def op8_token_counts(spark: SparkSession, sf_dir: str, limit: int = 512) -> DataFrame:
    """Bytes and tokens of all documents, and whether the tokens exceed the limit."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    counted = with_token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
