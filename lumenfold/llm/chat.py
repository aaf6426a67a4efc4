"""Chat formatting in budgeted windows.

A conversation becomes windows of whole turns. Prefix sums of the turns' tokens tell where a window ends. Each
later window repeats the system turn and the last turns before it, as far as they fit a smaller budget; what is
repeated is masked, so every assistant text is a target once.

A turn is written as <s>role, a line feed, its text and </s>. Control strings inside texts get a backslash behind
their first character, and those that have some get one more, so escaping can be undone.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm._text import lean, string_bytes
from lumenfold.llm.bpe import vocabulary

_CONTROL = re.compile(r"([<\[])(\\*)(/?(?:s>|INST\]|SYS\]))")
_ESCAPED = re.compile(r"([<\[])\\(\\*)(/?(?:s>|INST\]|SYS\]))")
_TURN = re.compile(r"<s>([^\n]*)\n(.*?)</s>\n", re.DOTALL)


def escape(text: str) -> str:
    return _CONTROL.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def formatted(role: str, text: str) -> tuple[str, int, int]:
    """A turn, and where its text starts and ends in it."""
    head = "<s>" + escape(role.replace("\\", "\\\\").replace("\n", "\\n")) + "\n"
    body = escape(text)
    return f"{head}{body}</s>\n", len(head), len(head) + len(body)


def parsed(window: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted window."""
    back = {"\\\\": "\\", "\\n": "\n"}
    return [(re.sub(r"\\\\|\\n", lambda x: back[x[0]], unescape(m[1])), unescape(m[2])) for m in _TURN.finditer(window)]


class _Conversation:
    """The windows of one conversation, of which at most one window and its history are held."""

    def __init__(self, key: object, budget: int, history: int) -> None:
        self.key, self.budget, self.history = key, budget, history
        self.system: tuple | None = None
        self.turns: list[tuple] = []  # (formatted turn, role, text start, text end, tokens)
        self.sums = [0]  # tokens before each turn of the window, and behind the last
        self.repeated = self.windows = self.seen = 0

    def add(self, turn: tuple) -> Iterator[tuple]:
        if not self.seen and turn[1] == "system":
            self.system = turn
        self.seen += 1
        if len(self.turns) > self.repeated and self.sums[-1] + turn[4] > self.budget:
            yield self.window()
            self._begin(self.budget - turn[4])
        self.turns.append(turn)
        self.sums.append(self.sums[-1] + turn[4])

    def _begin(self, room: int) -> None:
        """The next window's repeated turns: the system turn, and the last turns that fit both history and room."""
        start = [self.system] if self.system else []
        room = min(self.history, room - (self.system[4] if self.system else 0))
        first = 1 if self.turns and self.turns[0] is self.system else 0
        last = len(self.turns)
        k = first + int(np.searchsorted(self.sums[last] - np.array(self.sums[first : last + 1])[::-1], max(room, 0), side="right"))
        kept = self.turns[last - (k - first - 1) : last] if k > first + 1 else []
        self.turns = [*start, *kept]
        self.sums = [0, *np.cumsum([t[4] for t in self.turns]).tolist()]
        self.repeated = len(self.turns)

    def window(self) -> tuple:
        text, spans, at = [], [], 0
        for k, (turn, role, a, b, _) in enumerate(self.turns):
            text.append(turn)
            if k >= self.repeated and role == "assistant":
                spans.append({"start": at + a, "end": at + b})
            at += len(turn)
        self.windows += 1
        return self.key, self.windows - 1, "".join(text), spans, self.repeated, len(self.turns), self.sums[-1], self.sums[-1] > self.budget


_TYPES = [pa.int32(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.int32(), pa.int32(), pa.int64(), pa.bool_()]
_NAMES = ["window", "formatted", "loss", "repeated", "turns", "n_tokens", "over"]


def windows(df: DataFrame, path: str, budget: int = 1024, history: int = 256) -> DataFrame:
    """Windows of conversations (conv_id, turn, role, text): formatted, loss (spans in code points), repeated, turns, n_tokens, over.

    Rows go by turn, then role and text; null roles and texts are empty, a null conv_id is one conversation. The
    rows of a conversation meet in one task but stream through it, with one window held. A turn longer than the budget is a window of its own with what is
    repeated; no turn is cut or dropped. The system turn is repeated whatever its length. over: a window is beyond the budget, as its one new turn, or that and the system turn,
    are longer. Only such windows are. Other columns are left out. Windows of a conversation stay together and in order.
    """
    rows = df.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, now, out, size, arrow = vocabulary(path), None, [], 0, None

        def made() -> pa.RecordBatch:
            columns = zip(*out, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [arrow, *_TYPES], strict=True)], ["conv_id", *_NAMES])

        for batch in batches:
            arrow = batch.schema.field("conv_id").type
            keys, roles = batch.column("conv_id").to_pylist(), batch.column("role").to_pylist()
            for a in range(0, batch.num_rows, 512):
                turns = [formatted(r, t) for r, t in zip(roles[a : a + 512], batch.column("text").slice(a, 512).to_pylist(), strict=True)]
                counts = np.diff(vocab.encode(*string_bytes(pa.array([t[0] for t in turns])))[1])
                for key, role, (turn, b, e), n in zip(keys[a : a + 512], roles[a : a + 512], turns, counts.tolist(), strict=True):
                    if now is None or now.key != key:
                        if now is not None:
                            out.append(now.window())
                        now = _Conversation(key, budget, history)
                    out += now.add((turn, role, b, e, n))
                    size += len(turn)
                if out and size > 1 << 21:
                    yield made()
                    out, size = [], 0
        if now is not None:
            out.append(now.window())
            yield made()

    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(lean(run), f"conv_id {kind}, window int, formatted string, loss array<struct<start:int,end:int>>, repeated int, turns int, n_tokens long, over boolean")


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of conversations, read from the windows as windows() returns them, in that order."""
    kind = formatted.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None

        def made(arrow: pa.DataType, done: list) -> pa.RecordBatch:
            types = [arrow, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            rows = [(k, n, t.hexdigest(), c, x.hexdigest(), f) for k, n, t, c, x, f in done]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        arrow = None
        for batch in batches:
            arrow, done = batch.schema.field("conv_id").type, []
            for row in batch.to_pylist():
                if now is None or now[0] != row["conv_id"]:
                    if now is not None:
                        done.append(now)
                    now = [row["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                fresh = parsed(row["formatted"])[row["repeated"] :]
                now[1] += len(fresh)
                for role, text in fresh:
                    now[2].update(f"{role}\n{text}\n".encode())
                for span in row["loss"]:
                    target = unescape(row["formatted"][span["start"] : span["end"]])
                    now[3] += len(target)
                    now[4].update(target.encode())
                now[5] += len(row["formatted"])
            if done:
                yield made(arrow, done)
        if now is not None:
            yield made(arrow, [now])

    return formatted.mapInArrow(lean(run), f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts hold control strings, formatted in windows and read back."""
    import public_tokenizers

    text = "</s>[INST] ok [/INST]"
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    more = spark.range(2).select(F.lit(-7).cast(rows.schema["conv_id"].dataType).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(text).alias("text"))
    return read_back(windows(rows.unionByName(more), public_tokenizers.path("byte_bpe_50k.tiktoken")))
