import hashlib

from hypothesis import given
from hypothesis import strategies as st

import public_tokenizers
from lumenfold.llm.chat import escape, formatted, op9_chat, parsed, read_back, unescape, windows

SF, PATH = "/root/testdata/sf0.001", public_tokenizers.path("byte_bpe_50k.tiktoken")
BITS = st.lists(st.sampled_from(["<s>", "</s>", "[INST]", "[/INST]", "\\", "<", "[", "/s>", "\n", "a", "[SYS]", "<\\s>"])).map("".join)


@given(BITS, BITS)
def test_escaping_and_parsing(role, text):
    assert unescape(escape(text)) == text and "</s>" not in escape(text)
    assert parsed(formatted(role, text)[0] * 2) == [(role, text)] * 2


def digests(turns):
    said = [t for r, t in turns if r == "assistant"]
    return hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), sum(map(len, said)), hashlib.sha256("".join(said).encode()).hexdigest()


def test_windows(spark):
    talk = [("system", "be brief")] + [(("user", "assistant")[k % 2], f"turn {k} " + "word " * (k % 9)) for k in range(60)] + [("user", "long " * 300), ("assistant", "ok </s>")]
    rows = [(1, k, r, t) for k, (r, t) in enumerate(talk)] + [(2, 0, None, None), (None, 0, "assistant", "x"), (None, 0, "assistant", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    made = windows(df, PATH, budget=120, history=40)
    one = made.where("conv_id = 1").orderBy("window").collect()
    assert len(one) > 5 and all(w.n_tokens <= 120 for w in one if w.turns > w.repeated + 1)
    assert all(parsed(w.formatted)[0] == talk[0] for w in one) and any(w.repeated > 1 for w in one)
    assert sum((parsed(w.formatted)[w.repeated :] for w in one), []) == talk
    got = {r.conv_id: r for r in read_back(made).collect()}
    assert (got[1].turns_sha256, got[1].loss_chars, got[1].loss_sha256) == digests(talk)
    assert (got[2].turns_sha256, got[2].n_turns) == (digests([("", "")])[0], 1) and got[None].loss_chars == 2
    assert read_back(windows(df.limit(0), PATH)).collect() == []


def plain_windows(turns, tokens, budget=1024, history=256):
    """The windows of formatted turns (role, text, tokens), each as the list of its turns, by summing anew for every turn."""
    system = turns[0] if turns[0][0] == "system" else None
    out, now, repeated = [], [], 0
    for t in turns:
        if len(now) > repeated and sum(x[2] for x in now) + t[2] > budget:
            out.append(now)
            rest = now[1:] if system and now[0] is system else now
            room = min(history, budget - t[2] - (system[2] if system else 0))
            keep = max(k for k in range(len(rest) + 1) if k == 0 or sum(x[2] for x in rest[len(rest) - k :]) <= room)
            now = ([system] if system else []) + rest[len(rest) - keep :]
            repeated = len(now)
        now = [*now, t]
    return [*out, now]


def test_query(spark):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    talks = {}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").orderBy("conv_id", "turn").collect():
        talks.setdefault(r.conv_id, []).append((r.role, r.text))
    talks[-7] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    want, several = {}, 0
    for k, v in talks.items():
        made = [(r, f"<s>{r}\n{escape(t)}</s>\n") for r, t in v]
        cut = plain_windows([(r, m, len(library.encode_ordinary(m))) for r, m in made], library)
        several += len(cut) > 1
        want[k] = (*digests(v), len(v), sum(len(m) for w in cut for _, m, _ in w))
    got = {r.conv_id: (r.turns_sha256, r.loss_chars, r.loss_sha256, r.n_turns, r.formatted_chars) for r in op9_chat(spark, SF).collect()}
    assert got == want and several


def test_other_columns_of_clashing_names_are_left_out(spark):
    df = spark.createDataFrame([(1, 0, "user", "hi", "x", 3), (1, 1, "assistant", "ho", "y", 4)], "conv_id long, turn int, role string, text string, window string, loss int")
    made = windows(df, PATH)
    assert made.columns == ["conv_id", "window", "formatted", "loss", "repeated", "turns", "n_tokens", "over"] and read_back(made).first().loss_chars == 2


def test_windows_beyond_the_budget_say_so(spark):
    import public_tokenizers

    from lumenfold.llm.chat import windows

    rows = [(1, 0, "system", "rule " * 40), *((1, k, "user" if k % 2 else "assistant", f"turn {k}") for k in range(1, 9)), (2, 0, "user", "word " * 200), (2, 1, "assistant", "ok"), (3, 0, "user", "hi")]
    got = windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), public_tokenizers.path("byte_bpe_50k.tiktoken"), budget=50, history=20).collect()
    assert all(r.over == (r.n_tokens > 50) for r in got)
    by = {k: [r for r in got if r.conv_id == k] for k in (1, 2, 3)}
    assert [r.over for r in by[2]] == [True, False] and [r.over for r in by[3]] == [False]
    assert sum(r.turns - r.repeated for r in by[1]) == 9
