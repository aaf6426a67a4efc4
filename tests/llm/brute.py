"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import collections
import hashlib
import re

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text: str | None, lower: bool = False) -> list[bytes]:
    b = (text or "").encode()
    return WORD.findall(bytes(c + 32 if 65 <= c <= 90 else c for c in b) if lower else b)


def shingles(text: str | None, k: int) -> set:
    w = words(text, lower=True)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def components(rows: list[tuple[int, str | None]], k: int, num: int, den: int) -> dict[int, int]:
    """id -> least id of its component; rows that repeat an id are one node."""
    sets = [(i, shingles(t, k)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def find(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and den * len(a & b) >= num * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in parent}


def without_repeats(rows: list[tuple[int, str | None]], window: int) -> dict[int, tuple[int, int, str]]:
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        w = words(t)
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            k = tuple(w[s : s + window])
            if k in seen:
                gone[s : s + window] = [True] * window
            seen.add(k)
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[i] = len(w), sum(gone), hashlib.sha256(kept).hexdigest()
    return out


def copies(seed: int, n: int, size: int, edits: int, vocabulary: int = 400) -> list[str]:
    """Texts of random words; some are copies of others with a few words changed."""
    import random

    r = random.Random(seed)
    word = lambda: f"w{r.randrange(vocabulary)}"
    out: list[str] = []
    counts = collections.Counter()
    for k in range(n):
        if out and r.random() < 0.5:
            w = r.choice(out).split()
            for _ in range(r.randint(0, edits)):
                if w:
                    w[r.randrange(len(w))] = word()
            out.append(" ".join(w))
        else:
            out.append(" ".join(word() for _ in range(r.randint(1, size))))
        counts[k] += 1
    return out
