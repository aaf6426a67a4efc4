"""Benchmark decontamination by template windows.

Numbers, names and units of a text become typed placeholders, so that a question with other parameters has the same template.
Windows of template tokens are hash-joined with those of the benchmark; hits on one diagonal (the same item at the same shift) are an
alignment. An alignment that covers enough words counts if its slots are consistent: each value of the item's
placeholders stands for one value in the text throughout.

Windows also match word by word, whatever they are made of. A capitalised word that opens a sentence is a name or a plain word, in
all combinations. Windows are also made of runs: several names, or a number and its unit, are one placeholder. Where no diagonal
covers enough, an alignment is carried on from its windows over gaps of a few words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lumenfold.llm._shared import SALTS, extended, in_groups, saved
from lumenfold.llm._text import _GRAM, Words, lean, light_hashes, mix, pieces, splitmix, string_bytes

LITERAL, NUMBER, NAME, UNIT = range(4)
# Words that count as units behind a number.
UNITS = (
    "kg g mg lb lbs oz km m cm mm mi ft inch inches mile miles meter meters metre metres l ml litre litres liter liters "
    "s sec second seconds min minute minutes h hour hours day days week weeks month months year years "
    "gram grams kilogram kilograms ton tons tonne tonnes pound pounds ounce ounces "
    "kilometer kilometers kilometre kilometres centimeter centimeters centimetre centimetres millimeter millimeters foot feet yard yards furlong furlongs acre acres hectare hectares "
    "milliliter milliliters gallon gallons quart quarts pint pints cup cups barrel barrels "
    "кг г км м см л литр литра литров метр метра метров час часа часов день дня дней минут минуты рублей рубля "
    "usd eur gbp dollar dollars euro euros cent cents percent degree degrees mph kmh kph w kw mw v mb gb tb "
    "kilo kilos kilogramo kilogramos gramo gramos metro metros litro litros segundo segundos minuto minutos hora horas día días semana semanas mes meses año años dólar dólares grado grados "
    "kilogramme kilogrammes gramme grammes mètre mètres seconde secondes heure heures jour jours semaine semaines mois ans année années degré degrés "
    "kilogramm gramm meter liter sekunde sekunden minuten stunde stunden tag tage tagen woche wochen monat monate jahr jahre jahren grad prozent"
).split()

GAP, RESUME = 4, 3  # words that an alignment may skip on either side at once, and words that must fit behind them
AT_ONCE = 1 << 16  # windows whose readings are made together
FILTER, PROBES = 28, (0, 31)  # the most bits of a filter, as a power of two, and the bits of a hash that its probes leave out

_KIND = splitmix(31, 4)
_DIGIT, _NUMERIC, _MARK = (np.zeros(256, bool) for _ in range(3))
_DIGIT[48:58] = _NUMERIC[48:58] = True
_NUMERIC[[ord(c) for c in ".,:/-%"]] = True
_MARK[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
#: Capitals of all scripts in the plane that words of everyday texts are in, by codepoint.
_CAPITAL = np.array([chr(c).isupper() or chr(c).istitle() for c in range(1 << 16)])
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?:"]] = True


class Templates:
    """The template tokens of several texts: for each word its kind, its value's hash and its token's hash.

    either: a capitalised word that opens a sentence, which is literal here and may be a name. first and width: the words
    that a token is made of, one but for collapsed() ones; words: the tokens before that.
    """

    def __init__(self, data: np.ndarray, offs: np.ndarray) -> None:
        words = Words(data, offs)
        self.at, n = words.at, len(words)
        self.words = self
        if not n:
            self.kind, self.value, self.token = np.zeros(0, np.int8), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
            self.opens = self.either = np.zeros(0, bool)
            self.first = self.width = np.zeros(0, np.int64)
            return
        opens = np.zeros(n, bool)  # the first word of a sentence, line or text
        opens[1:] = _STOP[data[words.end[:-1] - 1]] | (data[words.start[1:] - 1] == 10)
        opens[self.at[:-1][np.diff(self.at) > 0]] = True
        # Without the punctuation around it; a word of punctuation alone stays as it is.
        solid = np.flatnonzero(~_MARK[data])
        low, high = np.searchsorted(solid, words.start), np.searchsorted(solid, words.end)
        some = low < high
        words.start[some] = solid[low[some]]
        words.end[some] = solid[high[some] - 1] + 1
        number, distinct = words.codes(lower=True)
        self.value = light_hashes(distinct)[number]
        count = lambda table: np.append(0, np.cumsum(table[data], dtype=np.int64))
        digits, numeric = count(_DIGIT), count(_NUMERIC)
        size = words.end - words.start
        here = digits[words.end] - digits[words.start]
        first = data[words.start]
        upper = _CAPITAL[_codepoints(data, words.start)]
        self.kind = np.zeros(n, np.int8)
        self.kind[upper & ~opens] = NAME
        # 12, 1,200.50, 3/4, 12:30; and 12kg, 3rd: what begins with a digit.
        self.kind[((here > 0) & (numeric[words.end] - numeric[words.start] == size)) | _DIGIT[first]] = NUMBER
        behind = np.append(False, self.kind[:-1] == NUMBER) & ~opens
        self.kind[behind & np.isin(self.value, _unit_hashes())] = UNIT
        self.token = np.where(self.kind == LITERAL, self.value, _KIND[self.kind])
        self.opens, self.either = opens, upper & (self.kind == LITERAL)
        self.first, self.width = np.arange(n), np.ones(n, np.int64)

    def collapsed(self, openers: bool) -> Templates:
        """The same texts with each run of names, and each number with its unit, as one token. openers: a run may begin with a word that opens a sentence."""
        out = Templates.__new__(Templates)
        out.words = self
        name = self.kind == NAME
        before = np.append(False, (name | self.either if openers else name)[:-1])
        out.first = np.flatnonzero(~((name & before & ~self.opens) | (self.kind == UNIT)))
        out.at = np.searchsorted(out.first, self.at)
        out.width = np.diff(np.append(out.first, len(self.kind)))
        one = out.width == 1
        out.kind, out.value, out.opens = self.kind[out.first], self.value[out.first], self.opens[out.first]
        out.either = self.either[out.first] & one
        out.kind[~one & (out.kind == LITERAL)] = NAME
        if not one.all():
            place = (np.arange(len(self.kind)) - np.repeat(out.first, out.width)) % len(_GRAM)
            with np.errstate(over="ignore"):
                out.value = np.where(one, out.value, mix(np.add.reduceat(self.value * _GRAM[place], out.first)))
        out.token = np.where(out.kind == LITERAL, out.value, _KIND[out.kind])
        return out

    def windows(self, size: int, literals: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(first token, hash) of windows of size tokens inside one text, in parts.

        Those with at least so many literals, in each reading of their `either` words that leaves so many; and those of single words
        that are not all literal by the words themselves. Of collapsed tokens only windows with a run, as the others are windows of words.
        """
        n = len(self.token) - size + 1
        if n <= 0:
            return
        count = lambda x: (c := np.append(0, np.cumsum(x)))[size:] - c[:n]
        plain, open_ = count(self.kind == LITERAL), count(self.either)
        inside = np.arange(n) + size <= np.repeat(self.at[1:], np.diff(self.at))[:n]
        if self.words is not self:
            inside &= count(self.width > 1) > 0
        done = lambda x: mix(mix(x) + np.uint64(size))
        sums = _sums(self.token, size)
        fits = inside & (plain >= literals)
        where = np.flatnonzero(fits & (open_ == 0))
        yield where, done(sums[where])
        some = np.flatnonzero(fits & (open_ > 0))
        for a in range(0, len(some), AT_ONCE):
            where = some[a : a + AT_ONCE]
            value, left = sums[where], plain[where]
            for i in range(size):
                more = np.flatnonzero(self.either[where + i] & (left > literals))
                with np.errstate(over="ignore"):
                    other = value[more] + (_KIND[NAME] - self.value[where[more] + i]) * _GRAM[i]
                where, value, left = np.append(where, where[more]), np.append(value, other), np.append(left, left[more] - 1)
            yield where, done(value)
        if self.words is self:
            where = np.flatnonzero(inside & (plain < size))
            yield where, done(_sums(self.value, size)[where])


def _codepoints(data: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The codepoints of UTF-8 at these places; 0 for those beyond the first plane."""
    byte = [data[np.minimum(start + k, len(data) - 1)].astype(np.int64) for k in range(3)]
    two, three = (byte[0] & 31) << 6 | byte[1] & 63, (byte[0] & 15) << 12 | (byte[1] & 63) << 6 | byte[2] & 63
    return np.select([byte[0] < 0x80, byte[0] < 0xE0, byte[0] < 0xF0], [byte[0], two, three], 0)


def _sums(h: np.ndarray, k: int) -> np.ndarray:
    n = len(h) - k + 1
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            out += h[i : i + n] * _GRAM[i]
    return out


def _unit_hashes() -> np.ndarray:
    return light_hashes(pa.array([w.encode() for w in UNITS], pa.large_binary()))


class Benchmark:
    """A block of items and the sorted hashes of their windows."""

    def __init__(self, ids: list, texts: list[str], size: int, cover: int) -> None:
        self.ids, self.size = ids, size
        data, offs = string_bytes(pa.array(texts, pa.string()))
        self.items = t = Templates(data, offs)
        self.runs = [t.collapsed(False), t.collapsed(True)]
        self.words = np.diff(t.at)
        self.need = np.minimum(self.words, cover)
        # Items shorter than a window are one window of their own length; of those shorter than two, one half is whole if a word is added.
        hashes, starts, sizes, runs = [], [], [], []
        every: set[int] = set()
        for view in (t, *self.runs):
            tokens = np.diff(view.at)
            own = np.where(self.words < size, tokens, np.minimum(tokens, np.clip((self.words + 1) // 2, 3, size)))
            own[(self.words < 3) | (tokens < 3)] = 0
            for n in sorted({int(x) for x in own if x}):
                every.add(n)
                for where, h in view.windows(n, (n + 1) // 2):
                    ours = own[np.searchsorted(view.at, where, side="right") - 1] == n
                    hashes.append(h[ours])
                    starts.append(view.first[where[ours]])
                    sizes.append(np.full(int(ours.sum()), n))
                    runs.append(np.full(int(ours.sum()), view is not t))
        self.sizes = sorted(every)
        if not hashes:
            hashes, starts, sizes, runs = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
        order = np.argsort(np.concatenate(hashes), kind="stable")
        self.hash, self.start, self.length, self.run = (np.concatenate(x)[order] for x in (hashes, starts, sizes, runs))
        self.item = np.searchsorted(t.at, self.start, side="right") - 1
        self.mark = np.zeros(1 << 20, bool)
        self.mark[(self.hash & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def hits(self, texts: Templates, views: list[Templates]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word of a window of the texts, row of the benchmark's window, whether either is made of runs) for all equal pairs."""
        words, rows, runs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
        for view in (texts, *views):
            for n in self.sizes:
                for where, h in view.windows(n, (n + 1) // 2):
                    some = self.mark[(h & np.uint64((1 << 20) - 1)).astype(np.int64)]
                    where, h = view.first[where[some]], h[some]
                    low, high = np.searchsorted(self.hash, h), np.searchsorted(self.hash, h, side="right")
                    count = high - low
                    row = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
                    words.append(np.repeat(where, count))
                    rows.append(row)
                    runs.append(self.run[row] | (view is not texts))
        return np.concatenate(words), np.concatenate(rows), np.concatenate(runs)

    def leaks(self, texts: Templates, consistency: float) -> dict[int, list[tuple]]:
        """For each text with leaks: (item, its covered words, its words, consistency, first word in the text)."""
        views = [texts.collapsed(False), texts.collapsed(True)]
        word, row, run = self.hits(texts, views)
        if not len(word):
            return {}
        best: dict[tuple[int, int], tuple] = {}
        unsure: dict[tuple[int, int], list[tuple]] = {}
        if not run.all():
            self._diagonals(texts, word[~run], row[~run], consistency, best, unsure)
        self._gapped(texts, views, word, row, consistency, best, unsure)
        out: dict[int, list[tuple]] = {}
        for (t, i), (c, sure, at) in sorted(best.items()):
            out.setdefault(t, []).append((self.ids[i], c, int(self.words[i]), sure, -at))
        return out

    def _diagonals(self, texts: Templates, word: np.ndarray, row: np.ndarray, consistency: float, best: dict, unsure: dict) -> None:
        """Adds the best consistent alignment of each text and item on one diagonal to best, and all others that cover enough to unsure."""
        text = np.searchsorted(texts.at, word, side="right") - 1
        item, start = self.item[row], self.start[row]
        shift = word - start
        order = np.lexsort((start, shift, item, text))
        text, item, start, shift, length = (x[order] for x in (text, item, start, shift, self.length[row]))
        new = np.append(True, (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (shift[1:] != shift[:-1]))
        adds = np.where(np.append(new[1:], True), length, np.minimum(length, np.append(start[1:], 0) - start))
        first = np.flatnonzero(new)
        covered = np.add.reduceat(adds, first)
        for k in np.flatnonzero(covered >= self.need[item[first]]).tolist():
            a = first[k]
            b = first[k + 1] if k + 1 < len(first) else len(text)
            places = np.unique(np.concatenate([np.arange(s, s + n) for s, n in zip(start[a:b].tolist(), length[a:b].tolist(), strict=True)]))
            sure = _consistent(self.items, places, texts, places + shift[a])
            key = int(text[a]), int(item[a])
            if sure < consistency:
                unsure.setdefault(key, []).append((int(covered[k]), sure, int(places[0] + shift[a]), int(places[-1] + shift[a])))
            else:
                found = (int(covered[k]), sure, -int(start[a] + shift[a] - texts.at[key[0]]))
                best[key] = max(best.get(key, found), found)

    def _gapped(self, texts: Templates, views: list[Templates], word: np.ndarray, row: np.ndarray, consistency: float, best: dict, unsure: dict) -> None:
        """Adds alignments of runs with gaps, where a text and item have no other. One that is not consistent rules out those over the same words that cover less."""
        text = np.searchsorted(texts.at, word, side="right") - 1
        item, start = self.item[row], self.start[row]
        order = np.lexsort((start, word - start, item, text))
        text, item, start, word = text[order], item[order], start[order], word[order]
        shift = word - start
        new = np.append(True, (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (shift[1:] != shift[:-1]))
        found: dict[tuple[int, int], list[tuple]] = {}
        for t, i, s, w in zip(*(x[new].tolist() for x in (text, item, start, word)), strict=True):
            if (t, i) in best:
                continue
            for ours, theirs in zip(self.runs, views, strict=True):
                x, y = _aligned(ours, i, s, theirs, t, w)
                covered = int(ours.width[x].sum())
                if covered >= self.need[i]:
                    last = int(theirs.first[y[-1]] + theirs.width[y[-1]] - 1)
                    found.setdefault((t, i), []).append((covered, _consistent(ours, x, theirs, y), int(theirs.first[y[0]]), last))
        for key, some in found.items():
            held: list[tuple] = []
            for this in sorted({*some, *unsure.get(key, ())}, key=lambda x: (-x[0], -x[1], x[2])):
                if not any(this[2] <= o[3] and o[2] <= this[3] for o in held):
                    held.append(this)
                    if this[1] >= consistency:
                        best[key] = *this[:2], -(this[2] - int(texts.at[key[0]]))
                        break


def _consistent(ours: Templates, x: np.ndarray, theirs: Templates, y: np.ndarray) -> float:
    """The share of slots' values at x that stand for one value at y, and of names and units at y for one at x, whichever is less.

    Two numbers of an item may become equal, two names may not. An opening word is a slot if it differs or has a slot's value. Runs of as many words are taken word by word, others whole, but for an opening word that both begin with.
    """
    pairs, openers, numbers = set(), set(), set()
    words, others = ours.words, theirs.words
    for i, n, j, m in zip(ours.first[x].tolist(), ours.width[x].tolist(), theirs.first[y].tolist(), theirs.width[y].tolist(), strict=True):
        if n != m and min(n, m) > 1 and words.either[i] and words.value[i] == others.value[j]:
            openers.add(((int(words.value[i]),),) * 2)
            i, n, j, m = i + 1, n - 1, j + 1, m - 1
        a, b = words.value[i : i + n].tolist(), others.value[j : j + m].tolist()
        if n != m:
            pairs.add((tuple(a), tuple(b)))
            continue
        for k in range(n):
            if words.kind[i + k] != LITERAL or a[k] != b[k]:
                pairs.add(((a[k],), (b[k],)))
                if words.kind[i + k] == NUMBER:
                    numbers.add(((a[k],), (b[k],)))
            elif words.either[i + k]:
                openers.add(((a[k],), (b[k],)))
    values = {v for v, _ in pairs}
    pairs |= {p for p in openers if p[0] in values}
    named = pairs - numbers
    back = len({v for _, v in named}) / len(named) if named else 1.0
    return min(len(values) / len(pairs), back) if pairs else 1.0


def _aligned(ours: Templates, item: int, start: int, theirs: Templates, text: int, word: int) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of an item and of a text that fit, on both sides of a word of each."""
    i, j = (int(np.searchsorted(v.first, w, side="right")) - 1 for v, w in ((ours, start), (theirs, word)))
    low, high = int(ours.at[item]), int(ours.at[item + 1])
    reach = GAP * (high - low)
    far = slice(max(int(theirs.at[text]), j - (i - low) - reach), min(int(theirs.at[text + 1]), j + high - i + reach))
    a, b = ([*zip(v.value[k].tolist(), np.where(v.either[k], NAME, v.kind[k]).tolist(), strict=True)] for v, k in ((ours, slice(low, high)), (theirs, far)))
    right = _walk(a[i - low :], b[j - far.start :])
    left = _walk(a[: i - low][::-1], b[: j - far.start][::-1])
    both = [(i - 1 - x, j - 1 - y) for x, y in reversed(left)] + [(i + x, j + y) for x, y in right]
    return np.array([x for x, _ in both], np.int64), np.array([y for _, y in both], np.int64)


def _walk(a: list[tuple], b: list[tuple]) -> list[tuple[int, int]]:
    """Places that fit from the start on, over gaps; as far as half of them have equal values."""

    def fits(x: tuple, y: tuple) -> bool:
        return x[0] == y[0] or (x[1] == y[1] != LITERAL)

    def resumes(i: int, j: int) -> bool:
        n = min(RESUME, len(a) - i)
        if n < 1 or j + n > len(b):
            return False
        return all(fits(a[i + k], b[j + k]) for k in range(n)) and 2 * sum(a[i + k][0] == b[j + k][0] for k in range(n)) >= n

    gaps = sorted(((x, y) for x in range(GAP + 1) for y in range(GAP + 1) if x or y), key=sum)
    out, equal, good, i, j = [], 0, 0, 0, 0
    while i < len(a) and j < len(b):
        if not fits(a[i], b[j]):
            gap = next(((x, y) for x, y in gaps if resumes(i + x, j + y)), None)
            if gap is None:
                break
            i, j = i + gap[0], j + gap[1]
        out.append((i, j))
        equal += a[i][0] == b[j][0]
        good = len(out) if 2 * equal >= len(out) else good
        i, j = i + 1, j + 1
    return out[:good]


_LEAK = "struct<item_id:{kind},covered:int,words:int,consistency:double,at:int>"


def with_leaks(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
    size: int = 8, cover: int = 13, consistency: float = 0.8, block_bytes: int = 8 << 20,
) -> DataFrame:
    """docs with leaks, an array of (item_id, covered, words, consistency, at) by item_id: the benchmark items that each text holds.

    An item counts if windows of `size` template tokens, half of them literal, or of equal words cover at least `cover` of its words, or all of a shorter one's, in one
    alignment, and the values of its slots are consistent to the asked share. Items under three words and null or empty ones match nothing, nor do null or
    empty texts. A column leaks is replaced; names that begin with _lf_ are taken.

    A benchmark of at most block_bytes of text is broadcast, and windows are looked up there by hash. The windows of a larger one are a table that the
    documents' windows are joined with by hash; both give the same rows.
    """
    items = benchmark.select(F.col(item).alias("item_id"), F.col(item_text).alias("text")).where("text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    how = (text, size, cover, consistency)
    if total > block_bytes:
        return _joined(docs.drop("leaks"), items, math.ceil(total / block_bytes), *how)
    rows = docs.drop("leaks")
    leak = f"array<{_LEAK.format(kind=items.schema['item_id'].dataType.simpleString())}>"
    found = items.collect()
    if not found:
        return rows.withColumn("leaks", F.array().cast(leak))
    held = rows.sparkSession.sparkContext.broadcast(([r[0] for r in found], [r[1] for r in found]))
    out = rows.mapInArrow(lean(_search(held, to_arrow_type(items.schema["item_id"].dataType), *how)), extended(rows.schema, f"leaks {leak}"))
    return out.withColumn("leaks", F.sort_array("leaks"))


def _leak_arrays(rows: list[list[tuple]], item_id: pa.DataType) -> pa.Array:
    fields = [("item_id", item_id), ("covered", pa.int32()), ("words", pa.int32()), ("consistency", pa.float64()), ("at", pa.int32())]
    return pa.array([[dict(zip((k for k, _ in fields), x, strict=True)) for x in row] for row in rows], pa.list_(pa.struct(fields)))


def _search(held, item_id: pa.DataType, text: str, size: int, cover: int, consistency: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Benchmark(*held.value, size, cover)
        for batch in batches:
            data, offs = string_bytes(batch.column(text))
            for i, j in pieces(offs):
                got = block.leaks(Templates(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]), consistency)
                leaks = _leak_arrays([got.get(k, []) for k in range(j - i)], item_id)
                yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns, leaks], [*batch.schema.names, "leaks"])

    return run


def _joined(rows: DataFrame, items: DataFrame, blocks: int, text: str, size: int, cover: int, consistency: float) -> DataFrame:
    """with_leaks by a join of windows.

    Documents' windows pass a Bloom filter of the items' windows, of at most 2^FILTER bits, and meet them in a join salted on both
    sides, which tells the pairs of a document and an item that share a window. Pairs meet with both texts in groups of a document
    and a block of items, so that a task holds one text and one block.
    """
    kind = items.schema["item_id"].dataType.simpleString()
    items = items.withColumn("item", F.monotonically_increasing_id())
    items = saved(items.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks))), "items")
    windows = saved(items.select("item", "text").mapInArrow(lean(_item_windows(size, cover)), "hash long, item long, size int"), "item-windows")
    sizes = sorted(r["size"] for r in windows.select("size").distinct().collect())
    bits = min(FILTER, max(20, (16 * windows.count()).bit_length()))
    spots = [F.shiftrightunsigned("hash", by).bitwiseAND(F.lit((1 << bits) - 1)) for by in PROBES]
    word = windows.select(F.explode(F.array(*spots)).alias("spot")).select(F.shiftright("spot", 6).alias("at"), F.expr("shiftleft(1L, cast(spot & 63 as int))").alias("bit"))
    got = word.groupBy("at").agg(F.bit_or("bit").alias("word")).toPandas()
    held = np.zeros(1 << (bits - 6), np.uint64)
    held[got["at"].to_numpy().astype(np.int64)] = got["word"].to_numpy().astype(np.int64).view(np.uint64)
    held = rows.sparkSession.sparkContext.broadcast(held)

    rows = rows.withColumn("_lf_row", F.monotonically_increasing_id())
    marked = saved(rows.mapInArrow(lean(_text_windows(held, text, sizes)), extended(rows.schema, "_lf_hits array<bigint>")), "window-hits")
    some = marked.where(F.size("_lf_hits") > 0)
    salt, salts = F.pmod(F.xxhash64("_lf_row"), F.lit(SALTS)).alias("salt"), F.explode(F.expr(f"sequence(0L, {SALTS - 1}L)")).alias("salt")
    ours = some.select("_lf_row", salt, F.explode("_lf_hits").alias("hash"))
    pairs = ours.join(windows.select("hash", "item", salts), ["hash", "salt"]).select("_lf_row", "item").distinct()
    sided = pairs.select("_lf_row", "item", salt).join(items.select("*", salts), ["item", "salt"])
    sided = saved(sided.select("_lf_row", "block", "item_id", "text", F.lit(False).alias("doc")), "pairs")
    texts = some.select("_lf_row", F.col(text).alias("text")).join(sided.select("_lf_row", "block").distinct(), "_lf_row")
    both = sided.union(texts.select("_lf_row", "block", F.lit(None).cast(kind), "text", F.lit(True)))
    leak = f"array<{_LEAK.format(kind=kind)}>"
    item_id = to_arrow_type(items.schema["item_id"].dataType)

    def settle(table: pa.Table) -> pa.RecordBatch | None:
        doc = table.column("doc")
        data, offs = string_bytes(table.column("text").filter(doc))
        own = table.filter(pc.invert(doc))
        block = Benchmark(own.column("item_id").to_pylist(), own.column("text").to_pylist(), size, cover)
        got = block.leaks(Templates(data, offs), consistency).get(0)
        return got and pa.RecordBatch.from_arrays([table.column("_lf_row").combine_chunks()[:1], _leak_arrays([got], item_id)], ["_lf_row", "leaks"])

    found = in_groups(both, ["_lf_row", "block"], settle, f"_lf_row long, leaks {leak}")
    found = found.groupBy("_lf_row").agg(F.sort_array(F.flatten(F.collect_list("leaks"))).alias("leaks"))
    none = F.array().cast(leak)
    names = [c for c in marked.columns if c not in ("_lf_row", "_lf_hits")]
    with_some = some.join(found, "_lf_row", "left").select(*names, F.coalesce("leaks", none).alias("leaks"))
    return marked.where(F.size("_lf_hits") == 0).select(*names, none.alias("leaks")).union(with_some)


def _item_windows(size: int, cover: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offs = string_bytes(batch.column("text"))
            for i, j in pieces(offs):
                part = batch.slice(i, j - i)
                block = Benchmark([], part.column("text").to_pylist(), size, cover)
                key = np.unique(np.stack([block.hash, block.item.astype(np.uint64), block.length.astype(np.uint64)], axis=1), axis=0)
                item = part.column("item").to_numpy()[key[:, 1].astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(key[:, 0]).view(np.int64)), pa.array(item), pa.array(key[:, 2].astype(np.int32))], ["hash", "item", "size"])

    return run


def _text_windows(held, text: str, sizes: list[int]):
    """Rows with _lf_hits: the distinct hashes of the text's windows that pass the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = held.value
        keep = np.uint64(64 * len(words) - 1)

        def passes(h: np.ndarray) -> np.ndarray:
            out = np.ones(len(h), bool)
            for by in PROBES:
                spot = (h >> np.uint64(by)) & keep
                out &= (words[(spot >> np.uint64(6)).astype(np.int64)] >> (spot & np.uint64(63))) & np.uint64(1) > 0
            return out

        for batch in batches:
            data, offs = string_bytes(batch.column(text))
            for i, j in pieces(offs):
                texts = Templates(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                at, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
                for view in (texts, texts.collapsed(False), texts.collapsed(True)):
                    for n in sizes:
                        for where, h in view.windows(n, (n + 1) // 2):
                            some = passes(h)
                            at.append(np.searchsorted(view.at, where[some], side="right") - 1)
                            hashes.append(h[some])
                at, h = np.concatenate(at), np.concatenate(hashes)
                order = np.lexsort((h, at))
                at, h = at[order], h[order]
                new = np.append(True, (at[1:] != at[:-1]) | (h[1:] != h[:-1]))[: len(at)]
                at, h = at[new], h[new]
                cuts = np.searchsorted(at, np.arange(j - i + 1)).astype(np.int32)
                hits = pa.ListArray.from_arrays(pa.array(cuts), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns, hits], [*batch.schema.names, "_lf_hits"])

    return run


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and benchmark item that it holds."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = with_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", F.inline("leaks")).select("doc_id", "item_id", F.col("covered").alias("covered_words"), F.col("words").alias("item_words"), "consistency", F.col("at").alias("first_word"))
