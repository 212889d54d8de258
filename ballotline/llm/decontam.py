"""Benchmark decontamination by template canonicalisation.

Words are brought to a template: numbers, names and units become typed placeholders; case and
outer punctuation go. A name is a capitalised word inside a sentence (also "IBM" or "McDonald"; runs of three words in capitals are
shouted, not names), at a sentence's start one that isn't a usual first word. Short or ambiguous units ("in", "m") are units only after a number. Windows
of five template words, with at least two words that are no placeholders, are hashed
and joined with the benchmark's windows. A document holds an item if at least 0.8 of
the item's windows stand close together in it and its slots are consistent: wherever
the windows match (of repeated ones, as they are best aligned), one value of the item's slots always answers to one and the same
value in the text, and the other way round. So a question asked again with other numbers or names is
caught, and a text that only happens to share phrases isn't.

Items without a countable window, and those of under five words, are also looked up as they
stand: by windows of five words in folded case, operators among them, or of all their words if
they have fewer. An item of one word isn't, and one without letters and digits is none.

A benchmark of at most ``BROADCAST_WINDOWS`` words (some MB) goes to the tasks as sorted arrays: texts are read once and not
shuffled. A larger one is joined by hash: an item is held only if one of its rarest fifth of windows (and one more)
is there, so only those are looked up; the texts' windows pass a bit filter of the benchmark's (8 MB), meet them by a
shuffle, and the few documents that share one are compared in full with the items that they share it with.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Table, map_arrow

WINDOW = 5
SIMILAR = 0.8
LITERALS = 2
#: Most words of a benchmark that is broadcast.
BROADCAST_WINDOWS = 200_000
_NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*(?:st|nd|rd|th|%|e\d+)?", re.I)
_NUMBER_WORDS = frozenset("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen".split())
_UNITS = frozenset("mm cm km ft yd inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres kg mg lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces sec secs seconds minute minutes hour hours day days week weeks month months year years ml liter liters litre litres gallon gallons mph kmh km/h m/s kg/m3 percent degree degrees celsius fahrenheit dollar dollars cent cents euro euros usd eur gbp volt volts watt watts kw kwh hz khz mhz ghz joule joules newton newtons pascal kpa".split())
#: Units only after a number.
_LOOSE_UNITS = frozenset("m in mi g s second l pa mol c f k t h min a v w j n".split())
#: Usual first words of sentences, which are no names there.
_STARTERS = frozenset(
    "a an the this that these those there here it he she they we i you one some any all each every both many most few no not if when while after before since because although as at by for from in into of on "
    "to with without and or but so then now what which who whom whose why where how is are was were do does did has have had can could will would should may must let find solve calculate compute "
    "determine suppose given consider his her its their our my your der die das ein eine ist sind und in im wenn wie was wer wo le la les un une des est sont et si que qui el los las uno una es son y en por para con".split()
)
_CACHE = 1 << 19
_BITS = 16
#: Bits of a window hash that the filter of a large benchmark tells apart.
_FILTER_BITS = 26


_OUTER = "\"'`´’‘“”„«»()[]{}<>.,;:!?¡¿…*#&|~^_=\\/-—–"
_LINE = "\0"


_OPERATORS = frozenset("+-*/=<>^×÷−±≤≥≠")


def _literal(raw: str) -> str:
    """A raw word in folded case without outer punctuation, or an operator; else nothing."""
    return raw.strip(_OUTER).casefold() or (raw if _OPERATORS.issuperset(raw) else "")


def _hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))


_H_NUMBER, _H_NAME, _H_UNIT = (np.uint64(_hash(x)) for x in ("<number>", "<name>", "<unit>"))


class _Forms(dict):
    """Raw words to numbers, by which ``low`` gives their hashes in lower case, ``same`` those of ``_literal`` and ``flags`` what they are."""

    ENDS, NAME, FIRST_NAME, WORD, LITERAL, NUMBER, UNIT, LOOSE_UNIT, CAPITALS = (1 << k for k in range(9))

    def __init__(self) -> None:
        self._sized(_CACHE)

    def _sized(self, n: int) -> None:
        self.clear()
        self.low, self.same, self.flags = np.zeros(n, np.uint64), np.zeros(n, np.uint64), np.zeros(n, np.uint16)

    def numbers(self, raw: list[str]) -> np.ndarray:
        """Forgets all words first if those of a text could be too many for what is held."""
        if len(self) + len(raw) > len(self.low):
            self._sized(max(_CACHE, len(raw)))
        return np.fromiter(map(self.__getitem__, raw), np.int64, len(raw))

    def __missing__(self, raw: str) -> int:
        k = self[raw] = len(self)
        flags = self.ENDS if raw == _LINE or raw.rstrip("\"'’”»)]*#&%$|_~")[-1:] in (".", "!", "?", ":") else 0
        word = raw.strip(_OUTER)
        low = word.lower()
        if raw != _LINE and (same := _literal(raw)):
            flags |= self.LITERAL
            self.same[k] = _hash(same)
        if word and (low.isalpha() or any(c.isalnum() for c in word)):
            flags |= self.WORD
            self.low[k] = _hash(low)
            if low in _NUMBER_WORDS or (not low.isalpha() and _NUMBER.fullmatch(word)):
                flags |= self.NUMBER
            elif low in _UNITS:
                flags |= self.UNIT
            else:
                flags |= self.LOOSE_UNIT * (low in _LOOSE_UNITS)
                if word[0].isupper() and low != "i":
                    flags |= self.NAME | self.FIRST_NAME * (low not in _STARTERS)
            flags |= self.CAPITALS * (word == word.upper() != low)
        self.flags[k] = flags
        return k


def literals(text: str | None, forms: _Forms) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(words and operators in folded case, their hashes, how many of the template's words stand before each)."""
    raw = (text or "").replace("\n", f" {_LINE} ").split()
    if not raw:
        return [], np.empty(0, np.uint64), np.empty(0, int)
    k = forms.numbers(raw)
    flags = forms.flags[k]
    at = np.flatnonzero(flags & forms.LITERAL)
    before = np.cumsum((flags & forms.WORD) != 0) - ((flags & forms.WORD) != 0)
    return [_literal(raw[j]) for j in at.tolist()], forms.same[k][at], before[at]


def template(text: str | None, forms: _Forms) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(words as they are, their template hashes, which are placeholders). Null and wordless texts: none."""
    raw = (text or "").replace("\n", f" {_LINE} ").split()
    if not raw:
        return [], np.empty(0, np.uint64), np.empty(0, bool)
    k = forms.numbers(raw)
    flags = forms.flags[k]
    start = np.empty(len(raw), bool)
    start[0], start[1:] = True, (flags[:-1] & forms.ENDS) != 0
    word = np.flatnonzero(flags & forms.WORD)
    flags, start, h = flags[word], start[word], forms.low[k[word]]
    number, name = (flags & forms.NUMBER) != 0, (flags & np.where(start, forms.FIRST_NAME, forms.NAME).astype(np.uint16)) != 0
    loud = (flags & forms.CAPITALS) != 0
    if (three := loud[:-2] & loud[1:-1] & loud[2:]).any():
        for j in range(3):
            name[j : len(name) - 2 + j] &= ~three
    name &= len(word) > 1  # a text of one word is that word
    unit = (flags & forms.UNIT) != 0
    unit[1:] |= ((flags[1:] & forms.LOOSE_UNIT) != 0) & number[:-1]
    h[name], h[unit], h[number] = _H_NAME, _H_UNIT, _H_NUMBER
    return [raw[j] for j in word.tolist()] if len(word) < len(raw) else raw, h, number | name | unit


def _hashed(h: np.ndarray, n: int) -> np.ndarray:
    """The hash of the window of ``n`` words at each place."""
    out = np.full(max(len(h) - n + 1, 0), n, np.uint64)
    for k in range(n):
        out = (out ^ h[k : k + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def windows(h: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the window at each place, may it count); texts under five words have one window of all their words."""
    n = min(WINDOW, len(h))
    if not n:
        return np.empty(0, np.uint64), np.empty(0, bool)
    out, free = _hashed(h, n), np.zeros(len(h) - n + 1, int)
    for k in range(n):
        free += ~slot[k : k + len(out)]
    return out, free >= min(LITERALS, n)


def _value(raw: str) -> str:
    return raw.strip(_OUTER).lower()


def _stretch(found: list[tuple[int, int]], w: np.ndarray, span: int) -> tuple[int, list[tuple[int, int]]]:
    """(different windows, pairs) of the stretch of at most ``span`` words that holds most windows; found: (place in the text, place in the item), sorted."""
    n, lo, best, where = defaultdict(int), 0, 0, (0, 0)
    for hi, (p, _) in enumerate(found):
        n[w[p]] += 1
        while p - found[lo][0] > span:
            old = w[found[lo][0]]
            n[old] -= 1
            if not n[old]:
                del n[old]
            lo += 1
        if len(n) > best:
            best, where = len(n), (lo, hi)
    return best, found[where[0] : where[1] + 1]


def _aligned(part: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The pairs by which slots are judged: one item place for a text place, and the other way round.

    Where windows repeat, the best chain of pairs that rises in both places counts (a pair
    counts one, and one more if it follows on the diagonal of the one before); pairs
    outside it only if neither place occurs in it and the text place has no other pair.
    """
    texts, items = defaultdict(int), defaultdict(int)
    for p, q in part:
        texts[p] += 1
        items[q] += 1
    if len(texts) == len(part) == len(items):
        return part
    pairs = sorted(part, key=lambda x: (x[0], -x[1]))
    ranks = {q: r for r, q in enumerate(sorted(items), 1)}
    tree: list[tuple[int, int]] = [(0, -1)] * (len(ranks) + 1)  # best (score, pair) up to a rank, as a Fenwick tree
    last: dict[int, tuple[int, int]] = {}
    back, top = [-1] * len(pairs), (0, -1)
    for k, (p, q) in enumerate(pairs):
        # of one text place the later item places come first, so none follows another
        r, before = ranks[q] - 1, (0, -1)
        while r:
            before = max(before, tree[r])
            r &= r - 1
        if q - p in last and (same := last[q - p])[0] + 1 >= before[0]:
            before = (same[0] + 1, same[1])
        now, back[k] = (before[0] + 1, k), before[1]
        last[q - p], top, r = now, max(top, now), ranks[q]
        while r < len(tree):
            tree[r] = max(tree[r], now)
            r += r & -r
    chain, k = [], top[1]
    while k >= 0:
        chain.append(pairs[k])
        k = back[k]
    in_text, in_item = {p for p, _ in chain}, {q for _, q in chain}
    return sorted([*chain, *((p, q) for p, q in part if texts[p] == 1 and p not in in_text and q not in in_item)])


class Items:
    """A block of benchmark items, ready to be looked up."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        forms, keys, at = _Forms(), [], []
        self.ids, self.words, self.slots, self.size = [], [], [], []
        self.literal: dict[int, tuple[list[str], int]] = {}  # item: (words, windows)
        self.places: dict[int, dict[int, list[tuple[int, int]]]] = {}  # words of a window: its hash: (item, place)
        for item, text in items:
            words, h, slot = template(text, forms)
            w, counts = windows(h, slot)
            k = len(self.ids)
            self.ids.append(item)
            self.words.append([_value(x) for x in words])
            self.slots.append(slot)
            self.size.append(len(np.unique(w[counts])))
            keys.append(w[counts])
            at.append(np.stack([np.full(counts.sum(), k), np.flatnonzero(counts)], 1))
            if 0 < len(words) < WINDOW or (len(words) and not counts.any()):
                words, h, _ = literals(text, forms)
                if len(words) > 1:
                    n = min(WINDOW, len(words))
                    w = _hashed(h, n).tolist()
                    self.literal[k] = words, len(set(w))
                    for q, x in enumerate(w):
                        self.places.setdefault(n, {}).setdefault(x, []).append((k, q))
        keys, at = np.concatenate([np.empty(0, np.uint64), *keys]), np.concatenate([np.empty((0, 2), int), *at])
        order = np.argsort(keys, kind="stable")
        self.keys, self.at = keys[order], at[order]
        self.literal_keys = {n: np.sort(np.fromiter(p, np.uint64, len(p))) for n, p in self.places.items()}
        self.bits = np.zeros(1 << _BITS, bool)
        self.bits[(self.keys >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def held_by(self, text: str | None, forms: _Forms) -> list[tuple[int, float, float, int]]:
        """(item, share of its windows, slot consistency, first word) of every item that a text holds in part."""
        words, h, slot = template(text, forms)
        w, counts = windows(h, slot)
        near = np.flatnonzero(self.bits[(w >> np.uint64(64 - _BITS)).astype(np.int64)] & counts)
        lo, hi = np.searchsorted(self.keys, w[near], "left"), np.searchsorted(self.keys, w[near], "right")
        hits = defaultdict(list)
        for p, a, b in zip(near[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist()):
            for item, q in self.at[a:b].tolist():
                hits[item].append((p, q))
        out = {k: self._best(k, found, words, w) for k, found in hits.items()}
        if self.places:
            for k, found in self._literal_held_by(text, forms).items():
                if k not in out or min(out[k][:2]) < min(found[:2]):
                    out[k] = found
        return [(self.ids[k], *found) for k, found in out.items()]

    def _literal_held_by(self, text: str | None, forms: _Forms) -> dict[int, tuple[float, float, int]]:
        """{item: (share of its literal windows, 1, first word)}."""
        words, h, before = literals(text, forms)
        out = {}
        for n, places in self.places.items():
            w, keys = _hashed(h, n), self.literal_keys[n]
            near = np.flatnonzero(keys[np.minimum(np.searchsorted(keys, w), len(keys) - 1)] == w)
            hits = defaultdict(list)
            for p in near.tolist():
                for k, q in places[int(w[p])]:
                    if words[p : p + n] == self.literal[k][0][q : q + n]:
                        hits[k].append((p, q))
            for k, found in hits.items():
                best, part = _stretch(found, w, len(self.literal[k][0]) * 3 // 2 + n)
                out[k] = best / self.literal[k][1], 1.0, int(before[part[0][0]])
        return out

    def _best(self, k: int, found: list[tuple[int, int]], words: list[str], w: np.ndarray) -> tuple[float, float, int]:
        """The stretch of at most 1.5 times the item's length that holds most of its windows."""
        best, part = _stretch(found, w, len(self.words[k]) * 3 // 2 + WINDOW)
        answers, asked = defaultdict(lambda: defaultdict(int)), defaultdict(lambda: defaultdict(int))
        seen = set()
        for p, q in _aligned(part):
            for j in range(min(WINDOW, len(self.words[k]))):
                if self.slots[k][q + j] and (p + j, q + j) not in seen:
                    seen.add((p + j, q + j))
                    mine, other = self.words[k][q + j], _value(words[p + j])
                    answers[mine][other] += 1
                    asked[other][mine] += 1
        agreed = min(sum(max(a.values()) for a in way.values()) for way in (answers, asked))
        return best / self.size[k], agreed / len(seen) if seen else 1.0, part[0][0]


_HIT = "item long, share double, consistency double, word long"


def _finder(items: Items):
    """(keys..., text) in; out the keys and a hit for each item that a text holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forms = _Forms()
        for b in batches:
            rows = [(k, *found) for k, text in enumerate(b.column(b.num_columns - 1).to_pylist()) for found in items.held_by(text, forms) if found[1] >= SIMILAR and found[2] >= SIMILAR]
            if rows:
                yield _hit_batch(b, b.num_columns - 1, rows)

    return run


def _hit_batch(b: pa.RecordBatch, keys: int, rows: list[tuple]) -> pa.RecordBatch:
    """The first ``keys`` columns of the rows meant by (row, item, share, consistency, word), and these."""
    at = pa.array([r[0] for r in rows], pa.int64())
    hits = [pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int64(), pa.float64(), pa.float64(), pa.int64()), 1)]
    return pa.RecordBatch.from_arrays([*(b.column(j).take(at) for j in range(keys)), *hits], names=[*b.schema.names[:keys], "item", "share", "consistency", "word"])


def _items(benchmark: DataFrame, item_col: str, text: str) -> DataFrame:
    return benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(text).alias("item_text")).where("item IS NOT NULL AND item_text IS NOT NULL").distinct()


def small(items: DataFrame, most: int | None = None) -> Items | None:
    """The benchmark's items (item, item_text), ready to be broadcast; None if they have more words than BROADCAST_WINDOWS."""
    most = BROADCAST_WINDOWS if most is None else most
    if (items.agg(F.sum(F.size(F.split("item_text", r"\s+")))).first()[0] or 0) > most:
        return None
    return Items(sorted((r.item, r.item_text) for r in items.collect()))


def _item_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item, item_text) in; out (item, which, kind, key, size): each window by which an item is found; kind 0: of its template, else literal ones of so many words; which: its text's hash; size: how many it has."""
    for b in batches:
        out = []
        for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            one, which = Items([(item, text)]), _hash(text)
            out += [(item, which, 0, int(x), one.size[0]) for x in np.unique(one.keys)]
            for n, places in one.places.items():
                out += [(item, which, n, x, len(places)) for x in places]
        if out:
            number = lambda j: pa.array(np.array([r[j] for r in out], np.uint64).view(np.int64))  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), number(1), pa.array([r[2] for r in out], pa.int32()), number(3), pa.array([r[4] for r in out], pa.int64())], names=["item", "which", "kind", "key", "size"])


def _bit_filter(keys: DataFrame) -> tuple[np.ndarray, list[int]]:
    """(which upper bits occur among the keys, packed; which kinds). What comes to the driver has a fixed size: eight filters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << _FILTER_BITS, bool)
        for b in batches:
            bits[b.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - _FILTER_BITS)] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["bits"])

    packed = np.zeros(1 << (_FILTER_BITS - 3), np.uint8)
    for r in map_arrow(keys.select("key").repartition(8), run, "bits binary").toLocalIterator():
        packed |= np.frombuffer(r.bits, np.uint8)
    return packed, sorted(r.kind for r in keys.select("kind").distinct().collect())


def _text_keys(packed: np.ndarray, kinds: list[int]):
    """(key1, key2, text) in; out (key1, key2, kind, key) of each different window that passes the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forms, bits = _Forms(), np.unpackbits(packed).view(bool)
        for b in batches:
            for k, text in enumerate(b.column(b.num_columns - 1).to_pylist()):
                for kind in kinds:
                    if kind:
                        w = _hashed(literals(text, forms)[1], kind)
                    else:
                        w, counts = windows(*template(text, forms)[1:])
                        w = w[counts]
                    w = np.unique(w[bits[w >> np.uint64(64 - _FILTER_BITS)]])
                    if len(w):
                        at = pa.array(np.full(len(w), k))
                        yield pa.RecordBatch.from_arrays([*(b.column(j).take(at) for j in range(b.num_columns - 1)), pa.array(np.full(len(w), kind, np.int32)), pa.array(w.view(np.int64))], names=[*b.schema.names[:-1], "kind", "key"])

    return run


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key1, key2, text, item, item_text) in, rows of a text together; out its hits."""
    forms = _Forms()
    for b in batches:
        n = b.num_columns
        texts, ids, asked = (b.column(j).to_pylist() for j in (n - 3, n - 2, n - 1))
        rows = [(k, *found) for k, (t, i, a) in enumerate(zip(texts, ids, asked)) for found in Items([(i, a)]).held_by(t, forms) if found[1] >= SIMILAR and found[2] >= SIMILAR]
        if rows:
            yield _hit_batch(b, n - 3, rows)


def _joined_hits(keyed: DataFrame, items: DataFrame) -> DataFrame:
    """Hits by a hash join of windows, for a benchmark of any size."""
    every = Table(map_arrow(items, _item_keys, "item long, which long, kind int, key long, size long"), "item-windows").df
    # 0.8 of an item's windows can't be in a text that has none of any fifth of them and one more: the rarest are looked up
    often = every.join(every.groupBy("kind", "key").agg(F.count("*").alias("often")), ["kind", "key"])
    rank = F.row_number().over(Window.partitionBy("item", "which", "kind").orderBy("often", "key"))
    rare = Table(often.withColumn("rank", rank).where(F.col("rank") <= F.floor(F.col("size") * (1 - SIMILAR) + 1e-9) + 1).select("item", "kind", "key").distinct(), "rare-windows").df
    names = [c for c in keyed.columns if c != "text"]
    schema = T.StructType([*keyed.drop("text").schema.fields, T.StructField("kind", T.IntegerType()), T.StructField("key", T.LongType())])
    met = map_arrow(keyed.select(*names, "text"), _text_keys(*_bit_filter(rare)), schema).join(rare, ["kind", "key"]).select(*names, "item").distinct()
    pairs = Table(met, "shared-windows").df
    on = [F.col(f"k.{n}").eqNullSafe(F.col(f"p.{n}")) for n in names]
    rows = keyed.alias("k").join(pairs.alias("p"), on).select(*[F.col(f"k.{n}").alias(n) for n in names], "k.text", "p.item").join(items, "item")
    return map_arrow(rows.select(*names, "text", "item", "item_text"), _verified, T.StructType([*keyed.drop("text").schema.fields, *T.StructType.fromDDL(_HIT).fields]))


def _hits(keyed: DataFrame, benchmark: DataFrame, item_col: str, text: str) -> DataFrame:
    """The keys of (keys..., text) with item, share, consistency and word of every item that a text holds."""
    items = _items(benchmark, item_col, text)
    if (found := small(items)) is None:
        return _joined_hits(keyed, Table(items, "items").df)
    names = [c for c in keyed.columns if c != "text"]
    return map_arrow(keyed.select(*names, "text"), _finder(found), T.StructType([*keyed.drop("text").schema.fields, *T.StructType.fromDDL(_HIT).fields]))


def _keys(id_col: Column, text: Column) -> list[Column]:
    """What tells documents apart: two hashes, of the id and of the text."""
    return [F.xxhash64(id_col).alias("key1"), F.xxhash64(F.lit(1), text).alias("key2")]


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", item_col: str = "item_id") -> DataFrame:
    """(id, item, share, consistency, word) of every item that a document holds; word: where it begins, from 0, in words.

    Ids may have any type that can be compared, items' ids are whole numbers. Null and empty texts hold nothing; items that are
    null, or without letters and digits, are ignored; repeated rows give repeated results; several items of equal text are all reported.
    """
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    return _hits(narrow, benchmark, item_col, "text").toDF(id_col, item_col, "share", "consistency", "word")


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", item_col: str = "item_id") -> DataFrame:
    """One row a document: (id, n_items, items, share, consistency, contaminated), items sorted, of the best one the figures.

    Documents are told apart by id and text; repeated rows get equal results, rows with a
    null id their own. Without items, share is 0 and consistency null.
    """
    ids = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    hits = Table(_hits(ids.select(*_keys(F.col("id"), F.col("text")), "text"), benchmark, item_col, "text"), "hits").df
    best = hits.groupBy("key1", "key2").agg(F.sort_array(F.collect_set("item")).alias("items"), F.max(F.struct("share", "consistency")).alias("b"))
    held = ids.select("id", *_keys(F.col("id"), F.col("text"))).join(best, ["key1", "key2"], "left")
    items = F.coalesce("items", F.array().cast("array<bigint>"))
    return held.select(F.col("id").alias(id_col), F.size(items).cast("long").alias("n_items"), items.alias("items"), F.coalesce("b.share", F.lit(0.0)).alias("share"), F.col("b.consistency").alias("consistency"), (F.size(items) > 0).alias("contaminated"))


def _clean(items: Items, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forms = _Forms()
        for b in batches:
            keep = [not any(f[1] >= SIMILAR and f[2] >= SIMILAR for f in items.held_by(t, forms)) for t in b.column(at).to_pylist()]
            yield b.filter(pa.array(keep, pa.bool_()))

    return run


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", item_col: str = "item_id") -> DataFrame:
    """The rows of ``docs``, all columns as they are, that hold no benchmark item.

    A benchmark that is broadcast is a filter, without a shuffle; of a larger one the hits are joined against the rows.
    """
    names = [f"c{k}" for k in range(len(docs.columns))]
    held = docs.toDF(*names)
    c_id, c_text = (names[docs.columns.index(c)] for c in (id_col, text))
    found = small(_items(benchmark, item_col, "text"))
    if found is not None:
        return map_arrow(held, _clean(found, docs.columns.index(text)), held.schema).toDF(*docs.columns)
    held = held.select(*names, *_keys(F.col(c_id), F.col(c_text)))
    hits = Table(_hits(held.select("key1", "key2", F.col(c_text).alias("text")), benchmark, item_col, "text").select("key1", "key2").distinct(), "hits").df
    return held.join(hits, ["key1", "key2"], "left_anti").select(*names).toDF(*docs.columns)
