"""Benchmark decontamination by templates.

Texts and benchmark items become templates: numbers, names and units turn into typed
placeholders, other words into lower case. A token is a run of letters, digits and
underscores (a point or comma between digits belongs to the number). A number starts
with a digit; a unit is one of ``UNITS`` after a number; a name is a word with a
capital first letter only. After a sentence end (``.!?:`` or a line end) and at the
beginning such a word is read in two ways, as a plain word and as a name, so that an
item is found whatever it was pasted after.

All windows of ``WINDOW`` tokens are joined on a hash. With ``LITERALS`` plain words at
least it is that of the template; with fewer, units are spelled out; if plain words and
units are fewer still, all words are, so that such a window is found as it stands. Hits
of one text and item on one alignment and in one way of reading either count together,
and each value in the item's placeholders must stand for one value of the text: a
question asked again with other numbers or names is caught, two of which may be equal
now, an unrelated text of the same shape is not. Windows next to each other that are
equal word by word and span ``SPAN`` tokens of the item are a leak whatever else stands
in the text; they report no slots. Otherwise a text is contaminated if
the hits on one alignment span ``SPAN`` tokens of the item, or the whole item if it is
shorter. Stretches of that length that hold windows dense in placeholders are joined as
a whole too if they have ``LITERALS`` plain words or units, so that dense questions are
caught with other values; with fewer, an item is caught only as it stands. Items of
fewer than ``WINDOW`` tokens are matched by one window of their own length.

Tasks that read texts get the hashes of the benchmark's windows and send on only
hits. Hashes are sent in slices of ``SLICE`` windows, one pass over the texts for
each slice, so what a task holds does not grow with the benchmark. Everything about
one text happens in its own task up to the hits, however many texts share an item.

Defined cases: a null text or item has no windows; each text is judged by itself, also
where texts share a doc_id or have none, and rows equal in both are one; equal items are
each reported; empty tables give an empty result; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martlet.llm.common import mix, pick, place
from martlet.llm.words import Sums, Words, _byte_codes, chunks

WINDOW, SPAN, LITERALS = 8, 13, 5
SLICE = 4_000_000
#: Unit words, in lower case.
UNITS = (
    "mm cm m km inch inches foot feet yard yards mile miles mg g gram grams kg kilogram kilograms ton tons lb lbs "
    "pound pounds oz ounce ounces ml l liter liters litre litres gallon gallons second seconds sec s minute minutes min "
    "hour hours h day days week weeks month months year years percent dollar dollars cent cents euro euros usd eur "
    "kmh mph kph hz khz mhz ghz w kw mw v volt volts watt watts joule joules kb mb gb tb degree degrees celsius fahrenheit"
).split()

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_STOP = np.zeros(256, bool)
_STOP[[10, 13, 33, 46, 58, 63]] = True


def _codes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix(Sums.of(_byte_codes(5)[_LOWER[data]]).stretch(start, end), 5)


def _unit_codes() -> np.ndarray:
    data = np.frombuffer(" ".join(UNITS).encode(), np.uint8)
    end = np.cumsum([len(u) + 1 for u in UNITS]) - 1
    return np.sort(_codes(data, end - [len(u) for u in UNITS], end))


def member(sorted_: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_):
        return np.zeros(len(x), bool)
    return sorted_[np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)] == x


@dataclass
class Template:
    """Tokens of many texts: template codes, codes with units spelled out, plain codes, and which are placeholders."""

    words: Words
    spelled: np.ndarray
    plain: np.ndarray
    slot: np.ndarray
    unit: np.ndarray

    @cached_property
    def sums(self) -> tuple[Sums, Sums, Sums]:
        return Sums.of(self.words.code), Sums.of(self.spelled), Sums.of(self.plain)


def template(data: np.ndarray, at: np.ndarray, units: np.ndarray) -> tuple[Template, Template]:
    """Both ways of reading: capitalised words after a stop are plain words, or names."""
    n = len(data)
    inside, digit = _WORD[data], _DIGIT[data]
    if n > 2:
        point = (data[1:-1] == 46) | (data[1:-1] == 44)
        inside[1:-1] |= point & digit[:-2] & digit[2:]
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    cuts = at[(at > 0) & (at < n)]
    starts[cuts], ends[cuts - 1] = inside[cuts], inside[cuts - 1]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    first = np.searchsorted(start, at)
    plain = _codes(data, start, end)
    head = np.zeros(len(start), bool)
    head[first[:-1][np.diff(first) > 0]] = True
    stops = np.concatenate(([0], np.cumsum(_STOP[data])))
    after_stop = head.copy()
    after_stop[1:] |= stops[start[1:]] > stops[end[:-1]]
    number = digit[start]
    unit = np.zeros(len(start), bool)
    unit[1:] = number[:-1] & ~head[1:] & member(units, plain[1:])
    second = _UPPER[data[np.minimum(start + 1, max(n - 1, 0))]] if n else np.zeros(0, bool)
    accent = (data[start] == 0xC3) & (data[np.minimum(start + 1, max(n - 1, 0))] < 0x9F) if n else second
    capital = (_UPPER[data[start]] | accent) & ~(second & (end - start > 1)) & ~number & ~unit

    def read(name: np.ndarray) -> Template:
        spelled = np.where(number, np.uint64(101), np.where(name, np.uint64(103), plain))
        code = np.where(unit, np.uint64(102), spelled)
        return Template(Words(mix(code, 6), first, start, end), mix(spelled, 6), plain, number | unit | name, unit)

    return read(capital & ~after_stop), read(capital)


def windows(t: Template, size: int, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where windows of ``size`` tokens start, their hashes, and whether these are of the whole template.

    Windows longer than ``WINDOW`` are left out if they have too few plain words and units.
    """
    w, n = t.words, len(t.plain)
    fits = np.arange(n) + size <= np.repeat(w.first[1:], np.diff(w.first))
    at = np.flatnonzero(fits if wanted is None else fits & wanted)
    slots, units = (np.concatenate(([0], np.cumsum(x))) for x in (t.slot, t.unit))
    literals = size - (slots[at + size] - slots[at])
    fixed = literals + units[at + size] - units[at]
    if size > WINDOW:
        at, literals, fixed = (x[fixed >= LITERALS] for x in (at, literals, fixed))
    h = np.zeros(len(at), np.uint64)
    level = np.where(literals >= LITERALS, 0, np.where(fixed >= LITERALS, 1, 2))
    for k, sums in enumerate(t.sums if len(at) else ()):
        begin = at[level == k]
        h[level == k] = mix(sums.stretch(begin, begin + size), size + 32 * k)
    return at, h, level == 0


def _slots(plain: np.ndarray, slot: np.ndarray, at: np.ndarray, size: int) -> pa.Array:
    """Values in the placeholders of each window."""
    cells = at[:, None] + np.arange(size)
    used = slot[cells]
    ends = np.append(0, np.cumsum(used.sum(axis=1)))
    return pa.ListArray.from_arrays(ends.astype(np.int32), pa.array(plain[cells[used]].view(np.int64)))


def read_windows(
    readings: tuple[Template, Template], size: int
) -> Iterator[tuple[Template, list[int], np.ndarray, np.ndarray, np.ndarray]]:
    """Windows in each way of reading; those that both read alike come once, as of both."""
    named = np.concatenate(([0], np.cumsum(readings[0].slot != readings[1].slot)))
    alike = named[np.minimum(np.arange(len(named) - 1) + size, len(named) - 1)] == named[:-1]
    for k, t in enumerate(readings):
        yield t, [k], *windows(t, size, ~alike)
    yield t, [0, 1], *windows(t, size, alike)


_ROW = "readings array<int>, id long, key long, size int, pos int, h long, slots array<long>"


def _rows(part: pa.RecordBatch, t: Template, readings: list[int], size: int, at, h, **more) -> pa.RecordBatch:
    w = t.words
    text = np.searchsorted(w.first, at, "right") - 1
    return pa.record_batch(
        {
            "readings": pa.array([readings] * len(at), pa.list_(pa.int32())),
            **{k: part.column(k).take(pa.array(text)) for k in ("id", "key")},
            "size": pa.array(np.full(len(at), size, np.int32)),
            "pos": pa.array((at - w.first[text]).astype(np.int32)),
            "h": pa.array(h.view(np.int64)),
            "slots": _slots(t.plain, t.slot, at, size),
            **{k: pa.array(v) for k, v in more.items()},
        }
    )


def _item_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    units = _unit_codes()
    for batch in batches:
        for part, data, at in chunks(batch, "text"):
            both = template(data, at, units)
            first = both[0].words.first
            length = np.diff(first).astype(np.int32)
            dense = []
            for t in both:
                begin, _, open_ = windows(t, WINDOW)
                dense.append(np.zeros(len(t.plain) + 1, np.int64))
                dense[-1][begin[~open_] + 1] = 1
                dense[-1] = np.cumsum(dense[-1])
            for size in range(1, SPAN + 1):
                for t, readings, begin, h, open_ in read_windows(both, size):
                    own = length[np.searchsorted(first, begin, "right") - 1]
                    keep = own >= size if size == WINDOW else np.minimum(own, SPAN) == size
                    if size > WINDOW:
                        last = begin + size - WINDOW + 1
                        keep &= dense[readings[0]][last] > dense[readings[0]][begin]
                    more = {"length": own[keep], "open": open_[keep] & (size <= WINDOW)}
                    yield _rows(part, t, readings, size, begin[keep], h[keep], **more)


def _hit_rows(wanted: dict[int, np.ndarray]):
    masks = {}
    for size, hashes in wanted.items():
        masks[size] = np.zeros(1 << 20, bool)
        masks[size][hashes & np.uint64((1 << 20) - 1)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = _unit_codes()
        for batch in batches:
            for part, data, at in chunks(batch, "text"):
                both = template(data, at, units)
                for size, hashes in wanted.items():
                    for t, readings, begin, h, _ in read_windows(both, size):
                        maybe = masks[size][h & np.uint64((1 << 20) - 1)]
                        begin, h = begin[maybe], h[maybe]
                        hit = member(hashes, h)
                        yield _rows(part, t, readings, size, begin[hit], h[hit])

    return run


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """doc_id, item_id, n_tokens (spanned), n_slots: one row for each text and item found in it."""
    leaks = _leaks(
        pick(docs, id=(id_column, "bigint"), text=(text_column, "string")),
        pick(items, id=(item_column, "bigint"), text=(item_text, "string")),
    )
    return leaks.select(F.col("id").alias("doc_id"), "item_id", "n_tokens", "n_slots")


def _leaks(texts: DataFrame, bench: DataFrame) -> DataFrame:
    """Leaks by id and key, a hash of the text."""
    texts, bench = (x.withColumn("key", F.xxhash64("text")) for x in (texts, bench))
    table = bench.mapInArrow(_item_rows, _ROW + ", length int, open boolean")
    table = table.withColumnsRenamed({"id": "item_id", "pos": "item_pos", "slots": "item_slots", "readings": "item_readings"}).drop("key")
    slices = max(1, -(-table.count() // SLICE))
    hits = None
    for k in range(slices):
        part = table.where(F.pmod("h", F.lit(slices)) == k).select("size", "h").distinct().toArrow()
        size, h = part.column("size").to_numpy(), part.column("h").to_numpy().view(np.uint64)
        wanted = {int(s): np.sort(h[size == s]) for s in np.unique(size)}
        found = texts.mapInArrow(_hit_rows(wanted), _ROW)
        hits = found if hits is None else hits.union(found)
    joined = hits.join(table, ["size", "h"]).withColumn("shift", F.col("pos") - F.col("item_pos"))
    joined = joined.withColumn("reading", F.explode("readings")).withColumn("item_reading", F.explode("item_readings"))
    both = F.arrays_zip(F.col("item_slots").alias("a"), F.col("slots").alias("b"))
    at = F.struct("size", "item_pos")
    same = (F.col("size") == WINDOW) & (F.col("slots") == F.col("item_slots"))
    aligned = joined.groupBy("id", "key", "item_id", "shift", "reading", "item_reading").agg(
        F.max("length").alias("length"),
        F.sort_array(F.collect_set(F.when(same, F.col("item_pos")))).alias("same_at"),
        *(
            column
            for label, rows in (("open", F.col("open")), ("all", F.lit(True)))
            for column in (
                F.collect_set(F.when(rows, at)).alias(f"{label}_at"),
                F.array_distinct(F.flatten(F.collect_list(F.when(rows, both)))).alias(f"{label}_pairs"),
            )
        ),
    )
    # Dense windows can complete an alignment, but not refute one that the others make up alone.
    found = [_verbatim(), *(_judged(aligned, label) for label in ("open", "all"))]
    leaks = aligned.select("id", "key", "item_id", F.explode(F.array(*found)).alias("found")).where("found is not null")
    return leaks.groupBy("id", "key", "item_id").agg(
        F.max("found.n_tokens").cast("int").alias("n_tokens"), F.max("found.n_slots").alias("n_slots")
    )


def _verbatim() -> Column:
    """Tokens spanned by the longest run of windows equal word by word, null if fewer than ``SPAN``."""
    runs = F.transform("same_at", lambda at, i: at - i)
    longest = F.array_max(F.transform(F.array_distinct(runs), lambda run: F.size(F.filter(runs, lambda x: x == run))))
    n_tokens = longest + WINDOW - 1
    return F.when(n_tokens >= SPAN, F.struct(n_tokens.alias("n_tokens"), F.lit(0).alias("n_slots")))


def _judged(aligned: DataFrame, label: str) -> Column:
    """Tokens spanned and slots, null if the hits are too few or their slots conflict."""
    at, pairs = F.col(f"{label}_at"), F.col(f"{label}_pairs")
    short, long = (F.filter(at, lambda x: x["size"] <= WINDOW), F.filter(at, lambda x: x["size"] > WINDOW))
    spans = [F.when(F.size(x) > 0, F.size(x) + x[0]["size"] - 1).otherwise(0) for x in (short, long)]
    n_tokens = F.greatest(*spans)
    one_each = F.size(F.array_distinct(pairs["a"])) == F.size(pairs)
    enough = n_tokens >= F.least("length", F.lit(SPAN))
    return F.when(one_each & enough, F.struct(n_tokens.alias("n_tokens"), F.size(pairs).alias("n_slots")))


def drop_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, whose text holds no item."""
    names = docs.columns
    bench = pick(items, id=("item_id", "bigint"), text=("text", "string"))
    leaks = _leaks(pick(docs, id=("doc_id", "bigint"), text=("text", "string")), bench)
    leaks = leaks.select(F.col("id").alias("_leak"), F.col("key").alias("_key")).distinct()
    plain = docs.toDF(*(f"_{i}" for i in range(len(names))))
    own = F.col(f"_{place(docs, 'doc_id')}").cast("bigint")
    key = F.xxhash64(F.col(f"_{place(docs, 'text')}").cast("string"))
    kept = plain.join(leaks, own.eqNullSafe(F.col("_leak")) & (key == F.col("_key")), "left_anti")
    return kept.select(*(F.col(f"_{i}").alias(n) for i, n in enumerate(names)))
