"""Repeated passages, found by recompression.

A window is ``window`` consecutive words of one text. A word goes if some window
that covers it has a word sequence that also starts anywhere else, in the same
text or another.

Recompression rewrites a text in rounds. A round merges runs of one symbol, and
pairs whose left symbol draws a 1 and whose right symbol draws a 0 from a hash of
symbol and round, into symbols whose names are hashes of what they replace. Names
are thus global without any exchange, and equal stretches of words get the same
symbols inside: whether a border between two symbols lives through a round hangs
on those two symbols alone. For each border the code keeps the words it hangs on
(its support). Steps:

1. Each window picks, among the borders whose support lies inside it, one of the
   highest round (ties by name). Equal windows pick the same border at the same
   offset, as the choice reads nothing outside the window. Windows next to each
   other mostly pick the same one, so that some tenth as many *anchors* as words
   are left: the name of the support, the fingerprint of all the words under the
   anchor's windows, and where they are. There are as many rounds as bring supports
   to about a quarter of the window: later ones leave windows too few borders to
   agree on one.
2. Anchors are counted by name. A name seen once has no repeat. A name whose
   anchors all have one fingerprint repeats with all its windows. The others are
   looked at window by window.
3. For these, each window gets a 128-bit fingerprint of its own, and repeats if
   that is seen twice. Copies of one fingerprint class send one member only.
4. Each text drops the words under repeated windows.

Counting has a partial sum before each exchange and the joins back are plain
equi-joins, which adaptive execution splits, so that a passage in a third of all
texts stays spread out. Texts are carried compressed.

Defined cases: a null text has no words; texts shorter than the window keep all
words; rows that share doc_id are told apart by their text, and equal rows count
as two places and so lose their windows; a null doc_id is kept; further columns
are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martlet.llm.common import drop_table, mix, pick, saved
from martlet.llm.words import Sums, Words, chunks, words_of

WINDOW = 35
_FAR = np.int64(1) << 40


def rounds_for(window: int) -> int:
    """A round leaves three quarters of the borders, and adds a symbol to each side of a support."""
    return 1 + int(math.log(1 + window / 18) / math.log(4 / 3))


def _round(pos, sym, lo, hi, inner_lo, inner_hi, first, k: int):
    """One round over symbols at ``pos`` named ``sym`` with border supports [lo, hi).

    ``inner_lo``, ``inner_hi``: what else the name of a symbol hangs on, where the
    borders at its two ends do not cover it yet.
    """
    n = len(pos)
    draw = (mix(sym, 1000 + k) >> np.uint64(40)) & np.uint64(1)
    same = np.zeros(n, bool)
    same[1:] = sym[1:] == sym[:-1]
    pair = np.zeros(n, bool)
    pair[1:] = (draw[:-1] == 1) & (draw[1:] == 0)
    gone = (same | pair) & ~first
    # Whether a border stays hangs on the symbols beside it, hence on their other borders.
    last = np.append(first[1:], True)
    new_lo, new_hi = np.minimum(lo, inner_lo), np.maximum(hi, inner_hi)
    np.minimum(new_lo[1:], inner_lo[:-1], out=new_lo[1:], where=~first[1:])
    np.maximum(new_hi[1:], inner_hi[:-1], out=new_hi[1:], where=~first[1:])
    before, after = ~first, ~last
    before[0] = after[-1] = False
    np.minimum(new_lo[1:], lo[:-1], out=new_lo[1:], where=before[1:])
    np.maximum(new_hi[1:], hi[:-1], out=new_hi[1:], where=before[1:])
    np.minimum(new_lo[:-1], lo[1:], out=new_lo[:-1], where=after[:-1])
    np.maximum(new_hi[:-1], hi[1:], out=new_hi[:-1], where=after[:-1])
    # The ends of a text are borders like others among words, and unknown to a window after that.
    new_lo[first] = -_FAR
    new_hi[last] = _FAR if k else pos[last] + 1
    kept = np.flatnonzero(~gone)
    if len(kept) == n:
        return pos, sym, new_lo, new_hi, np.full(n, _FAR), np.full(n, -_FAR), first
    size = np.diff(np.append(kept, n))
    many = size > 1
    sums = Sums.of(mix(sym, 2000 + k))
    name = sym[kept].copy()
    joined = sums.stretch(kept[many], kept[many] + size[many])
    name[many] = mix(joined ^ size[many].astype(np.uint64), 3000 + k)
    # Of a symbol made of three or more, the ends do not see the borders in the middle.
    inner_lo, inner_hi = np.full(len(kept), _FAR), np.full(len(kept), -_FAR)
    for g in np.flatnonzero(size > 2):
        inside = slice(kept[g] + 1, kept[g] + size[g])
        inner_lo[g], inner_hi[g] = new_lo[inside].min(), new_hi[inside].max()
    return pos[kept], name, new_lo[kept], new_hi[kept], inner_lo, inner_hi, first[kept]


def _name(sums: Sums, pos, lo, hi, k: int):
    """A border by the words of its support, its place there and its round."""
    shape = ((hi - lo) * 64 + (pos - lo)).astype(np.uint64) + np.uint64(k << 32)
    return mix(mix(sums.stretch(lo, hi), 11) ^ shape, 12)


def _rounds(w: Words, sums: Sums, window: int):
    """Borders of every round as (pos, lo, hi, name), lowest round first."""
    n = len(w.code)
    if not n:
        return
    pos = np.arange(n, dtype=np.int64)
    first = np.zeros(n, bool)
    first[w.first[:-1][np.diff(w.first) > 0]] = True
    lo, hi = pos.copy(), pos.copy()
    inner_lo, inner_hi = np.full(n, _FAR), np.full(n, -_FAR)
    sym = w.code
    for k in range(rounds_for(window)):
        l, h = np.minimum(lo, pos - 1), np.maximum(hi, pos + 1)
        near = np.flatnonzero((h - l <= window) & ~first)
        if not len(near):
            return
        p, l, h = pos[near], l[near], h[near]
        yield p, l, h, _name(sums, p, l, h, k)
        pos, sym, lo, hi, inner_lo, inner_hi, first = _round(pos, sym, lo, hi, inner_lo, inner_hi, first, k)


def _fill(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, .. for ``size`` steps, one stretch after another."""
    total = np.cumsum(size)
    return np.repeat(start - (total - size), size) + np.arange(total[-1] if len(total) else 0)


def _anchors(w: Words, window: int):
    """For windows that share an anchor: its name, fingerprint, first window, number of windows."""
    n = len(w.code)
    ends = np.repeat(w.first[1:], np.diff(w.first))
    last_start = ends - window
    open_ = np.arange(n) <= last_start
    at = np.full(n, -1, np.int64)
    level = np.full(n, -1, np.int16)
    sums = Sums.of(w.code)
    rounds = list(_rounds(w, sums, window))
    for k in range(len(rounds) - 1, -1, -1):
        if not open_.any():
            break
        pos, lo, hi, name = rounds[k]
        begin = np.maximum(hi - window, np.repeat(w.first[:-1], np.diff(w.first))[pos])
        size = np.minimum(lo, last_start[pos]) - begin + 1
        use = np.flatnonzero(size > 0)
        use = use[np.argsort(name[use], kind="stable")]
        cells = _fill(begin[use], size[use])
        which = np.repeat(use, size[use])
        free = open_[cells]
        cells, which = cells[free], which[free]
        at[cells] = which
        level[cells] = k
        open_[cells] = False
    taken = np.flatnonzero(at >= 0)
    if not len(taken):
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 2
    fresh = np.ones(len(taken), bool)
    fresh[1:] = (np.diff(taken) != 1) | (np.diff(at[taken]) != 0) | (np.diff(level[taken]) != 0)
    fresh[1:] |= np.diff(np.searchsorted(w.first, taken, "right")) != 0
    head = np.flatnonzero(fresh)
    count = np.diff(np.append(head, len(taken)))
    begin, of, lev = taken[head], at[taken[head]], level[taken[head]]
    pos, name = np.empty(len(head), np.int64), np.empty(len(head), np.uint64)
    for k in np.unique(lev):
        m = lev == k
        pos[m], name[m] = rounds[k][0][of[m]], rounds[k][3][of[m]]
    whole = mix(sums.stretch(begin, begin + count - 1 + window) ^ ((pos - begin) * 4096 + count).astype(np.uint64), 13)
    return name, whole, begin, count


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _rows(batch: pa.RecordBatch, w: Words, at: np.ndarray, **columns) -> pa.RecordBatch:
    """Rows for words at ``at``: the text's own columns, and ``columns``."""
    text = np.searchsorted(w.first, at, "right") - 1
    own = {c: batch.column(c).take(pa.array(text)) for c in ("doc_id", "v")}
    return pa.record_batch(own | columns | {"at": pa.array((at - w.first[text]).astype(np.int32))})


def _anchor_rows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, at in chunks(batch, "text"):
                w = words_of(data, at)
                name, whole, begin, count = _anchors(w, window)
                yield _rows(part, w, begin, name=_signed(name), whole=_signed(whole), n=pa.array(count.astype(np.int32)))

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as zstandard frames."""
    pack = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        texts = batch.column("text").cast(pa.large_binary())
        packed = pa.array([pack.compress(t.as_buffer()) if t.is_valid else None for t in texts], pa.binary())
        yield pa.record_batch({"doc_id": batch.column("doc_id"), "v": batch.column("v"), "z": packed})


def _unpacked(batch: pa.RecordBatch, most: int = 8 << 20) -> Iterator[tuple[int, list[bytes | None]]]:
    """Texts in stretches of some ``most`` bytes, with the first one's row number."""
    unpack = zstandard.ZstdDecompressor()
    texts, size, begin = [], 0, 0
    for i, z in enumerate(batch.column("z").to_pylist()):
        texts.append(None if z is None else unpack.decompress(z))
        size += len(texts[-1] or b"")
        if size >= most:
            yield begin, texts
            texts, size, begin = [], 0, i + 1
    if texts:
        yield begin, texts


def _spans(spans: pa.ListScalar) -> tuple[np.ndarray, np.ndarray]:
    values = spans.values
    return (values.field("at").to_numpy().astype(np.int64), values.field("n").to_numpy().astype(np.int64))


def _window_rows(window: int):
    """128-bit fingerprints of the windows that must be told apart one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column("spans")
            for begin, texts in _unpacked(batch, 2 << 20):
                ends = np.cumsum([0, *(len(t or b"") for t in texts)])
                data = np.frombuffer(b"".join(t or b"" for t in texts), np.uint8)
                w, again = words_of(data, ends), words_of(data, ends, salt=1)
                starts = []
                for i in range(len(texts)):
                    at, n = _spans(spans[begin + i])
                    starts.append(np.unique(_fill(at, n)) + w.first[i])
                at = np.concatenate(starts)
                one = Sums.of(w.code).stretch(at, at + window)
                two = Sums.of(again.code, 0x2545F4914F6CDD1D).stretch(at, at + window)
                yield _rows(batch.slice(begin, len(texts)), w, at, f=_signed(mix(one)), g=_signed(mix(two)))

    return run


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column("spans")
            for begin, texts in _unpacked(batch):
                total, removed, kept = [], [], []
                for i, text in enumerate(texts):
                    words = (text or b"").split()
                    total.append(len(words))
                    if spans[begin + i].is_valid:
                        at, n = _spans(spans[begin + i])
                        edge = np.zeros(len(words) + 1, np.int64)
                        np.add.at(edge, at, 1)
                        np.add.at(edge, at + n - 1 + window, -1)
                        keep = np.cumsum(edge[:-1]) == 0
                        words = [words[j] for j in np.flatnonzero(keep)]
                    removed.append(total[-1] - len(words))
                    kept.append(b" ".join(words))
                yield pa.record_batch(
                    {
                        "doc_id": batch.column("doc_id").slice(begin, len(texts)),
                        "n_words": pa.array(total, pa.int64()),
                        "n_removed": pa.array(removed, pa.int64()),
                        "kept_text": pa.array(kept, pa.binary()).cast(pa.string()),
                    }
                )

    return run


def _by_text(texts: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """``texts`` with the list of windows ``found`` in each."""
    lists = found.groupBy("doc_id", "v").agg(F.collect_list(F.struct("at", "n")).alias("spans"))
    lists = lists.withColumnsRenamed({"doc_id": "_id", "v": "_v"})
    on = texts["doc_id"].eqNullSafe(lists["_id"]) & (texts["v"] == lists["_v"])
    return texts.join(lists, on, how).select("doc_id", "v", "z", "spans")


def remove_repeats(
    docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", window: int = WINDOW
) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_removed, kept_text (kept words joined by one space)."""
    if window < 3:
        raise ValueError("a window has at least three words")
    texts = pick(docs, doc_id=(id_column, "bigint"), text=(text_column, "string"))
    texts = texts.withColumn("v", F.hash("text"))
    anchors = saved(
        texts.mapInArrow(_anchor_rows(window), "doc_id long, v int, name long, whole long, n int, at int"),
        "anchors",
    )
    names = (
        anchors.groupBy("name")
        .agg(F.count("*").alias("times"), F.min("whole").alias("a"), F.max("whole").alias("b"))
        .where("times > 1")
        .select(F.col("name").alias("_name"), (F.col("a") != F.col("b")).alias("mixed"))
    )
    shared = saved(anchors.join(names, F.col("name") == F.col("_name")).drop("_name"), "shared")
    drop_table(anchors)
    mixed = shared.where("mixed")
    classes = mixed.groupBy("name", "whole").agg(
        F.count("*").alias("times"), F.min(F.struct("doc_id", "v", "at", "n")).alias("one")
    )
    classes = saved(classes, "classes")
    many = classes.where("times > 1").select(F.col("name").alias("_name"), F.col("whole").alias("_whole"))
    sure = shared.where("not mixed").select("doc_id", "v", "at", "n").union(
        mixed.join(many, (F.col("name") == F.col("_name")) & (F.col("whole") == F.col("_whole"))).select(
            "doc_id", "v", "at", "n"
        )
    )
    packed = texts.mapInArrow(_packed, "doc_id long, v int, z binary")
    windows = (
        _by_text(packed, classes.select("one.*"), "inner")
        .mapInArrow(_window_rows(window), "doc_id long, v int, f long, g long, at int")
    )
    windows = saved(windows, "windows")
    twice = windows.groupBy("f", "g").agg(F.count("*").alias("times")).where("times > 1")
    twice = twice.select(F.col("f").alias("_f"), F.col("g").alias("_g"))
    found = windows.join(twice, (F.col("f") == F.col("_f")) & (F.col("g") == F.col("_g")))
    found = sure.union(found.select("doc_id", "v", "at", F.lit(1).alias("n")))
    return _by_text(packed, found, "left").mapInArrow(
        _cut(window), "doc_id long, n_words long, n_removed long, kept_text string"
    )
