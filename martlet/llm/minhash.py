"""Near-duplicate texts by DartMinHash.

A text is a weighted set: its shingles of five words (ASCII letters in lower case),
weighted by how often they occur. Similarity is the weighted Jaccard similarity,
and texts of 0.8 or more are linked; a class is a component of links.

Signatures. Darts are thrown at each element's region, weight by rank: a hash of
element, unit of weight and number of the dart gives the next dart's rank, so that
equal elements are hit by the same darts. Only the lowest ranks matter, hence only
some k ln k + 2k darts for each text are thrown, however long it is. Each dart
belongs to one of k coordinates, by hash, and each coordinate keeps its earliest
dart. A coordinate that stays empty makes the text's ranks reach twice as far.

Links. Texts with the same words are one node. Nodes that agree in all values of a
band are candidates: each with the least node of its bucket, at first. The
agreement of the signatures prunes candidates (``MATCHES`` of k are reached by all
but a hundred-thousandth of the pairs at 0.8), and the exact similarity decides, for
the best candidates of each node that still cross two classes: one at first, then
eight times as many with each round, until no undecided candidate crosses. Then
buckets that still hold more than one class are compared exactly, in blocks with a
bounded number of texts and units of weight a side. A block returns only as many
links as tie its texts together, at most two for each text, however many pairs it
holds. Two linked texts in one bucket thus end in one class, while copies, and
buckets that are one class already, cost nothing.

Defined cases: texts of fewer than five words have one shingle, all their words; null
texts and texts without words are alone; a null doc_id gets a null class and links
nothing; rows with one doc_id are one document; repeated rows fall in one class; an
empty table gives an empty result; further columns are not read, and ``keep_one``
keeps them. There each text of a doc_id is a document of its own, so that none goes
without a copy that stays.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from martlet.llm.common import mix, pick, place, saved
from martlet.llm.components import components
from martlet.llm.words import Sums, Words, chunks, words_of

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 16, 5
K = BANDS * ROWS
MATCHES = 48
#: Texts, and units of weight, on one side of a block.
BLOCK, BLOCK_UNITS = 2048, 200_000
FEW = 32
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingles(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Elements of all texts and the text of each."""
    n = np.diff(w.first)
    many = np.maximum(n - SHINGLE + 1, (n > 0).astype(np.int64))
    text = np.repeat(np.arange(len(n)), many)
    begin = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many) + w.first[text]
    return mix(Sums.of(w.code).stretch(begin, np.minimum(begin + SHINGLE, w.first[text + 1])), 21), text


def units(element: np.ndarray, text: np.ndarray) -> np.ndarray:
    """A name for each unit of weight: the element and how many times it came before in its text."""
    key = element ^ mix(text.astype(np.uint64), 22)
    order = np.argsort(key, kind="stable")
    fresh = np.ones(len(order), bool)
    fresh[1:] = key[order][1:] != key[order][:-1]
    heads = np.flatnonzero(fresh)
    nth = np.arange(len(order)) - np.repeat(heads, np.diff(np.append(heads, len(order))))
    out = np.empty(len(order), np.uint64)
    out[order] = mix(element[order] + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), 23)
    return out


def darts(unit: np.ndarray, text: np.ndarray, reach: np.ndarray):
    """All darts below each text's ``reach`` in rank: text, rank, name."""
    rank = np.zeros(len(unit))
    found, nth = [], 0
    while len(unit):
        name = mix(unit, 100 + nth)
        rank = rank - np.log(((name >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
        low = rank < reach[text]
        unit, text, rank, name = unit[low], text[low], rank[low], name[low]
        found.append((text, rank, name))
        nth += 1
    if not found:
        return np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def signatures(unit: np.ndarray, text: np.ndarray, texts: int) -> np.ndarray:
    """For each text with elements, the name of the earliest dart of each coordinate; else 0."""
    out = np.zeros((texts, K), np.uint64)
    weight = np.bincount(text, minlength=texts)
    todo = weight > 0
    reach = (K * math.log(K) + 2 * K) / np.maximum(weight, 1)
    while todo.any():
        mine = todo[text]
        of, rank, name = darts(unit[mine], text[mine], reach)
        cell = of * K + (mix(name, 31) % np.uint64(K)).astype(np.int64)
        order = np.lexsort((rank, cell))
        cell, name = cell[order], name[order]
        head = np.ones(len(cell), bool)
        head[1:] = cell[1:] != cell[:-1]
        out.reshape(-1)[cell[head]] = name[head] | np.uint64(1)
        todo &= (out == 0).any(axis=1)
        out[todo] = 0
        reach[todo] *= 2
    return out


def _fixed(values: np.ndarray) -> pa.Array:
    """Rows of bytes as binary values."""
    width = values.shape[1]
    ends = np.arange(len(values) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(
        pa.binary(), len(values), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())]
    )


def _lists(values: np.ndarray) -> pa.Array:
    ends = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(values).view(np.int64).ravel()))


def _read(part: pa.RecordBatch, data: np.ndarray, at: np.ndarray):
    w = words_of(_LOWER[data], at)
    element, text = shingles(w)
    return w, units(element, text), text


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, data, at in chunks(batch, "text"):
            w, unit, text = _read(part, data, at)
            sig = signatures(unit, text, len(part))
            banded = sig.reshape(len(part), BANDS, ROWS)
            band = np.zeros((len(part), BANDS), np.uint64)
            for r in range(ROWS):
                band = mix(band ^ banded[:, :, r], 41)
            band = mix(band + np.arange(BANDS, dtype=np.uint64), 42)
            empty = np.diff(w.first) == 0
            whole = mix(Sums.of(w.code).stretch(w.first[:-1], w.first[1:]) + np.diff(w.first).astype(np.uint64), 51)
            again = words_of(_LOWER[data], at, salt=1)
            other = mix(Sums.of(again.code, 0x2545F4914F6CDD1D).stretch(w.first[:-1], w.first[1:]), 52)
            yield pa.record_batch(
                {
                    "doc_id": part.column("doc_id"),
                    "h": pa.array(whole.view(np.int64), mask=empty),
                    "g": pa.array(other.view(np.int64), mask=empty),
                    "bands": _lists(band),
                    "sig": _fixed((sig >> np.uint64(32)).astype("<u4").view(np.uint8).reshape(len(part), 4 * K)),
                }
            )


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted names of all units of weight, as bytes."""
    for batch in batches:
        for part, data, at in chunks(batch, "text"):
            _, unit, text = _read(part, data, at)
            order = np.lexsort((unit, text))
            cuts = np.searchsorted(text[order], np.arange(len(part) + 1))
            own = unit[order]
            yield pa.record_batch(
                {
                    "node": part.column("node"),
                    "size": pa.array(np.diff(cuts), pa.int64()),
                    "units": pa.array([own[cuts[i] : cuts[i + 1]].tobytes() for i in range(len(part))], pa.binary()),
                }
            )


def _binary(column: pa.Array, kind: str) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), kind) for x in column]


def _agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not len(batch):
            continue
        left = np.stack(_binary(batch.column("sig_a"), "<u4"))
        n = (left == np.stack(_binary(batch.column("sig_b"), "<u4"))).sum(axis=1)
        kept = pa.record_batch({"a": batch.column("a"), "b": batch.column("b"), "matches": pa.array(n.astype(np.int32))})
        yield kept.filter(pa.array(n >= MATCHES))


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ok = []
        for x, y in zip(_binary(batch.column("units_a"), "<u8"), _binary(batch.column("units_b"), "<u8"), strict=True):
            both = len(np.intersect1d(x, y, assume_unique=True))
            ok.append(both >= SIMILARITY * (len(x) + len(y) - both) - 1e-9)
        yield pa.record_batch({"a": batch.column("a"), "b": batch.column("b"), "linked": pa.array(ok, pa.bool_())})


def _shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many units each text of ``left`` has in common with each of ``right``."""
    of_left, of_right = (np.repeat(np.arange(len(x)), [len(u) for u in x]) for x in (left, right))
    own, other = np.concatenate(left), np.concatenate(right)
    order = np.argsort(other, kind="stable")
    other, of_right = other[order], of_right[order]
    low = np.searchsorted(other, own, "left")
    many = np.searchsorted(other, own, "right") - low

    # Units of few texts are joined, those of many counted by a product of matrices.
    few = np.flatnonzero((many > 0) & (many <= FEW))
    nth = np.arange(many[few].sum()) - np.repeat(np.cumsum(many[few]) - many[few], many[few])
    cell = np.repeat(of_left[few], many[few]) * len(right) + of_right[np.repeat(low[few], many[few]) + nth]
    out = np.bincount(cell, minlength=len(left) * len(right)).reshape(len(left), len(right)).astype(np.float32)

    common = np.unique(own[many > FEW])
    for at in range(0, len(common), BLOCK):
        names = common[at : at + BLOCK]
        sides = []
        for units, text, n in ((own, of_left, len(left)), (other, of_right, len(right))):
            column = np.minimum(np.searchsorted(names, units), len(names) - 1)
            hit = names[column] == units
            side = np.zeros((n, len(names)), np.float32)
            side[text[hit], column[hit]] = 1
            sides.append(side)
        out += sides[0] @ sides[1].T
    return out


def _forest(linked: np.ndarray) -> Iterator[tuple[int, int]]:
    """Links of ``linked`` that tie together what all its links do, at most one for each row or column."""
    fresh = np.ones(sum(linked.shape), bool)
    rows = linked.shape[0]
    for start in range(rows):
        if not fresh[start]:
            continue
        fresh[start] = False
        reached = [start]
        while reached:
            x = reached.pop()
            if x < rows:
                found = np.flatnonzero(linked[x] & fresh[rows:]) + rows
            else:
                found = np.flatnonzero(linked[:, x - rows] & fresh[:rows])
            fresh[found] = False
            reached.extend(found.tolist())
            yield from ((x, y) if x < rows else (y, x) for y in found.tolist())


def _between(table: pa.Table) -> pa.Table:
    """Links between classes, across the two sides of a block: as many as tie its texts together."""
    node, root, side = (table.column(c).to_numpy() for c in ("node", "root", "side"))
    units = _binary(table.column("units").combine_chunks(), "<u8")
    left, right = (np.flatnonzero(side == table.column(c)[0].as_py()) for c in "ij")
    if not len(left) or not len(right):
        return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    both = _shared([units[x] for x in left], [units[x] for x in right])
    size = np.array([len(u) for u in units])
    linked = both >= SIMILARITY * (size[left][:, None] + size[right][None, :] - both) - 1e-9
    linked &= root[left][:, None] != root[right][None, :]
    ends = np.array(list(_forest(linked)), np.int64).reshape(-1, 2) - [0, len(left)]
    a, b = node[left[ends[:, 0]]], node[right[ends[:, 1]]]
    return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})


def _pairs(pairs: DataFrame, nodes: DataFrame, value: str) -> DataFrame:
    """``pairs`` with the value of both nodes."""
    for side in "ab":
        own = nodes.select(F.col("node").alias(f"_{side}"), F.col(value).alias(f"{value}_{side}"))
        pairs = pairs.join(own, F.col(side) == F.col(f"_{side}"))
    return pairs


def _with_root(rows: DataFrame, roots: DataFrame | None, node: str, name: str) -> DataFrame:
    if roots is None:
        return rows.withColumn(name, F.col(node))
    named = roots.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
    joined = rows.join(named, F.col(node) == F.col("_n"), "left")
    return joined.withColumn(name, F.coalesce("_r", node)).drop("_n", "_r")


class _Search:
    """Candidates and what has been decided about them."""

    def __init__(self, elements: DataFrame):
        self.elements = elements
        self.refused: DataFrame | None = None
        self.roots: DataFrame | None = None

    def settle(self, candidates: DataFrame) -> None:
        """Decide candidates until none that is undecided crosses two classes."""
        most = 1
        while True:
            rows = _with_root(_with_root(candidates, self.roots, "a", "root_a"), self.roots, "b", "root_b")
            rows = rows.where("root_a <> root_b").select("a", "b", "matches")
            if self.refused is not None:
                rows = rows.join(self.refused, ["a", "b"], "left_anti")
            best = Window.partitionBy("b").orderBy(F.desc("matches"), "a")
            rows = rows.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= most).select("a", "b")
            made = saved(_pairs(rows, self.elements, "units").mapInArrow(_similar, "a long, b long, linked boolean"), "decided")
            if made.isEmpty():
                return
            self.link(made.where("linked").select("a", "b"))
            # Linked pairs are of one class from now on.
            refused = made.where("not linked").select("a", "b")
            self.refused = refused if self.refused is None else self.refused.union(refused)
            most *= 8

    def link(self, found: DataFrame) -> None:
        """Add links to the classes so far, of which only each node's root is looked at again."""
        if not found.isEmpty():
            self.roots = components(found if self.roots is None else found.union(self.roots.select("node", "root")))


def near_duplicates(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, class_id (least doc_id of its class), kept (doc_id = class_id), for each row of ``docs``."""
    texts = pick(docs, doc_id=(id_column, "bigint"), text=(text_column, "string"))
    signed = saved(texts.mapInArrow(_sign, "doc_id long, h long, g long, bands array<long>, sig binary"), "signed")
    worded = signed.where("doc_id is not null and h is not null")
    nodes = saved(
        worded.groupBy("h", "g").agg(
            F.min("doc_id").alias("node"), F.first("bands").alias("bands"), F.first("sig").alias("sig")
        ),
        "nodes",
    )
    member = nodes.select(F.explode("bands").alias("bucket"), "node").distinct()
    firsts = member.groupBy("bucket").agg(F.count("*").alias("n"), F.min("node").alias("a")).where("n > 1")
    # Written too: a join with its own aggregate would not be split where a bucket is hot.
    firsts = saved(firsts.withColumnRenamed("bucket", "_bucket"), "firsts")
    buckets = saved(
        member.join(firsts, F.col("bucket") == F.col("_bucket")).select("bucket", "a", F.col("node").alias("b"), "n"), "buckets"
    )
    stars = buckets.where("a <> b").select("a", "b").distinct()
    sign = nodes.select("node", "sig")
    candidates = saved(_pairs(stars, sign, "sig").mapInArrow(_agreeing, "a long, b long, matches int"), "candidates")

    among = candidates.select(F.col("a").alias("_id")).union(candidates.select(F.col("b").alias("_id")))
    wide = buckets.where("n > 2 and a <> b").select(F.col("b").alias("_id"))
    # Written, so that its size is known: as long as it is small, the texts stay where they are.
    used = saved(among.union(wide).distinct(), "used")
    chosen = texts.join(used, F.col("doc_id") == F.col("_id"), "left_semi").withColumnRenamed("doc_id", "node")
    search = _Search(saved(chosen.mapInArrow(_elements, "node long, size long, units binary"), "elements"))
    search.settle(candidates)

    # What is left: buckets of three and more whose members, beside the first, are of several classes.
    rest = _with_root(buckets.where("n > 2 and a <> b").select("bucket", F.col("b").alias("node")), search.roots, "node", "root")
    sizes = search.elements.select(F.col("node").alias("_n"), "size")
    rest = rest.join(sizes, F.col("node") == F.col("_n")).select("bucket", "node", "root", "size")
    several = rest.groupBy("bucket").agg(
        F.count("*").alias("n"), F.sum("size").alias("units"), F.min("root").alias("low"), F.max("root").alias("high")
    ).where("low <> high")
    sides = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("units") / BLOCK_UNITS)).cast("int")
    several = several.select(F.col("bucket").alias("_bucket"), sides.alias("sides"))
    rest = rest.join(several, F.col("bucket") == F.col("_bucket")).withColumn("side", F.pmod(F.hash("node"), F.col("sides")))
    rest = rest.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("sides") - 1)))
    rest = rest.withColumns({"i": F.least("side", "_other"), "j": F.greatest("side", "_other")})
    units = search.elements.select(F.col("node").alias("_n"), "units")
    rest = rest.join(units, F.col("node") == F.col("_n")).select("bucket", "node", "root", "side", "i", "j", "units")
    between = rest.groupBy("bucket", "i", "j").applyInArrow(_between, "a long, b long")
    search.link(saved(between.distinct(), "between"))

    own = nodes.select("h", "g", "node").withColumnsRenamed({"h": "_h", "g": "_g"})
    rows = signed.select("doc_id", "h", "g").join(own, (F.col("h") == F.col("_h")) & (F.col("g") == F.col("_g")), "left")
    rows = _with_root(rows, search.roots, "node", "class_id")
    class_id = F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id"))
    return rows.select("doc_id", class_id.alias("class_id"), (F.col("doc_id") == class_id).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, of one text of each class, that of the least doc_id; null ids all stay."""
    names = docs.columns
    own, text = F.col(f"_{place(docs, 'doc_id')}").cast("bigint"), F.col(f"_{place(docs, 'text')}").cast("string")
    plain = docs.toDF(*(f"_{i}" for i in range(len(names)))).withColumns({"_id": own, "_key": F.xxhash64(own, text)})
    named = plain.where("_id is not null")
    classes = near_duplicates(named.select("_key", text.alias("text")), id_column="_key").distinct()
    classes = classes.join(named.select("_id", "_key").distinct(), F.col("doc_id") == F.col("_key"))
    stay = classes.groupBy("class_id").agg(F.min(F.struct("_id", "_key")).alias("first")).select("first._key")
    stay = stay.withColumnRenamed("_key", "_stay")
    kept = plain.join(stay, F.col("_key") == F.col("_stay"), "left").where("_id is null or _stay is not null")
    first = Window.partitionBy("_key").orderBy("_id")
    kept = kept.withColumn("_nth", F.when(F.col("_id").isNull(), 1).otherwise(F.row_number().over(first))).where("_nth = 1")
    return kept.select(*(F.col(f"_{i}").alias(n) for i, n in enumerate(names)))
