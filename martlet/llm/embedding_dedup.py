"""Near-duplicate embeddings: collision counting of projections within cells of LSH tables.

Vectors are scaled to length 1 and projected onto many random directions. Two
vectors collide in a projection if one lies in the window of ``HALF_WINDOW`` to
either side of the other's value; at cosine 0.9 that happens with a probability that
follows from the normal distribution, and pairs with fewer collisions than
``calibrated`` for the wanted recall are not verified.

No projection is sorted on its own, as its windows would list most pairs of the
corpus. Candidates are vectors that share a cell in one of ``TABLES`` tables, a cell
being ``KEYS`` projections cut in windows of ``WIDTH`` at random offsets; pairs that
share no cell are never counted. The number of tables follows from the recall: a pair
at cosine 0.9 shares at least one cell with that probability. Cells are compared in
blocks of ``BLOCK`` a side.

Two exchanges by cell do the work. The first carries of every vector its node and
``COUNTED`` projections, a byte each, and keeps the members of a cell that pass the
count with another one; the second carries the vectors of these members only, for the
cosines in double precision. A byte is a step of 1 / ``STEPS``; windows are widened by
the rounding, so that none of the collisions is lost by it. Each pair counts in the
first table that it shares only, so links are summed without listing pairs, and tasks
send each vector's number of links and the least vector it is connected with inside
the block.

Equal vectors are one node, so a vector that a third of the rows share costs one
comparison. A cell of any size is split in blocks and never comes together.

Defined cases: a null, empty or zero vector, or one with null or non-finite
components, links nothing; vectors of different length do not link; a null vec_id is
reported without component and links nothing; repeated rows link each other; an
empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martlet.llm.common import mix, partitions, pick, saved
from martlet.llm.components import components

COSINE, RECALL, COUNT_RECALL = 0.9, 0.995, 0.999
WIDTH, KEYS = 2.0, 8
COUNTED, HALF_WINDOW, STEPS = 48, 0.7, 32
#: Largest difference, in steps, that a collision may have after both values were rounded.
REACH = math.floor(HALF_WINDOW * STEPS) + 1
BLOCK = 2048
#: Groups up to this size are compared row against row for a whole batch at once.
SMALL = 32
SEED = 20


def _phi(x: float) -> float:
    return 0.5 * (1 + math.erf(x / math.sqrt(2)))


def tables(cosine: float = COSINE, recall: float = RECALL) -> int:
    """Tables after which a pair at ``cosine`` shares a cell with probability ``recall``."""
    d = math.sqrt(2 - 2 * cosine)
    r = WIDTH / d
    one = 1 - 2 * _phi(-r) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))
    return math.ceil(math.log(1 - recall) / math.log(1 - one**KEYS))


def calibrated(cosine: float = COSINE, recall: float = COUNT_RECALL) -> int:
    """Collisions, of ``COUNTED``, that a pair at ``cosine`` has with probability ``recall``."""
    p = 2 * _phi(HALF_WINDOW / math.sqrt(2 - 2 * cosine)) - 1
    total = 0.0
    for n in range(COUNTED, -1, -1):
        total += math.comb(COUNTED, n) * p**n * (1 - p) ** (COUNTED - n)
        if total >= recall:
            return n
    return 0


TABLES = tables()
ENOUGH = calibrated()


def directions(dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Random directions, those of the tables first, and the tables' offsets."""
    draw = np.random.default_rng([SEED, dim])
    n = TABLES * KEYS
    return draw.standard_normal((dim, n + COUNTED)), draw.uniform(0, WIDTH, n)


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each vector's projections to count and its cell in every table."""
    known: dict[int, tuple] = {}
    for batch in batches:
        lists = batch.column("v")
        dims = lists.value_lengths().to_numpy()
        for dim in np.unique(dims):
            part = batch.filter(pa.array(dims == dim))
            x = _scaled(part.column("v").flatten().to_numpy().reshape(len(part), dim))
            unit = x / np.linalg.norm(x, axis=1, keepdims=True)
            if dim not in known:
                known[dim] = directions(int(dim))
            to, offset = known[dim]
            cell = np.floor((unit @ to[:, : TABLES * KEYS] + offset) / WIDTH).astype(np.int64).view(np.uint64)
            cell = cell.reshape(len(part), TABLES, KEYS)
            key = np.full((len(part), TABLES), np.uint64(dim))
            for i in range(KEYS):
                key = mix(key ^ cell[:, :, i], 61)
            key = mix(key + np.arange(TABLES, dtype=np.uint64), 62)
            ends = np.arange(len(part) + 1, dtype=np.int32) * TABLES
            yield pa.record_batch(
                {
                    "node": part.column("node"),
                    "near": _bytes(unit @ to[:, TABLES * KEYS :]),
                    "cells": pa.ListArray.from_arrays(ends, pa.array(key.view(np.int64).ravel())),
                }
            )


def _bytes(at: np.ndarray) -> pa.ListArray:
    """Projections as steps; what lies beyond a byte is moved to its end, which brings values only nearer."""
    steps = np.clip(np.rint(at * STEPS), -127, 127).astype(np.int8)
    return pa.ListArray.from_arrays(np.arange(len(at) + 1, dtype=np.int32) * COUNTED, pa.array(steps.ravel()))


def _scaled(x: np.ndarray) -> np.ndarray:
    """By powers of two, which rounds nothing, so that squares neither overflow nor vanish."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def _passing(near: np.ndarray, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of the rows ``left`` and ``right`` with enough collisions, some rows at a time."""
    across = near[right].T.copy()
    for begin in range(0, len(left), 256):
        rows = left[begin : begin + 256]
        hits = np.zeros((len(rows), len(right)), np.int8)
        for k in range(COUNTED):
            hits += np.abs(near[rows, k][:, None] - across[k][None, :]) <= REACH
        a, b = np.nonzero(hits >= ENOUGH)
        yield rows[a], right[b]


class _Group:
    """Rows of one block pair as arrays."""

    def __init__(self, columns: dict, a: int, b: int):
        self.node, self.n, self.side, self.cells, self.x, self.near = (
            columns[c][a:b] for c in ("node", "n", "side", "cells", "x", "near")
        )
        self.cell, self.i, self.j = (columns[c][a] for c in ("cell", "i", "j"))

    def links(self):
        """Positions of linked pairs that count here."""
        left, right = np.flatnonzero(self.side == self.i), np.flatnonzero(self.side == self.j)
        if not len(left) or not len(right) or len({len(v) for v in self.x}) > 1:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        x = np.stack(self.x)
        norm = np.linalg.norm(x, axis=1)
        out_a, out_b = [], []
        for a, b in _passing(self.near, left, right):
            if self.i == self.j:
                a, b = a[a < b], b[a < b]
            for s in range(0, len(a), 1 << 16):
                p, q = a[s : s + (1 << 16)], b[s : s + (1 << 16)]
                near = np.einsum("ij,ij->i", x[p], x[q]) >= COSINE * norm[p] * norm[q]
                p, q = p[near], q[near]
                shared = self.cells[p] == self.cells[q]
                first = self.cells[p, np.argmax(shared, axis=1)] == self.cell
                out_a.append(p[first])
                out_b.append(q[first])
        return (np.concatenate(c) if c else np.zeros(0, np.int64) for c in (out_a, out_b))

    def found(self):
        """node, rows linked with it, and the least node connected with it here."""
        a, b = self.links()
        if not len(a):
            return None
        many = np.zeros(len(self.node), np.int64)
        np.add.at(many, a, self.n[b])
        np.add.at(many, b, self.n[a])
        root = self.node.copy()
        while True:
            low = np.minimum(root[a], root[b])
            new = root.copy()
            np.minimum.at(new, a, low)
            np.minimum.at(new, b, low)
            if (new == root).all():
                break
            root = new
        used = many > 0
        return self.node[used], many[used], root[used]


def _columns(rows: pa.RecordBatch, vectors: bool) -> dict:
    out = {c: rows.column(c).to_numpy() for c in ("cell", "i", "j", "side", "node")}
    out["near"] = rows.column("near").flatten().to_numpy().reshape(len(rows), COUNTED).astype(np.int16)
    if vectors:
        out["n"] = rows.column("n").to_numpy()
        out["cells"] = rows.column("cells").flatten().to_numpy().reshape(len(rows), TABLES)
        dims = rows.column("v").value_lengths().to_numpy()
        ends = np.cumsum(dims)[:-1]
        out["x"] = np.empty(len(rows), object)
        for k, v in enumerate(np.split(rows.column("v").flatten().to_numpy(), ends)):
            out["x"][k] = _scaled(v[None, :])[0]
    return out


def _by_group(made, vectors: bool):
    """Over rows sorted by cell, i, j: ``made(rows, columns, heads)`` for whole groups, of one batch at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.RecordBatch | None = None

        def part(rows: pa.RecordBatch, last: bool):
            c = _columns(rows, vectors)
            new = np.ones(len(rows), bool)
            new[1:] = (np.diff(c["cell"]) != 0) | (np.diff(c["i"]) != 0) | (np.diff(c["j"]) != 0)
            heads = np.append(np.flatnonzero(new), len(rows))
            if not last:
                heads = heads[:-1]
            return made(rows, c, heads), None if last else rows.slice(heads[-1])

        for batch in batches:
            rows = batch if kept is None else pa.Table.from_batches([kept, batch]).combine_chunks().to_batches()[0]
            if len(rows):
                out, kept = part(rows, False)
                yield out
        if kept is not None and len(kept):
            yield part(kept, True)[0]

    return run


def _promising(rows: pa.RecordBatch, c: dict, heads: np.ndarray) -> pa.RecordBatch:
    """The members of a group that pass the count with another one."""
    hit = np.zeros(len(rows), bool)
    sizes = np.diff(heads)
    group = np.repeat(np.arange(len(sizes)), sizes)
    small = sizes[group] <= SMALL
    within = c["i"] == c["j"]
    for lag in range(1, min(SMALL, sizes.max(initial=0))):
        a = np.flatnonzero(small[:-lag] & (group[:-lag] == group[lag:]))
        a = a[within[a] | (c["side"][a] != c["side"][a + lag])]
        for s in range(0, len(a), 1 << 16):
            p = a[s : s + (1 << 16)]
            ok = p[(np.abs(c["near"][p] - c["near"][p + lag]) <= REACH).sum(axis=1) >= ENOUGH]
            hit[ok] = hit[ok + lag] = True
    for g in np.flatnonzero(sizes > SMALL):
        own = np.arange(heads[g], heads[g + 1])
        left, right = own[c["side"][own] == c["i"][own[0]]], own[c["side"][own] == c["j"][own[0]]]
        for a, b in _passing(c["near"], left, right) if len(left) and len(right) else ():
            other = a != b
            hit[a[other]] = hit[b[other]] = True
    return rows.select(["cell", "i", "j", "side", "node"]).filter(pa.array(hit))


def _linked(rows: pa.RecordBatch, c: dict, heads: np.ndarray) -> pa.RecordBatch:
    """The links of each group."""
    found = [
        one
        for a, b in zip(heads[:-1], heads[1:], strict=True)
        if b - a > 1 and (one := _Group(c, a, b).found())
    ]
    node, links, root = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
    return pa.record_batch({"node": pa.array(node), "links": pa.array(links), "root": pa.array(root)})


def _grouped(rows: DataFrame) -> DataFrame:
    parts = partitions(rows.sparkSession)
    return rows.repartition(parts, "cell", "i", "j").sortWithinPartitions("cell", "i", "j")


def link_vectors(vectors: DataFrame, *, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept."""
    rows = pick(vectors, vec_id=(id_column, "bigint"), v=(vector_column, "array<double>"))
    good = F.col("v").isNotNull() & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    some = F.exists("v", lambda c: c != 0)
    rows = rows.withColumn("v", F.when(F.col("vec_id").isNotNull() & good & some, F.col("v")))
    rows = rows.withColumn("key", F.xxhash64("v"))
    nodes = saved(
        rows.where("v is not null").groupBy("key", "v").agg(F.min("vec_id").alias("node"), F.count("*").alias("n")),
        "vectors",
    )
    celled = saved(
        nodes.select("node", "v").mapInArrow(_cells, "node long, near array<tinyint>, cells array<long>"), "cells"
    )
    # A cell with more than BLOCK nodes: there are at most TABLES / BLOCK as many as vectors. It is written, so that the
    # join knows its size: it is broadcast if that is small, and else hot cells are split.
    large = saved(
        celled.select(F.explode("cells").alias("_cell")).groupBy("_cell").agg(F.count("*").alias("size"))
        .where(F.col("size") > BLOCK)
        .select("_cell", F.ceil(F.col("size") / BLOCK).cast("int").alias("sides")),
        "large-cells",
    )
    members = celled.select("node", "near", F.explode("cells").alias("cell"))
    placed = members.join(large, F.col("cell") == F.col("_cell"), "left").withColumn("sides", F.coalesce("sides", F.lit(1)))
    placed = placed.withColumn("side", F.pmod(F.hash("node"), F.col("sides")))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("sides") - 1)))
    placed = placed.select(
        "cell", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "node", "near"
    )
    promising = saved(
        _grouped(placed).mapInArrow(_by_group(_promising, False), "cell long, i int, j int, side int, node long"), "promising"
    )
    vectors_of = nodes.select(F.col("node").alias("_n"), "n", "v")
    cells_of = celled.select(F.col("node").alias("_c"), "near", "cells")
    whole = promising.join(vectors_of, F.col("node") == F.col("_n")).join(cells_of, F.col("node") == F.col("_c"))
    whole = whole.select("cell", "i", "j", "side", "node", "n", "v", "near", "cells")
    found = saved(
        _grouped(whole).mapInArrow(_by_group(_linked, True), "node long, links long, root long"), "compared"
    )
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = found.groupBy(F.col("node").alias("_l")).agg(F.sum("links").alias("links"))
    own = nodes.join(links, F.col("node") == F.col("_l"), "left").join(
        roots.select(F.col("node").alias("_r"), "root"), F.col("node") == F.col("_r"), "left"
    )
    own = own.select(
        F.col("key").alias("_key"),
        F.col("v").alias("_v"),
        (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
        F.coalesce("root", "node").alias("component_id"),
    )
    joined = rows.join(own, (F.col("key") == F.col("_key")) & (F.col("v") == F.col("_v")), "left")
    component = F.coalesce("component_id", "vec_id")
    return joined.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"),
        (F.col("vec_id") == component).alias("kept"),
    )
