"""Merkle manifest of a corpus with a witness for every document.

Leaves are digests of rows. Per source they are ordered by id and folded sixteen at
a time up to the source's root; the roots of the sources are folded in the same way
to the root of the corpus.

Method: incremental witnesses. A task takes one aligned block of 16^3 nodes and
appends them one after another. Every open run holds the partial witnesses of the
nodes below it; when a run is complete its digest is appended to the level above
and the witnesses below are extended by their siblings. The digests of the blocks
are appended in the same way in a further round of tasks, until each tree has one
node. Then the rounds are walked back: a block gets the witness of its own root
and appends its nodes again, now with whole witnesses. No task holds more than one
block, however many rows a source has, and no witness but those of block roots is
ever written.

Positions come from a range exchange over (source, id): rows are numbered within
each range and the counts of the ranges before are added by a join.

Defined cases: null columns are written as ``-`` and null sources come first; a
null id sorts first and is never tampered with; rows with one id are ordered by
their leaf; an empty table has no row; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from martlet.llm.common import partitions, pick, saved

FAN = 16
LEVELS = 3
#: Nodes that one task appends at most before it starts anew.
BLOCK = FAN**LEVELS
#: Every fifth document, by the checksum of its id, is tampered with in the proof.
TAMPER_EVERY = 5

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The tree over the roots of the sources.
_TOP = -1


def digest_of(*columns: Column) -> Column:
    """The leaf: each value as byte count, ``:`` and value, or ``-`` if it is null."""
    parts = []
    for c in columns:
        value = c.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def joined(digests: list[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


class Appender:
    """Open subtrees of one block, from the leaves up.

    ``runs[l]`` are the digests of the open run of level l, ``below[l][i]`` the
    leaves under the i-th of them. ``witness[leaf]`` has (run, place in it) for
    each level that is complete.
    """

    def __init__(self) -> None:
        self.runs: list[list[str]] = []
        self.below: list[list[list[int]]] = []
        self.witness: list[list[tuple[list[str], int]]] = []

    def append(self, digest: str) -> None:
        self.witness.append([])
        self._add(0, digest, [len(self.witness) - 1])

    def _add(self, level: int, digest: str, leaves: list[int]) -> None:
        if level == len(self.runs):
            self.runs.append([])
            self.below.append([])
        self.runs[level].append(digest)
        self.below[level].append(leaves)
        if len(self.runs[level]) == FAN and level < LEVELS:
            self._close(level)

    def _close(self, level: int) -> None:
        run, below = self.runs[level], self.below[level]
        self.runs[level], self.below[level] = [], []
        for place, leaves in enumerate(below):
            for leaf in leaves:
                self.witness[leaf].append((run, place))
        self._add(level + 1, joined(run), [leaf for leaves in below for leaf in leaves])

    def finish(self, whole: bool) -> str:
        """The block's digest. ``whole``: the block is a whole tree, which ends where one node is left."""
        for level in range(LEVELS):
            if whole and len(self.runs[level]) == 1 and not any(self.runs[level + 1 :]):
                return self.runs[level][0]
            if level < len(self.runs) and self.runs[level]:
                self._close(level)
        return self.runs[LEVELS][0]


def _blocks(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[dict[str, list]]:
    """The rows of each (tree, block); rows come sorted by tree and pos, blocks may cross batches."""
    held: dict[str, list] = {c: [] for c in columns}
    for batch in batches:
        if not batch.num_rows:
            continue
        block = batch.column("pos").to_numpy() // BLOCK
        tree = batch.column("tree").to_numpy()
        cuts = np.flatnonzero((np.diff(block) != 0) | (np.diff(tree) != 0)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            part = {c: batch.column(c).slice(a, b - a).to_pylist() for c in columns}
            if held["pos"] and (held["tree"][0], held["pos"][0] // BLOCK) != (part["tree"][0], part["pos"][0] // BLOCK):
                yield held
                held = part
            else:
                for c in columns:
                    held[c] = held[c] + part[c]
    if held["pos"]:
        yield held


def _append_all(block: dict[str, list]) -> tuple[Appender, str]:
    appender = Appender()
    for digest in block["digest"]:
        appender.append(digest)
    return appender, appender.finish(block["total"][0] <= BLOCK)


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: dict[str, list] = {"tree": [], "pos": [], "total": [], "digest": []}
    for block in _blocks(batches, ["tree", "pos", "total", "digest"]):
        out["tree"].append(block["tree"][0])
        out["pos"].append(block["pos"][0] // BLOCK)
        out["total"].append(-(-block["total"][0] // BLOCK))
        out["digest"].append(_append_all(block)[1])
    yield pa.record_batch([pa.array(out["tree"], pa.int64()), pa.array(out["pos"], pa.int64()), pa.array(out["total"], pa.int64()), pa.array(out["digest"], pa.string())], list(out))


NODES = "tree long, pos long, total long, digest string"
_OUTER = "subroot string, before array<string>, after array<string>"


def _in_blocks(nodes: DataFrame) -> DataFrame:
    """Nodes of one block lie together in one task, in order."""
    block = F.floor(F.col("pos") / BLOCK).alias("_block")
    dealt = nodes.select("*", block).repartition(partitions(nodes.sparkSession), "tree", "_block")
    return dealt.sortWithinPartitions("tree", "pos").drop("_block")


def _node_witnesses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole witnesses of inner nodes: the siblings before and after, level by level up to the root."""
    texts = pa.list_(pa.string())
    for block in _blocks(batches, ["tree", "pos", "total", "digest", "subroot", "before", "after"]):
        appender, _ = _append_all(block)
        before, after, n = block["before"][0], block["after"][0], len(block["pos"])
        left = [["".join(run[:i]) for run, i in levels] + before for levels in appender.witness]
        right = [["".join(run[i + 1 :]) for run, i in levels] + after for levels in appender.witness]
        yield pa.record_batch(
            {
                "tree": pa.array(block["tree"], pa.int64()),
                "pos": pa.array(block["pos"], pa.int64()),
                "digest": pa.array(block["digest"], pa.string()),
                "subroot": pa.array([block["subroot"][0]] * n, pa.string()),
                "before": pa.array(left, texts),
                "after": pa.array(right, texts),
            }
        )


def _proofs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of the witness and folded root of every leaf."""
    columns = ["tree", "pos", "total", "digest", "doc_id", "tampered", "subroot", "before", "after"]
    for block in _blocks(batches, columns):
        appender, _ = _append_all(block)
        outer = list(zip(block["before"][0], block["after"][0], strict=True))
        rest = "".join(left + right for left, right in outer).encode()
        proofs, folded = [], []
        for own, levels in zip(block["tampered"], appender.witness, strict=True):
            proof = hashlib.sha256()
            for run, i in levels:
                left, right = "".join(run[:i]), "".join(run[i + 1 :])
                proof.update((left + right).encode())
                own = joined([left, own, right])
            proof.update(rest)
            for left, right in outer:
                own = joined([left, own, right])
            proofs.append(proof.hexdigest())
            folded.append(own)
        yield pa.record_batch(
            {
                "doc_id": pa.array(block["doc_id"], pa.int64()),
                "leaf": pa.array(block["digest"], pa.string()),
                "subroot": pa.array([block["subroot"][0]] * len(proofs), pa.string()),
                "proof_sha256": pa.array(proofs, pa.string()),
                "folded_root": pa.array(folded, pa.string()),
            }
        )


def _numbered(rows: DataFrame, group: str, order: list[str], label: str) -> DataFrame:
    """``rows`` with ``pos``, counted from 0 within ``group``, and ``total``, the rows of the group.

    Sorted ranges are written once with their number; a row's place is its place in
    the range plus the counts of the group's ranges before, of which there is one
    row for each range and group.
    """
    ranges = rows.repartitionByRange(partitions(rows.sparkSession), group, *order).sortWithinPartitions(group, *order)
    ranges = saved(ranges.withColumns({"_range": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), label)
    counts = ranges.groupBy(group, "_range").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    whole = Window.partitionBy(group)
    earlier = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumns({"_before": F.coalesce(F.sum("_n").over(earlier), F.lit(0)), "total": F.sum("_n").over(whole)})
    counts = saved(counts.withColumnsRenamed({group: "_group", "_range": "_part"}), f"{label}-counts")
    found = ranges.join(counts, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_range") == F.col("_part")))
    place = F.col("_before") + F.col("_at") - F.col("_first")
    return found.select(*rows.columns, place.alias("pos"), "total")


def _grow(nodes: DataFrame) -> list[DataFrame]:
    """The nodes of each round, from the given ones to one node a tree.

    A tree of one block ends after its first round and its node is handed on as it is.
    """
    rounds = [nodes]
    while True:
        made = saved(_in_blocks(rounds[-1].select("tree", "pos", "total", "digest")).mapInArrow(_roots, NODES), "blocks")
        rounds.append(made)
        if made.where("total > 1").isEmpty():
            return rounds


def _with_outer(nodes: DataFrame, outer: DataFrame) -> DataFrame:
    """The first node of each block gets the witness of the block's own node."""
    theirs = outer.select(*(F.col(c).alias(f"_{c}") for c in ("tree", "pos", "subroot", "before", "after")))
    rows = nodes.join(theirs, (F.col("tree") == F.col("_tree")) & (F.col("pos") == F.col("_pos") * BLOCK), "left")
    return rows.select(*nodes.columns, *(F.col(f"_{c}").alias(c) for c in ("subroot", "before", "after")))


def _descend(rounds: list[DataFrame], outer: DataFrame, to: int) -> DataFrame:
    """Witnesses of the nodes of round ``to``, from those of the last round."""
    for nodes in reversed(rounds[to:-1]):
        dealt = _in_blocks(_with_outer(nodes, outer))
        outer = saved(dealt.mapInArrow(_node_witnesses, f"tree long, pos long, digest string, {_OUTER}"), "witnesses")
    return outer


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row."""
    rows = pick(
        docs,
        doc_id=("doc_id", "bigint"),
        source=("source", "string"),
        lang=("lang", "string"),
        n_chars=("n_chars", "bigint"),
        text=("text", "string"),
    )
    lowered = F.translate("text", _UPPER, _LOWER)
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPER_EVERY == 0
    leaf = digest_of(*(F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")))
    tampered = F.when(chosen, digest_of(*(F.col(c) for c in ("doc_id", "source", "lang", "n_chars")), lowered))
    leaves = rows.select("doc_id", "source", leaf.alias("digest"), tampered.alias("tampered"))
    leaves = _numbered(leaves, "source", ["doc_id", "digest"], "leaves")

    sources = saved(leaves.groupBy("source").agg(F.max("total").alias("leaves")), "sources")
    sources = _numbered(sources.withColumn("_all", F.lit(0)), "_all", ["source"], "trees")
    sources = saved(sources.select(F.col("source").alias("_source"), F.col("pos").alias("tree"), F.col("total").alias("trees")), "numbers")
    leaves = leaves.join(sources, F.col("source").eqNullSafe(F.col("_source")))
    tampered = F.coalesce("tampered", "digest").alias("tampered")
    leaves = saved(leaves.select("tree", "pos", "total", "digest", "doc_id", tampered, "trees"), "placed")
    if leaves.isEmpty():
        return leaves.select(
            "doc_id", *(F.lit("").alias(c) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")), F.lit(True).alias("verified")
        )

    rounds = _grow(leaves.drop("trees"))
    subroots = rounds[-1].join(sources.select("tree", "trees"), "tree")
    tops = _grow(subroots.select(F.lit(_TOP).cast("long").alias("tree"), F.col("tree").alias("pos"), F.col("trees").alias("total"), "digest"))
    root = tops[-1].first().digest
    none = F.array().cast("array<string>")
    outer = tops[-1].select("tree", "pos", "digest", F.lit(None).cast("string").alias("subroot"), none.alias("before"), none.alias("after"))
    outer = _descend(tops, outer, 0)
    outer = outer.select(F.col("pos").alias("tree"), F.lit(0).cast("long").alias("pos"), "digest", F.col("digest").alias("subroot"), "before", "after")
    outer = _descend(rounds, outer, 1)
    proven = _in_blocks(_with_outer(rounds[0], outer)).mapInArrow(
        _proofs, "doc_id long, leaf string, subroot string, proof_sha256 string, folded_root string"
    )
    return proven.select(
        "doc_id",
        "leaf",
        "subroot",
        F.lit(root).alias("root"),
        "proof_sha256",
        "folded_root",
        (F.col("folded_root") == root).alias("verified"),
    )
