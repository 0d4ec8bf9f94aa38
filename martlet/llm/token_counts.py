"""Token counts of sections, from one encoding of each whole text.

A text is encoded once, as a whole. Byte-level tokens cover its bytes without gaps,
so that the lengths of the tokens give every token's span, and sections are found
for all tokens by a sorted interval lookup. A token that crosses a section's border
goes to one section by ``rule``: ``first`` (the section of its first byte), ``last``
(of its last byte) or ``most`` (the one with most of its bytes; ties: the earlier).
Counts of a text's sections add up to the tokens of the whole text.

Sections are runs of lines of one kind: ``head`` (the first line), ``table`` (lines
with `` | ``), ``text``. A line's end belongs to it.

Defined cases: a null or empty text has one section ``head`` without tokens; a null
doc_id is kept; repeated rows are counted alike; an empty table gives an empty
result; further columns are not read.
"""

from __future__ import annotations

import base64
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from martlet.llm.common import pick

RULES = ("first", "last", "most")
#: Fixed value: how texts are cut before byte pairs are merged, as published with the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _encoder(path: str):
    """The encoding and each token's number of bytes, once for each Python worker."""
    name = f"_martlet_ranks:{path}"
    if name not in sys.modules:
        import types

        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(t): int(n) for t, n in (line.split() for line in lines if line.strip())}
        size = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, n in ranks.items():
            size[n] = len(token)
        made = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        sys.modules[name] = types.SimpleNamespace(encoding=made, size=size)
    return sys.modules[name].encoding, sys.modules[name].size


def line_sections(data: bytes) -> tuple[list[int], list[str]]:
    """Where sections begin, and their kinds."""
    begin, kinds, at = [0], ["head"], 0
    for i, line in enumerate(data.split(b"\n")):
        kind = "head" if not i else "table" if b" | " in line else "text"
        if i and kind != kinds[-1] and at < len(data):
            begin.append(at)
            kinds.append(kind)
        at += len(line) + 1
    return begin, kinds


def allocate(ends: np.ndarray, begin: np.ndarray, rule: str) -> np.ndarray:
    """The section of each token, from the tokens' ends and the sections' begins."""
    starts = np.append(0, ends)[:-1]
    first = np.searchsorted(begin, starts, "right") - 1
    if rule == "first":
        return first
    last = np.searchsorted(begin, ends - 1, "right") - 1
    if rule == "last":
        return last
    out = first.copy()
    upto = np.append(begin[1:], np.iinfo(np.int64).max)
    for t in np.flatnonzero(last > first):
        share = [min(ends[t], upto[s]) - max(starts[t], begin[s]) for s in range(first[t], last[t] + 1)]
        out[t] += int(np.argmax(share))
    return out


def _counted(path: str, rule: str, sections: Callable[[bytes], tuple[list[int], list[str]]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, size = _encoder(path)
        for batch in batches:
            ids, numbers, kinds, starts, stops, counts = [], [], [], [], [], []
            for doc_id, cell in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                text = cell.as_py() or ""
                data = text.encode()
                begin, kind = sections(data)
                tokens = encoding.encode_to_numpy(text, disallowed_special=()) if text else np.zeros(0, np.uint32)
                where = allocate(np.cumsum(size[tokens]), np.array(begin), rule)
                plain = len(text) == len(data)
                edges = [*begin, len(data)]
                if not plain:  # characters, not bytes: those that do not go on a character
                    heads = np.append(0, np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80))
                    edges = heads[edges].tolist()
                ids += [doc_id] * len(begin)
                numbers += range(len(begin))
                kinds += kind
                starts += edges[:-1]
                stops += edges[1:]
                counts += np.bincount(where, minlength=len(begin)).tolist()
            yield pa.record_batch(
                {
                    "doc_id": pa.array(ids, pa.int64()),
                    "section": pa.array(numbers, pa.int32()),
                    "kind": pa.array(kinds, pa.string()),
                    "start_char": pa.array(starts, pa.int64()),
                    "end_char": pa.array(stops, pa.int64()),
                    "n_tokens": pa.array(counts, pa.int64()),
                }
            )

    return run


def count_sections(
    docs: DataFrame,
    ranks: str,
    *,
    rule: str = "first",
    sections: Callable[[bytes], tuple[list[int], list[str]]] = line_sections,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """doc_id, section (from 0), kind, start_char, end_char, n_tokens, for each section of each text."""
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    rows = pick(docs, doc_id=(id_column, "bigint"), text=(text_column, "string"))
    return rows.mapInArrow(
        _counted(ranks, rule, sections),
        "doc_id long, section int, kind string, start_char long, end_char long, n_tokens long",
    )
