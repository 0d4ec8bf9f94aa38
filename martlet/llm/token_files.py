"""Token ids as ORC files.

Texts are placed in ascending id order by a range exchange, each range is encoded
and written as one ORC file, and everything that is reported is read back from the
files. ORC writes integers run-length encoded in stripes, with row indexes of the
least and greatest value of each column and Bloom filters on doc_id, so that
stripes are read in parallel and a lookup by id skips those without it.

Encoding: a tokenizer that drops white space before it merges anything gives a text
the ids of its words one after another. Its rules are read at the start; if they say
so, the texts of a slice are cut into words and these into letters and the marks behind
them as Arrow columns, so that Python sees each distinct part once a slice. A part is
encoded once in a while and kept in a cache of bounded bytes. A text with any other white space than space, tab, line feed and
carriage return, or with ``<|`` (special tokens), is encoded whole, and so is every
text for any other tokenizer.

Defined cases: a null text is empty and has the end id alone; a null doc_id sorts
first; rows with one doc_id are ordered by text; an empty table writes a file
without rows; further columns are not read.
"""

from __future__ import annotations

import json
import sys
import types
import zlib
from array import array
from collections.abc import Callable, Iterator
from itertools import chain
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from martlet.llm.common import pick, scratch_path

END_ID = 1
#: Memory of a worker's word cache, about; it starts anew beyond that.
CACHE_BYTES = 128 << 20
#: What a cached word takes besides its characters and ids: entry, text and number.
_ENTRY = 160
#: Characters of words that are encoded at once, joined by spaces.
PIECE = 32_000
#: White space besides space, tab, line feed and carriage return, and the start of special tokens.
_ODD = "<\\||[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: Latin letters with marks behind; no apostrophe, with which contractions begin.
_LETTERS = r"^(?P<letters>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<marks>[!-&(-/:-@\[-`{-~]*)$"
#: Bytes of text that are encoded at once.
SLICE = 2 << 20
#: Fixed value: how a tokenizer cuts texts for which words can be encoded one by one.
_WORDWISE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SCHEMA = "doc_id long, range int, local_start long, n_tokens long, ids array<int>"


def by_words(rules: dict) -> bool:
    """Whether a tokenizer, given as its file's content, drops white space before it merges anything."""
    cleaned = [n["type"] for n in (rules.get("normalizer") or {}).get("normalizers", [])]
    cuts = (rules.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
    first = cuts[0]
    return (
        cleaned == ["NFC", "Replace", "Lowercase"]
        and first.get("type") == "Split"
        and first.get("pattern") == {"Regex": _WORDWISE}
        and (first.get("behavior"), first.get("invert")) == ("Removed", True)
        and [(c["type"], c.get("add_prefix_space"), c.get("use_regex")) for c in cuts[1:]] == [("ByteLevel", False, False)]
        and not rules.get("truncation")
        and not rules.get("padding")
    )


def _kept(path: str) -> types.SimpleNamespace:
    """The tokenizer and the word cache of this Python worker, over all its tasks."""
    name = f"_martlet_tokenizer:{path}"
    if name not in sys.modules:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        tokenizer = Tokenizer.from_file(path)
        sys.modules[name] = types.SimpleNamespace(
            tokenizer=tokenizer,
            model=tokenizer.model,
            bytewise=pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
            by_words=by_words(json.loads(tokenizer.to_str())),
            number={"": 0},
            start=array("q", [0, 0]),
            ids=array("i"),
            bytes=0,
        )
    return sys.modules[name]


def _pieces(words: list[str]) -> Iterator[tuple[int, int, np.ndarray]]:
    """Stretches of words of about ``PIECE`` characters, and where each word ends when they are joined by spaces."""
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    i = 0
    while i < len(words):
        before = ends[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(ends, before + PIECE, "right")))
        yield i, j, ends[i:j] - before
        i = j


def _taken(flat: np.ndarray, start: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches of ``flat``, each from its start to the next one's, one after another, and how long each is."""
    sizes = start[which + 1] - start[which]
    total = np.cumsum(sizes)
    at = np.repeat(start[which] - (total - sizes), sizes) + np.arange(total[-1] if len(total) else 0)
    return flat[at], sizes


class WordEncoder:
    """Ids of texts by the tokenizer in ``path``, through a cache of words.

    The cache holds the ids of all words one after another, and where each begins.
    """

    def __init__(self, path: str):
        self.kept = _kept(path)

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self.kept.tokenizer.encode(text, add_special_tokens=False).ids, np.int32)

    def _add(self, words: list[str], sizes: np.ndarray, ids: np.ndarray) -> None:
        kept = self.kept
        kept.number.update(zip(words, range(len(kept.number), len(kept.number) + len(words)), strict=True))
        kept.start.frombytes((kept.start[-1] + np.cumsum(sizes)).astype(np.int64).tobytes())
        kept.ids.frombytes(ids.astype(np.int32).tobytes())
        kept.bytes += sum(map(len, words)) + _ENTRY * len(words) + ids.nbytes

    def _whole(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids words have, and the ids: encoded joined by spaces, and cut where the words begin."""
        sizes, ids = [], []
        for i, j, ends in _pieces(words):
            made = self.kept.tokenizer.encode(" ".join(words[i:j]), add_special_tokens=False)
            begin = np.fromiter(map(itemgetter(0), made.offsets), np.int64, len(made))
            sizes.append(np.bincount(np.searchsorted(ends, begin, "right"), minlength=j - i))
            ids.append(np.array(made.ids, np.int32))
        return np.concatenate(sizes), np.concatenate(ids)

    def _plain(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for words that the tokenizer would neither change nor cut: only its merges are left to do."""
        merge, bytewise = self.kept.model.tokenize, self.kept.bytewise.pre_tokenize_str
        made = [[t.id for t in merge(w if w.isascii() else bytewise(w)[0][0])] for w in words]
        sizes = np.fromiter(map(len, made), np.int64, len(made))
        return sizes, np.fromiter(chain.from_iterable(made), np.int32, int(sizes.sum()))

    def _numbers(self, distinct: pa.Array, encode: Callable) -> np.ndarray:
        """Numbers of words in the cache, where those that it does not have are put."""
        known, words = self.kept.number, distinct.to_pylist()
        new = [w for w in words if w not in known]
        if new:
            self._add(new, *encode(new))
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def _ids(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words one after another, and how many each has."""
        kept = self.kept
        if kept.bytes > CACHE_BYTES:
            kept.number, kept.start, kept.ids, kept.bytes = {"": 0}, array("q", [0, 0]), array("i"), 0
        # Letters and marks are cut from each other before they are merged, and letters are lower-cased.
        parts = pc.extract_regex(distinct, _LETTERS)
        cut = parts.is_valid()
        number = np.zeros((len(distinct), 2), np.int64)
        at = cut.to_numpy(zero_copy_only=False)
        for k, name in enumerate(("letters", "marks")):
            own = pc.utf8_lower(pc.struct_field(parts.filter(cut), name)).dictionary_encode()
            number[at, k] = self._numbers(own.dictionary, self._plain)[own.indices.to_numpy()]
        number[~at, 0] = self._numbers(distinct.filter(pc.invert(cut)), self._whole)
        ids, sizes = _taken(self._flat(), np.frombuffer(kept.start, np.int64), number.ravel())
        return ids, sizes.reshape(-1, 2).sum(axis=1)

    def _flat(self) -> np.ndarray:
        return np.frombuffer(self.kept.ids, np.int32) if len(self.kept.ids) else np.zeros(0, np.int32)

    def __call__(self, texts: pa.Array | list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each followed by the end id, and how many each has."""
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        odd = pc.match_substring_regex(texts, _ODD) if self.kept.by_words else pa.array([True] * len(texts), pa.bool_())
        whole = {i: self._encode(texts[i].as_py()) for i in np.flatnonzero(odd).tolist()}
        words = pc.ascii_split_whitespace(pc.if_else(odd, pa.scalar("", texts.type), texts))
        counts = pc.list_value_length(words).to_numpy()
        found = words.flatten().dictionary_encode()
        own, sizes = self._ids(found.dictionary)
        ids, sizes = _taken(own, np.append(0, np.cumsum(sizes)), found.indices.to_numpy())
        upto = np.append(0, np.cumsum(sizes))[np.append(0, np.cumsum(counts))]
        pieces = []
        for i in range(len(texts)):
            pieces += [whole.get(i, ids[upto[i] : upto[i + 1]]), [END_ID]]
        n = np.array([len(pieces[2 * i]) + 1 for i in range(len(texts))], np.int64)
        return np.concatenate(pieces).astype(np.int32) if pieces else np.zeros(0, np.int32), n


def slices(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Stretches of rows with about ``most`` bytes of text each."""
    size, begin = 0, 0
    for i, n in enumerate(pc.binary_length(texts).to_pylist()):
        size += n or 0
        if size >= most:
            yield begin, i + 1
            size, begin = 0, i + 1
    if begin < len(texts):
        yield begin, len(texts)


def _encoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, place, start = WordEncoder(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            for a, b in slices(batch.column("text"), SLICE):
                ids, n = encode(batch.column("text").slice(a, b - a))
                ends = np.cumsum(n)
                yield pa.record_batch(
                    {
                        "doc_id": batch.column("doc_id").slice(a, b - a),
                        "range": pa.array(np.full(b - a, place, np.int32)),
                        "local_start": pa.array(start + ends - n),
                        "n_tokens": pa.array(n),
                        "ids": pa.ListArray.from_arrays(np.append(0, ends).astype(np.int32), pa.array(ids)),
                    }
                )
                start += int(ends[-1])

    return run


def write_tokens(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    ranges: int | None = None,
) -> None:
    """Write the ids of all texts to ORC files in ``path``, in ascending id order."""
    spark = docs.sparkSession
    texts = pick(docs, doc_id=(id_column, "bigint"), text=(text_column, "string"))
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = texts.repartitionByRange(ranges, "doc_id").sortWithinPartitions("doc_id", "text")
    (
        placed.mapInArrow(_encoded(tokenizer), SCHEMA)
        .write.option("compression", "zstd")
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", "1000")
        .option("orc.stripe.size", str(64 << 20))
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .orc(path)
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows; a filter on doc_id skips files, stripes and row groups."""
    return spark.read.schema(SCHEMA).orc(path)


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sums = []
        for ids in batch.column("ids"):
            sums.append(zlib.crc32(ids.values.to_numpy().astype("<u4", copy=False)))
        kept = {c: batch.column(c) for c in ("doc_id", "range", "local_start", "n_tokens")}
        yield pa.record_batch(kept | {"ids_crc32": pa.array(sums, pa.int64())})


def token_digest(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every text, from the files alone."""
    rows = read_tokens(spark, path)
    digest = rows.mapInArrow(
        _checksums, "doc_id long, range int, local_start long, n_tokens long, ids_crc32 long"
    )
    # One row for each file: how many ids the files before it hold.
    totals = rows.groupBy("range").agg(F.sum("n_tokens").alias("n"))
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(
        F.col("range").alias("_range"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")
    )
    return digest.join(before, F.col("range") == F.col("_range")).select(
        "doc_id", (F.col("before") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32"
    )


def encode_to_orc(docs: DataFrame, tokenizer: str, path: str | None = None, **columns: str) -> DataFrame:
    """Write the files, then report what they hold."""
    spark = docs.sparkSession
    path = path or scratch_path(spark, "tokens")
    write_tokens(docs, path, tokenizer, **columns)
    return token_digest(spark, path)
