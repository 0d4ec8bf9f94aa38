"""Language identification by compression.

For each language a zstandard raw-content dictionary is cut from labelled texts. A
text is compressed once with each dictionary; the language whose dictionary gives
the fewest bytes wins, and a narrow margin to the next one rejects the text.

Texts are compressed in pieces of ``PIECE`` bytes, so that a long text's own
repetition does not drown the dictionary and memory stays bounded; all pieces of
the whole text count. A margin below ``UNSURE`` is looked at again at a higher
compression level, which finds shorter matches and decides. ``score`` is the margin to the runner-up as a share of what
``CLEAR`` asks for, at most 1.

The dictionaries come from a bounded sample: ``SAMPLE_TEXTS`` texts of a language
(those with the least hash of id and text; of texts that fall in the same one of
``SAMPLE_BINS`` bins of hashes only the least), with ``SAMPLE_BYTES`` of content from
them at most, of which each gives an equal share from its beginning, of ``SAMPLE_SHARE``
bytes at least. Texts of any length train, and fewer texts give longer shares. Hashes
are reduced to bins before they are exchanged, and texts are read for the sample only.
The prediction reads the text alone.

Defined cases: a null text or one without letters is ``und``, score 0 and
rejected; a tie goes to the language that sorts first, with score 0; rows with a
null label or text train nothing, and repeated rows train once; without any labelled row every text is ``und``; repeated
rows are predicted alike; further columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from martlet.llm.common import pick, place

SAMPLE_TEXTS = 400
SAMPLE_BYTES = 110 << 10
SAMPLE_BINS, SAMPLE_SHARE = 64 * SAMPLE_TEXTS, 200
PIECE = 2048
LEVEL, SECOND_LEVEL = 5, 19
#: Margins, as shares of the runner-up's size: below the first a text is rejected, from the second on score is 1.
NARROW, CLEAR = 0.004, 0.1
#: Below this margin the second level decides.
UNSURE = 0.02
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")


def held_out(id_column: Column, folds: int = 5) -> Column:
    """Whether the id, as text, falls in the fold that no dictionary sees; null does not."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % folds == 0, F.lit(False))


def dictionaries(labelled: DataFrame) -> dict[str, bytes]:
    """Raw content by language, from columns doc_id, text and lang."""
    rows = labelled.where("lang is not null and text <> ''").withColumn("h", F.xxhash64("doc_id", "text"))
    bins = rows.groupBy("lang", F.pmod("h", F.lit(SAMPLE_BINS)).alias("bin")).agg(F.min("h").alias("h"))
    ranked = bins.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(f"n <= {SAMPLE_TEXTS}")
    chosen = ranked.select(
        F.col("lang").alias("_lang"), F.col("h").alias("_h"), F.count("*").over(Window.partitionBy("lang")).alias("of")
    )
    share = F.greatest(F.floor(F.lit(SAMPLE_BYTES) / F.col("of")), F.lit(SAMPLE_SHARE)).cast("int")
    # As large as the sample, SAMPLE_TEXTS rows a language, so that no text is exchanged.
    part = rows.join(F.broadcast(chosen), (F.col("lang") == F.col("_lang")) & (F.col("h") == F.col("_h")))
    part = part.select("lang", "h", share.alias("share"), F.substring("text", F.lit(1), share).alias("text"))
    found: dict[str, list[bytes]] = {}
    # Bounded by the sample: repeated rows are one, and no text is longer than its share.
    for r in part.distinct().orderBy("lang", "h", "text").collect():
        found.setdefault(r["lang"], []).append(_folded(r["text"])[: r["share"]])
    return {lang: b"\n".join(texts)[:SAMPLE_BYTES] for lang, texts in found.items()}


def _folded(text: str) -> bytes:
    return text.lower().encode()


def _packers(content: dict[str, bytes], level: int) -> list[zstandard.ZstdCompressor]:
    out = []
    for lang in sorted(content):
        words = zstandard.ZstdCompressionDict(content[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        words.precompute_compress(level=level)
        out.append(
            zstandard.ZstdCompressor(dict_data=words, level=level, write_content_size=False, write_dict_id=False)
        )
    return out


def _judge(packs: list[zstandard.ZstdCompressor], pieces: list[bytes]) -> tuple[int, float]:
    """The dictionary that gives the fewest bytes, and its margin to the next one."""
    sizes = np.array([sum(len(p.compress(x)) for x in pieces) for p in packs], float)
    best = int(np.argmin(sizes))
    if len(sizes) == 1:
        return best, 1.0
    next_ = np.delete(sizes, best).min()
    return best, (next_ - sizes[best]) / next_


def _predict(content: dict[str, bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs = sorted(content)
        packs, second = _packers(content, LEVEL), _packers(content, SECOND_LEVEL)
        for batch in batches:
            out_lang, out_score, out_reject = [], [], []
            for cell in batch.column("text"):
                text = cell.as_py()
                lang, margin = UNKNOWN, 0.0
                if packs and text and _LETTER.search(text):
                    data = _folded(text)
                    pieces = [data[i : i + PIECE] for i in range(0, len(data), PIECE)]
                    best, margin = _judge(packs, pieces)
                    if margin < UNSURE:
                        best, margin = _judge(second, pieces)
                    lang = langs[best]
                out_lang.append(lang)
                out_score.append(min(1.0, margin / CLEAR))
                out_reject.append(lang == UNKNOWN or margin < NARROW)
            yield pa.record_batch(
                {
                    **{c: batch.column(c) for c in batch.schema.names},
                    "lang_pred": pa.array(out_lang, pa.string()),
                    "score": pa.array(out_score, pa.float64()),
                    "rejected": pa.array(out_reject, pa.bool_()),
                }
            )

    return run


def train(docs: DataFrame) -> dict[str, bytes]:
    """Dictionaries from the rows outside the held-out fold, with columns doc_id, text, lang."""
    rows = pick(docs, doc_id=("doc_id", "bigint"), text=("text", "string"), lang=("lang", "string"))
    return dictionaries(rows.where(~held_out(F.col("doc_id"))))


def identify(docs: DataFrame, content: dict[str, bytes]) -> DataFrame:
    """doc_id, text, held_out, lang_pred, score, rejected for every row of ``docs``."""
    rows = pick(docs, doc_id=("doc_id", "bigint"), text=("text", "string"))
    return rows.mapInArrow(
        _predict(content), "doc_id long, text string, lang_pred string, score double, rejected boolean"
    ).withColumn("held_out", held_out(F.col("doc_id")))


def keep_identified(docs: DataFrame, content: dict[str, bytes]) -> DataFrame:
    """The rows of ``docs``, all columns, whose text is not rejected."""
    names = docs.columns
    plain = docs.toDF(*(f"_{i}" for i in range(len(names))))
    text = f"_{place(docs, 'text')}"
    schema = StructType(list(plain.schema.fields)).add("lang_pred", "string").add("score", "double").add("rejected", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = _predict(content)
        for batch in batches:
            texts = pa.record_batch({"text": batch.column(text)})
            for made in predict([texts]):
                yield pa.record_batch(
                    [*batch.columns, *(made.column(c) for c in ("lang_pred", "score", "rejected"))],
                    names=[*batch.schema.names, "lang_pred", "score", "rejected"],
                )

    kept = plain.mapInArrow(run, schema).where("not rejected")
    return kept.select(*(F.col(f"_{i}").alias(n) for i, n in enumerate(names)))
