"""Operators on texts against brute force on small fixtures."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from helpers import clashing, frame, same
from pyspark.sql import functions as F

from martlet.llm import (
    decontaminate,
    language,
    licenses,
    minhash,
    queries,
    substring_dedup,
    token_counts,
    token_files,
)

DOCS = "doc_id long, text string, lang string, source string"
ROOT = "/root/testdata/sf0.001"


def docs(spark, rows):
    return clashing(frame(spark, [(*r, "en", "s")[:4] for r in rows], DOCS))


def passages(words, window, seed):
    draw = random.Random(seed)
    word = lambda: str(draw.randrange(words))
    base = [[word() for _ in range(draw.randrange(200))] for _ in range(8)]
    rows = []
    for i in range(25):
        b = list(draw.choice(base))
        a = draw.randrange(len(b) + 1)
        rows.append((i, " ".join([word() for _ in range(draw.randrange(30))] + b[a : a + 3 * window] + [word()] * 2)))
    rows += [(100, None), (101, ""), (None, rows[4][1]), rows[3], (3, "x y  z"), (102, "\x0b".join(["a"] * 3 * window))]
    return rows


def repeats(rows, window):
    texts = [(t or "").encode().split() for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in texts for i in range(len(w) - window + 1))
    for (doc_id, _), w in zip(rows, texts, strict=True):
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        yield doc_id, len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode()


@pytest.mark.parametrize(("words", "window"), [(2, 6), (40, 8), (2000, 35), (1, 7)])
def test_repeated_windows_go(spark, words, window):
    rows = passages(words, window, words)
    same(substring_dedup.remove_repeats(docs(spark, rows), window=window).collect(), repeats(rows, window))


def test_repeats_of_a_table(spark):
    table = spark.read.parquet(f"{ROOT}/documents.parquet").select("doc_id", "text")
    want = [
        (d, n, gone, hashlib.sha256(kept.encode()).hexdigest())
        for d, n, gone, kept in repeats([tuple(r) for r in table.collect()], 35)
    ]
    same(queries.op1_substring_dedup(spark, ROOT).collect(), want)


def classes(rows):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = defaultdict(list)
    for i, t in rows:
        if i is not None and (w := (t or "").translate(lower).encode().split()):
            sets[i].append(Counter(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))))
    parent = {i: i for i, _ in rows}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sets, 2):
        for x in sets[a]:
            for y in sets[b]:
                both = sum((x & y).values())
                if both >= 0.8 * (sum(x.values()) + sum(y.values()) - both) - 1e-9:
                    low, high = sorted((top(a), top(b)))
                    parent[high] = low
    return [(i, top(i), i == top(i)) if i is not None else (None, None, None) for i, _ in rows]


def test_near_duplicates(spark):
    draw = random.Random(5)
    rows = []
    for g in range(12):
        base = [str(draw.randrange(500)) for _ in range(draw.choice((3, 40, 120)))]
        for i in range(draw.choice((1, 2, 12))):
            w = list(base)
            for _ in range(draw.choice((0, 0, 1, 2))):
                w[draw.randrange(len(w))] = "changed"
            rows.append((100 * g + i, " ".join(w)))
    rows += [(9000, None), (9001, ""), (9002, " \n"), (None, rows[0][1]), rows[1], (9003, rows[0][1].upper())]
    rows.append((9004, " ".join(["again"] * 3000)))
    same(minhash.near_duplicates(docs(spark, rows)).collect(), classes(rows))


def test_near_duplicates_of_a_table(spark):
    table = spark.read.parquet(f"{ROOT}/documents.parquet").select("doc_id", "text")
    same(queries.op9_minhash(spark, ROOT).collect(), classes([tuple(r) for r in table.collect()]))


def test_one_document_of_a_class_stays(spark):
    rows = [(2, "a b c d e f"), (1, "A b c d e  f"), (1, "A b c d e  f"), (None, "a b c d e f"), (3, None)]
    df = docs(spark, rows)
    kept = minhash.keep_one(df)
    assert kept.columns == df.columns
    same(kept.select("doc_id", "text").collect(), [rows[1], rows[3], rows[4]])


def test_texts_of_one_id_go_only_with_a_copy(spark):
    rows = [(1, "a b c d e f"), (1, "u v w x y z"), (0, "a b c d e f"), (4, "one two three"), (4, "four five six"), (4, None)]
    same(minhash.keep_one(docs(spark, rows)).select("doc_id", "text").collect(), rows[1:])


def test_signatures_estimate_similarity():
    a = np.arange(1, 401, dtype=np.uint64)
    for shared in (200, 360):
        unit = np.concatenate((a, a[:shared], a[shared:] + np.uint64(10**6)))
        text = np.repeat([0, 1], 400)
        sig = minhash.signatures(unit * np.uint64(0x9E3779B97F4A7C15), text, 2)
        assert (sig > 0).all()
        assert abs((sig[0] == sig[1]).mean() - shared / (800 - shared)) < 0.2


def test_candidates_of_a_bucket_across_blocks(spark):
    import pyarrow as pa

    units = np.tile(np.arange(80, dtype="<u8"), (4, 1))
    units[3] += 1000
    rows = {"node": [1, 2, 3, 4], "root": [1, 1, 3, 4], "side": [0, 1, 1, 0], "i": [0] * 4, "j": [1] * 4}
    made = minhash._between(pa.table(rows | {"units": [u.tobytes() for u in units]}))
    same(zip(*made.select(["a", "b"]).to_pydict().values(), strict=True), [(1, 3)])


def test_shared_units_of_a_block(monkeypatch):
    draw = np.random.default_rng(1)
    for few, block in ((3, 7), (32, 2048)):
        monkeypatch.setattr(minhash, "FEW", few)
        monkeypatch.setattr(minhash, "BLOCK", block)
        sides = [[np.unique(draw.integers(0, 60, draw.integers(1, 40)).astype("<u8")) for _ in range(n)] for n in (50, 33)]
        want = [[len(np.intersect1d(x, y)) for y in sides[1]] for x in sides[0]]
        assert minhash._shared(*sides).tolist() == want


def test_a_group_whose_texts_are_far_from_its_first(spark, monkeypatch):
    """Versions drift from the first one: neighbours are linked, and most pairs are not."""
    monkeypatch.setattr(minhash, "BLOCK", 16)
    draw, rows = random.Random(8), []
    for g in range(3):
        words = [f"w{draw.randrange(400)}" for _ in range(120)]
        for i in range(40):
            rows.append((100 * g + i, " ".join(words)))
            words[draw.randrange(len(words))] = f"new{g}x{i}"
    draw.shuffle(rows)
    same(minhash.near_duplicates(docs(spark, rows)).collect(), classes(rows))


ITEM = "If Tom has 12 apples and Mary gives him 5 more apples then how many apples does Tom have at the end of 3 days"


def test_asked_again_with_other_values(spark):
    rows = [
        (1, "Question: " + ITEM.replace("Tom", "Bob").replace("Mary", "Ann").replace("12", "1,700.5")),
        (2, ITEM.replace("does Tom", "does Jim")),
        (3, "Nothing here about 12 apples"),
        (4, None),
        (5, ""),
        (6, "x " * 30000 + ITEM + " y" * 30000),
        (6, "x " * 30000 + ITEM + " y" * 30000),
        (None, ITEM),
    ]
    items = frame(spark, [(7, ITEM), (8, None), (9, ""), (10, "3 4 5")], "item_id long, text string")
    found = decontaminate.find_leaks(docs(spark, rows), clashing(items))
    # The second text has 17 tokens of the item as they stand.
    same(found.select("doc_id", "item_id").collect(), [(1, 7), (2, 7), (6, 7), (None, 7)])
    kept = decontaminate.drop_leaks(docs(spark, rows), items)
    same(kept.select("doc_id").collect(), [(3,), (4,), (5,)])
    assert kept.columns == docs(spark, rows).columns


def test_a_verbatim_stretch_beside_other_values(spark):
    words = ITEM.split()
    other = {"Tom": "Jim", "12": "9"}

    def changed(keep):
        """The words as they stand up to ``keep``, then values that conflict, then other words."""
        return " ".join([*words[:keep], *(other.get(w, w) for w in words[keep:])])

    texts = [changed(15), "so it goes on " + " ".join(words[:12]) + " and so on", " ".join(words[:13]) + " and so on"]
    same(found_pairs(spark, texts, [ITEM]), [(0, 0), (2, 0)])


DENSE = [
    "Car travels 60 km in 2 hours how far",
    "a car travels 60 km in 2 hours how far is it",
    "so 3 4 Tom 5 Bob 6 Ann 7 kg 8 cm we see that Tom and 3 m are 9 in all of them",
    "mix 3 4 5",
    "so 3 4 Tom 5 Bob 6 Ann 7",
]


def found_pairs(spark, texts, items):
    """Items found in each text: (text, item), by place."""
    bench = frame(spark, list(enumerate(items)), "item_id long, text string")
    return [tuple(r)[:2] for r in decontaminate.find_leaks(docs(spark, list(enumerate(texts))), bench).collect()]


def test_items_dense_in_placeholders(spark):
    copies = [f"we say: {t} or so" for t in DENSE]
    same(found_pairs(spark, copies, DENSE), [(0, 0), (1, 0), (1, 1), (2, 2), (2, 4), (3, 3), (4, 4)])
    again = [f"we say: {t.replace('60', '70').replace('2 ', '3 ')} or so" for t in DENSE[:2]]
    again.append(copies[2].replace("Bob", "Eve").replace(" 3 ", " 33 "))
    again += ["mix 3 4 6", "so 3 4 Tom 5 Bob 6 Ann 8"]
    same(found_pairs(spark, again, DENSE), [(0, 0), (1, 0), (1, 1), (2, 2)])


NAMED = ["Ly was st and of the", "Tom went by boat with the other men here today", "What is it that Ann took from the old house"]


def test_first_words_in_running_text(spark):
    inside = [f"he said {NAMED[0]}", f"when {NAMED[1]} it", f"so, {NAMED[2]}", NAMED[2].lower().replace("ann", "Ann")]
    same(found_pairs(spark, inside, NAMED), [(0, 0), (1, 1), (2, 2), (3, 2)])
    again = [NAMED[0].replace("Ly", "Jo"), "Yes. " + NAMED[1].replace("Tom", "Bob"), "and " + NAMED[1].replace("Tom", "Bob")]
    same(found_pairs(spark, again, NAMED), [(0, 0), (1, 1), (2, 1)])


def test_two_values_that_are_equal_in_the_copy(spark):
    item = "If a box holds 3 red balls and 5 blue balls then how many balls are in it"
    texts = [item.replace("3", "4").replace("5", "4"), item.replace("3", "6")]
    same(found_pairs(spark, texts, [item]), [(0, 0), (1, 0)])
    # The other way round one value of the item would stand for two.
    same(found_pairs(spark, [item], texts[:1]), [])


def test_texts_that_share_an_id_are_judged_alone(spark):
    again = ITEM.replace("Tom", "Bob").replace("12", "15")
    rows = [(None, "a clean text"), (None, ITEM), (None, again), (None, None), (1, "clean too"), (1, ITEM), (1, ITEM)]
    items = frame(spark, [(7, ITEM)], "item_id long, text string")
    found = decontaminate.find_leaks(docs(spark, rows), items)
    same(found.select("doc_id", "item_id").collect(), [(None, 7), (None, 7), (1, 7)])
    kept = decontaminate.drop_leaks(docs(spark, rows), items)
    same(kept.select("doc_id", "text").collect(), [rows[0], rows[3], rows[4]])


def test_leaks_of_a_table(spark):
    texts = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    items = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect()
    want = {(d.doc_id, i.item_id) for d in texts for i in items if i.text in d.text}
    got = {(r.doc_id, r.item_id) for r in queries.op4_decontaminate(spark, "/root/testdata/sf0.01").collect()}
    assert want <= got
    assert len(got - want) <= 2  # items that a text holds in part


TEXTS = [
    (5, "Ünïcode wörds, it's 3.5 times [x] 's don't|now AB"),
    (1, None),
    (7, ""),
    (2, "a  b\n\tc <|endoftext|> d\x0be\x85f g é"),
    (None, "no id."),
    (2, "same id, other text..."),
    (9, "word " * 20000),
]


def test_tokens_round_trip(spark, tmp_path):
    from tokenizers import Tokenizer

    path = str(tmp_path / "tokens")
    tokenizer = Tokenizer.from_file(queries.WORD_BPE)
    got = token_files.encode_to_orc(docs(spark, TEXTS), queries.WORD_BPE, path).collect()
    ordered = sorted(TEXTS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want, at = [], 0
    for doc_id, text in ordered:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        want.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    same(got, want)
    one = token_files.read_tokens(spark, path).where("doc_id = 5")
    assert "doc_id" in one._jdf.queryExecution().executedPlan().toString().split("PushedFilters")[1][:80]
    assert one.count() == 1


@pytest.mark.parametrize(("tokenizer", "by_words"), [(queries.WORD_BPE, True), (queries.BYTE_BPE, False)])
def test_tokens_whatever_the_tokenizer_and_the_cache(tokenizer, by_words, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_files, "CACHE_BYTES", 2000)
    monkeypatch.setattr(token_files, "PIECE", 40)
    encode, plain = token_files.WordEncoder(tokenizer), Tokenizer.from_file(tokenizer)
    assert encode.kept.by_words == by_words
    draw = random.Random(3)
    words = ["".join(draw.choice("aZéÀßÿŒΣſ.'7,|*&! \u0301") for _ in range(draw.randint(1, 9))) for _ in range(300)]
    for _ in range(20):
        texts = [" ".join(draw.choices(words, k=50)), None, "", "it's", "x" * 200, " lead\u2003odd <|endoftext|>"]
        ids, n = encode(texts)
        want = [[*plain.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]
        assert n.tolist() == [len(w) for w in want]
        assert ids.tolist() == sum(want, [])


def test_words_are_learnt_once_whatever_their_case_and_marks():
    import pyarrow as pa
    from tokenizers import Tokenizer

    encode, plain = token_files.WordEncoder(queries.WORD_BPE), Tokenizer.from_file(queries.WORD_BPE)
    kept = encode.kept
    texts = ["Grünxq grünxq, GRÜNXQ; grünxq.", None, "\tgrünxq,\r\nzwqv  Grünxq;;; "]
    before = len(kept.number)
    ids, n = encode(pa.array(texts))
    learnt = list(kept.number)[before:]
    assert sorted(w for w in learnt if w[0].isalpha()) == ["grünxq", "zwqv"]
    assert all(w.isalpha() or w in (",", ";", ".", ";;;") for w in learnt)
    want = [[*plain.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]
    assert (n.tolist(), ids.tolist()) == ([len(w) for w in want], sum(want, []))


def test_token_files_are_pruned(spark, tmp_path):
    import pyarrow.orc as orc

    path = str(tmp_path / "tokens")
    table = frame(spark, [(i, f"text of number {i}") for i in range(0, 12000, 2)], "doc_id long, text string")
    token_files.write_tokens(table, path, queries.WORD_BPE, ranges=2)
    parts = sorted(tmp_path.glob("tokens/part-*"))
    files = [orc.ORCFile(p) for p in parts]
    assert sum(f.nrows for f in files) == 6000 and all(f.nstripes == 1 for f in files)
    assert all(f.row_index_stride == 1000 for f in files)
    # Each stripe's index holds Bloom filters of doc_id, so files are larger than without.
    bare = str(tmp_path / "bare")
    token_files.read_tokens(spark, path).coalesce(2).write.option("compression", "zstd").orc(bare)
    assert sum(p.stat().st_size for p in parts) > sum(p.stat().st_size for p in tmp_path.glob("bare/part-*"))
    for doc_id, most in ((2000, 1000), (2001, 0), (99999, 0)):
        one = token_files.read_tokens(spark, path).where(f"doc_id = {doc_id}")
        assert one.count() == (most > 0)
        one.collect()
        scan = one._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
        assert scan.metrics().apply("numOutputRows").value() <= most


def test_tokens_of_a_table(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.WORD_BPE)
    got = {r.doc_id: r for r in queries.op5_token_files(spark, ROOT).collect()}
    at = 0
    for r in spark.read.parquet(f"{ROOT}/documents.parquet").orderBy("doc_id").collect():
        ids = np.array(tokenizer.encode(r.text, add_special_tokens=False).ids + [1], "<u4")
        assert got[r.doc_id][1:] == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_tokens_by_section(spark, rule):
    text = "Head line\nbödy text 'quoted'\n\n\nmore   text\na | b\nc | d\nend"
    rows = [(1, text), (2, None), (3, ""), (1, text), (None, "x\n"), (4, "w " * 50000)]
    got = token_counts.count_sections(docs(spark, rows), queries.BYTE_RANKS, rule=rule).collect()
    encoding, size = token_counts._encoder(queries.BYTE_RANKS)
    want = []
    for doc_id, t in rows:
        data = (t or "").encode()
        begin, kinds = token_counts.line_sections(data)
        owner = np.searchsorted(begin, np.arange(len(data)), "right") - 1
        counts, at = [0] * len(begin), 0
        for token in encoding.encode_ordinary(t or ""):
            own = owner[at : at + size[token]]
            at += size[token]
            best = Counter(own.tolist()).most_common()
            most = min(k for k, n in best if n == best[0][1])
            counts[{"first": own[0], "last": own[-1], "most": most}[rule]] += 1
        edges = [len(data[:b].decode(errors="ignore")) for b in [*begin, len(data)]]
        want += [(doc_id, i, kinds[i], edges[i], edges[i + 1], counts[i]) for i in range(len(begin))]
    same(got, want)


def test_section_tokens_add_up(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.BYTE_BPE)
    got = queries.op10_token_counts(spark, ROOT).groupBy("doc_id").agg(F.sum("n_tokens")).collect()
    texts = spark.read.parquet(f"{ROOT}/documents.parquet").collect()
    same(got, [(r.doc_id, len(tokenizer.encode(r.text, add_special_tokens=False).ids)) for r in texts])


def test_language_of_held_out_texts(spark):
    made = queries.op7_language(spark, "/root/testdata/sf0.01")
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = made.join(table.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == table.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 for r in rows)
    out = [r for r in rows if r.held_out]
    assert np.mean([r.lang == r.lang_pred for r in out]) > 0.97
    assert np.mean([r.rejected for r in rows]) < 0.02


def test_language_of_odd_texts(spark):
    table = spark.read.parquet(f"{ROOT}/documents.parquet")
    content = language.train(table)
    rows = [(1, None), (2, ""), (3, "12 34 !?"), (4, "the and of with that " * 20000), (4, "the and of with that " * 20000)]
    got = {r.doc_id: r for r in language.identify(docs(spark, rows), content).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3
    assert [got[i].rejected for i in (1, 2, 3, 4)] == [True, True, True, False]
    assert got[4].lang_pred == "en"
    kept = language.keep_identified(docs(spark, rows), content)
    assert [r.doc_id for r in kept.collect()] == [4, 4]
    assert kept.columns == docs(spark, rows).columns
    assert language.identify(docs(spark, rows), {}).where("lang_pred <> 'und'").isEmpty()


def test_language_beside_a_column_that_differs_in_case(spark):
    table = spark.read.parquet(f"{ROOT}/documents.parquet")
    content = language.train(table)
    rows = frame(spark, [("12 34", i, "the and of with that " * 20) for i in range(3)], "other string, doc_id long, text string")
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        kept = language.keep_identified(rows.withColumnRenamed("other", "Text"), content)
        assert kept.columns == ["Text", "doc_id", "text"] and kept.count() == 3
    finally:
        spark.conf.unset("spark.sql.caseSensitive")


def test_short_and_few_texts_train(spark):
    """A language of texts under 20 characters is learned, and one long text gives a whole dictionary."""
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    cut = F.expr("case when lang = 'fr' then left(text, 18) else text end")
    labels = table.withColumn("text", cut)
    content = language.train(labels.union(labels))
    assert content == language.train(labels) and set(content) == {"de", "en", "es", "fr"}
    assert 1000 < len(content["fr"]) <= 19 * language.SAMPLE_TEXTS
    assert all(len(c) <= language.SAMPLE_BYTES for c in content.values())
    one = frame(spark, [(1, "mot " * 9000, "fr"), (2, None, "de"), (3, "", "de")], "doc_id long, text string, lang string")
    assert language.train(one) == {"fr": b"mot " * 9000}


def test_licenses(spark):
    apache = licenses.TEMPLATES["Apache-2.0"].replace("applicable", "relevant").replace("governing", "ruling")
    rows = [
        (1, "some words " * 9000 + licenses.TEMPLATES["MIT"] + " more"),
        (2, "Released under the MIT License.\n* Released  under the MIT license"),
        (3, None),
        (4, ""),
        (5, apache),
        (None, "Licensed under CC BY-NC 4.0"),
        (6, "licensed to drive under the bridge, version of the license"),
        (7, licenses.TEMPLATES["MIT"][:150]),
    ]
    got = licenses.scan_licenses(docs(spark, rows)).select("doc_id", "license", "places").collect()
    same(
        got,
        [
            (1, "MIT", 1),
            (2, "MIT-notice", 2),
            (5, "Apache-2.0", 1),
            (5, "Apache-2.0-notice", 1),
            (None, "CC-BY-NC-4.0-notice", 1),
        ],
    )
    assert licenses.scan_licenses(docs(spark, rows), {}).isEmpty()


def test_licenses_that_occur_again_in_prose(spark):
    prose = "this is the work of the people who want to use it and is in the interest of the public to do so "
    notice = licenses.TEMPLATES["GPL-3.0-notice"]
    mit, gap = licenses.TEMPLATES["MIT"], " and the of to in " * 30
    rows = [
        (1, prose * 3 + notice + " " + prose * 3 + notice + " " + prose * 3),
        (2, prose * 9 + mit + gap + mit + " " + prose * 9),
        (3, gap + "released the work under " * 4 + gap + licenses.TEMPLATES["MIT-notice"] + gap + licenses.TEMPLATES["MIT-notice"] + gap),
        (4, prose * 200),
    ]
    got = licenses.scan_licenses(docs(spark, rows)).select("doc_id", "license", "coverage", "places").collect()
    same(got, [(1, "GPL-3.0-notice", 1.0, 2), (2, "MIT", 1.0, 2), (3, "MIT-notice", 1.0, 2)])


def test_licenses_are_told_apart(spark):
    full = licenses.TEMPLATES
    deed = "This work is licensed under a Creative Commons Attribution{} 4.0 International License."
    rows = {
        "Licensed under CC BY 4.0.": {"CC-BY-4.0-notice"},
        "Licensed under CC BY-SA 4.0": {"CC-BY-SA-4.0-notice"},
        "Licensed under CC BY-ND 4.0": {"CC-BY-ND-4.0-notice"},
        "Licensed under CC BY-NC 4.0": {"CC-BY-NC-4.0-notice"},
        "Licensed under CC BY-NC-SA 4.0": {"CC-BY-NC-SA-4.0-notice"},
        "Licensed under CC BY 3.0": set(),
        "Licensed under CC BY-SA 4.0, figures under CC BY 4.0": {"CC-BY-SA-4.0-notice", "CC-BY-4.0-notice"},
        deed.format(""): {"CC-BY-4.0-deed"},
        deed.format("-NonCommercial"): {"CC-BY-NC-4.0-deed"},
        deed.format("-ShareAlike"): {"CC-BY-SA-4.0-deed"},
        deed.format(" Share Alike"): set(),
        "under the GNU General Public License, version 2": {"GPL-2.0-notice"},
        "under the GNU General Public License, version 3.0 or later": {"GPL-3.0-notice"},
        "under the terms of the GNU Lesser General Public License, version 3": {"LGPL-3.0-notice"},
        "under the GNU Lesser General Public License, version 2.1": {"LGPL-2.1-notice"},
        "under the GNU Affero General Public License, version 3": {"AGPL-3.0-notice"},
        "Licensed under the Apache License, Version 3.0.": set(),
        "Licensed under the Apache License, Version 2.0.": {"Apache-2.0-notice"},
        full["Apache-2.0"].replace("2.0", "3.0"): set(),
        "Released under the ISC License": {"ISC-notice"},
        "Released under the BSD License": set(),
        "Released under the MIT License.": {"MIT-notice"},
        full["GPL-3.0"].replace("version 3 of", "version 2 of"): {"GPL-2.0"},
        full["GPL-3.0"].replace("version 3 of", "version 3.0 of"): {"GPL-3.0"},
        full["GPL-3.0"].replace("GNU General", "GNU Lesser General"): set(),
        full["GPL-3.0"].replace("GNU General", "GNU Lesser General", 1): set(),
        full["AGPL-3.0"]: {"AGPL-3.0"},
        full["BSD-2-Clause"]: {"BSD-2-Clause"},
        full["BSD-3-Clause"].replace("1.", "*").replace("2.", "*").replace("3.", "*"): {"BSD-3-Clause"},
        full["ISC"].replace("provided that the above copyright notice and this permission notice appear in all copies", ""): set(),
        full["MIT"].replace(full["MIT"][full["MIT"].index(", subject to") : full["MIT"].index("THE SOFTWARE")], ". "): set(),
    }
    got = licenses.scan_licenses(docs(spark, list(enumerate(rows)))).collect()
    for n, (text, want) in enumerate(rows.items()):
        assert {r.license for r in got if r.doc_id == n} == want, text


def test_long_gaps_lose_nothing(monkeypatch):
    draw = random.Random(3)
    for _ in range(100):
        a, b = ([draw.randrange(4) for _ in range(draw.randrange(30))] for _ in "ab")
        whole = len(licenses._common(a, b))
        if a and b:
            i, j = licenses._split(a, b)
            assert len(licenses._common(a[:i], b[:j])) + len(licenses._common(a[i:], b[j:])) == whole


def test_patience_aligns_what_is_common():
    draw = random.Random(2)
    for _ in range(200):
        a = [draw.randrange(9) for _ in range(draw.randrange(25))]
        b = [draw.randrange(9) for _ in range(draw.randrange(25))]
        run = licenses.patience(a, b)
        assert all(a[i] == b[j] for i, j in run)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(run, run[1:], strict=False))
    assert licenses.patience("abcdef", "xabcyef") == [(0, 1), (1, 2), (2, 3), (4, 5), (5, 6)]


def test_licenses_of_a_table(spark):
    root = "/root/testdata/sf0.01"
    got = {(r.doc_id, r.license) for r in queries.op8_licenses(spark, root).collect()}
    want = set()
    for r in spark.read.parquet(f"{root}/documents.parquet").collect():
        text = b" " + b" ".join(licenses.words(r.text)) + b" "
        want |= {(r.doc_id, n) for n, t in licenses.TEMPLATES.items() if b" " + b" ".join(licenses.words(t)) + b" " in text}
    assert want and want == got


def test_empty_tables(spark):
    none = docs(spark, [(1, "x")]).limit(0)
    items = frame(spark, [(1, "x")], "item_id long, text string")
    some = docs(spark, [(1, "x")])
    for made in (
        substring_dedup.remove_repeats(none),
        minhash.near_duplicates(none),
        minhash.keep_one(none),
        decontaminate.find_leaks(none, items),
        decontaminate.find_leaks(some, items.limit(0)),
        token_files.encode_to_orc(none, queries.WORD_BPE),
        token_counts.count_sections(none, queries.BYTE_RANKS),
        language.identify(none, language.train(none)),
        licenses.scan_licenses(none),
    ):
        assert made.count() == 0
