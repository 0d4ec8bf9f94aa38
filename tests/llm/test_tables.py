"""Operators on pages, vectors and sources, and the pipeline, against brute force and SQL."""

from __future__ import annotations

import re
import zlib

import duckdb
import numpy as np
from helpers import clashing, frame, same
from test_texts import classes

import corpus_pipeline
from martlet.llm import components, embedding_dedup, mixing, queries, url_filter

ROOT = "/root/testdata/sf0.001"


def judged(url, rules):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest)[0]
    path = re.split("[?#]", rest[len(host) :])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fit = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    if not fit:
        return host, path, None, "allow"
    best = max(fit, key=lambda r: (len(r.host + r.path), len(r.host)))
    return host, path, best.host + best.path, best.verdict


ODD = [
    None, "", "nourl", "http://NET", "http://a.net/", "http://Example.NET/en/x?y", "https://x.org/fr/", "://?",
    "http://example.com/de", "http://éxample.com/de/ü", "http://.net/\n/x#://", "http://a.example.com/de/#x", "http://notexample.net/en/",
    "x" * 100000 + "://net/",
]


def test_urls(spark):
    rows = [*enumerate(ODD), (3, ODD[3]), (None, "http://a.net/")]
    pages = clashing(frame(spark, rows, "page_id long, url string"))
    same(url_filter.judge(pages, queries.RULES).collect(), [(i, *judged(u, queries.RULES)) for i, u in rows])
    assert url_filter.judge(pages.limit(0), queries.RULES).count() == 0
    assert {r.verdict for r in url_filter.judge(pages, []).collect()} == {"allow"}


def test_cascade_is_exact_for_many_rules(spark):
    rules = {
        (f"h{i % 350}.com", "/" if i % 2 else f"/p{i % 13}/"): "block" if i % 3 else "allow" for i in range(700)
    }
    rules = [url_filter.Rule(*k, v) for k, v in rules.items()]
    pages = spark.range(4000).selectExpr(
        "id as page_id", "concat('http://w', id % 3, '.h', id % 2900, '.com/p', id % 17, '/x') as url"
    )
    want = [(r.page_id, *judged(r.url, rules)) for r in pages.collect()]
    same(url_filter.judge(pages, rules).collect(), want)


def test_first_filter_passes_about_as_many_keys_as_are_listed():
    for listed, others in [(4, 100), (4, 200_000), (500, 200_000)]:
        size = max(8, -(-listed * url_filter._bits(listed, others) // 8))
        keys = np.arange(1, listed + others + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        at = url_filter.places(keys[:listed], 8 * size, 0).ravel().astype(np.int64)
        bits = np.zeros(size, np.uint8)
        np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        assert url_filter.holds(bits, keys[:listed], 0).all()
        assert url_filter.holds(bits, keys[listed:], 0).sum() <= 4 * listed + 10


def test_vectors_of_extreme_length(spark):
    rows = [(1, [1e-200, 0.0]), (2, [2e-200, 0.0]), (3, [1e200, 0.0]), (4, [1.0, 0.0]), (5, [0.0, 1e300]), (6, [0.0, 5e-324])]
    made = embedding_dedup.link_vectors(frame(spark, rows, "vec_id long, embedding array<double>"))
    got = made.select("vec_id", "n_links", "component_id").collect()
    same(got, [*((i, 3, 1) for i in range(1, 5)), (5, 1, 5), (6, 1, 5)])


def linked(rows):
    ok = [
        j
        for j, (i, v) in enumerate(rows)
        if i is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v)
    ]
    width = max(len(rows[j][1]) for j in ok)
    x = np.array([rows[j][1] + [0.0] * (width - len(rows[j][1])) for j in ok])
    norm = np.linalg.norm(x, axis=1)
    near = x @ x.T >= 0.9 * np.outer(norm, norm)
    np.fill_diagonal(near, False)
    low = np.array([rows[j][0] for j in ok])
    while True:
        new = np.array([min(low[k], low[near[k]].min(initial=low[k])) for k in range(len(ok))])
        if (new == low).all():
            break
        low = new
    out = {j: (i, 0, i, None if i is None else True) for j, (i, _) in enumerate(rows)}
    out |= {j: (rows[j][0], int(near[k].sum()), int(low[k]), bool(low[k] == rows[j][0])) for k, j in enumerate(ok)}
    return [out[j] for j in range(len(rows))]


def test_vectors(spark):
    draw = np.random.default_rng(1)
    base = draw.normal(size=(30, 16))
    rows = [(i, [float(c) for c in base[i % 30] + draw.normal(size=16) * 0.05]) for i in range(400)]
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [0.0] * 16, [nan] * 16, [None] + [1.0] * 15, [inf] * 16, rows[0][1], rows[0][1], [1.0, 2.0], [2.0, 4.0]]
    rows += [*enumerate(odd, 1000), (None, rows[0][1]), rows[5]]
    vectors = clashing(frame(spark, rows, "vec_id long, embedding array<double>"))
    same(embedding_dedup.link_vectors(vectors).collect(), linked(rows))
    assert embedding_dedup.link_vectors(vectors.limit(0)).count() == 0


def test_blocks_of_a_cell_give_the_same_links(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 7)
    draw = np.random.default_rng(3)
    base = draw.normal(size=(2, 12))
    rows = [(i, [float(c) for c in base[i % 2] + draw.normal(size=12) * 0.1]) for i in range(80)]
    same(embedding_dedup.link_vectors(frame(spark, rows, "vec_id long, embedding array<float>")).collect(), linked(
        [(i, [float(np.float32(c)) for c in v]) for i, v in rows]
    ))


def test_recall_at_the_threshold(spark):
    draw = np.random.default_rng(4)
    a = draw.normal(size=(1500, 32))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = draw.normal(size=a.shape)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    pairs = 0.905 * a + np.sqrt(1 - 0.905**2) * b
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate((a, pairs)))]
    made = embedding_dedup.link_vectors(frame(spark, rows, "vec_id long, embedding array<double>"))
    assert made.where("n_links > 0").count() / 3000 > 0.97


def test_vectors_of_a_table(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{ROOT}/embeddings.parquet").collect()]
    same(queries.op3_embedding_dedup(spark, ROOT).collect(), linked(rows))


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 102), (101, 102), (7, 7), (200, 150), (5, 4)]
    got = components.components(frame(spark, links, "a long, b long")).collect()
    same(got, [(i, 0) for i in range(1, 41)] + [(101, 100), (102, 100), (200, 150)])


def test_queries_equal_their_sql(spark):
    con = duckdb.connect()
    for name in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{ROOT}/{name}.parquet'")
    for name, sql in queries.oracle_sql().items():
        got = queries.queries()[name](spark, ROOT)
        at = con.execute(sql)
        names = [c[0] for c in at.description]
        assert sorted(names) == sorted(got.columns), name
        same(got.select(*names).collect(), at.fetchall())


def plan(**more):
    return mixing.Plan(domain_of={"a": "x", "b": "x", "c": "y"}, domains={"x": 1, "y": 1}, max_epochs=2, **more)


def mixed(spark, rows, **more):
    df = clashing(frame(spark, rows, "doc_id long, text string, lang string, source string"))
    taken = mixing.mix_sources(df, plan(**more)).collect()
    again = mixing.take(df, plan(**more))
    assert again.columns == df.columns
    same(again.select("doc_id").collect(), [(r.doc_id,) for r in taken])
    return taken


def test_shortage_goes_to_siblings_first(spark):
    """Domain y is short: x takes the rest. Within x, source a is short: b takes its rest before y gets any."""
    rows = [(i, "w w", "en", "a") for i in range(5)] + [(100 + i, "w w", "en", "b") for i in range(100)]
    rows += [(300 + i, "w w", "en", "c") for i in range(40)]
    taken = mixed(spark, rows, budget_share=700)  # 203 of 290 tokens
    sums = {s: sum(r.n_tokens for r in taken if r.source == s) for s in "abc"}
    assert sums == {"a": 20, "b": 82, "c": 102}  # 101 and 102 (one more each for the text that reaches it)
    assert max(r.epoch for r in taken if r.source == "a") == 2


def test_odd_sources(spark):
    rows = [(1, None, "en", "a"), (2, "", "en", "a"), (3, "w", None, None), (4, "w w w", "en", "a"), (4, "w w w", "en", "a")]
    rows += [(None, "w", "en", "a"), (5, "w " * 50000, "en", "c")]
    taken = mixed(spark, rows, budget_share=1000)
    assert {r.doc_id for r in taken} <= {3, 4, 5, None}
    assert sum(r.doc_id == 4 for r in taken) % 2 == 0
    df = frame(spark, rows, "doc_id long, text string, lang string, source string")
    assert mixing.mix_sources(df.limit(0), plan()).count() == 0
    assert mixing.mix_sources(df, plan(budget_share=0)).count() == 0


def test_pipeline(spark):
    """Every stage does what its operator says on what the stage before kept."""
    docs = spark.read.parquet(f"{ROOT}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, ROOT).cache()
        assert after.columns == docs.columns, name
        assert 0 < after.count(), name
        assert after.join(before, "doc_id", "left_anti").isEmpty(), name
        before = after
    want = [(r.doc_id,) for r in before.select("doc_id").collect()]
    same(corpus_pipeline.run(spark, ROOT).select("doc_id").collect(), want)
    assert len(corpus_pipeline.STAGES) == 5


def test_stages_against_brute_force(spark):
    """Near duplicates, benchmark items and token ids: which rows stay, with their texts, and the digest of the files."""
    from tokenizers import Tokenizer

    table = spark.read.parquet(f"{ROOT}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{ROOT}/benchmark.parquet").collect()]
    stages = dict(corpus_pipeline.STAGES)
    rows = [(r.doc_id, r.text) for r in table.collect()]
    low = {i for i, _, kept in classes(rows) if kept}
    one = stages["near_duplicates"](spark, table, ROOT).cache()
    same(one.select("doc_id", "text").collect(), [r for r in rows if r[0] in low])
    clean = [r for r in rows if r[0] in low and not any(t in r[1] for t in items)]
    left = stages["decontaminate"](spark, one, ROOT).cache()
    got = {tuple(r) for r in left.select("doc_id", "text").collect()}
    assert got <= set(clean) and len(clean) - len(got) <= 2  # texts that hold an item in part
    tokenizer, want, at = Tokenizer.from_file(queries.WORD_BPE), [], 0
    for doc_id, text in sorted(got):
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 1], "<u4")
        want.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    same(stages["tokens"](spark, left, ROOT).collect(), want)
