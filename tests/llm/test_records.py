"""Spelling variants, main text of pages and Merkle witnesses against brute force."""

from __future__ import annotations

import hashlib
import html
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest
from helpers import clashing, frame, same

from martlet.llm import html_text, merkle, queries, spelling

ROOT = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def spellings(rows):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lowered(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            k = h % len(run)
            n[run[:k] + run[k + 1 :] if h % 31 == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}
    others = {w: [x for x in n if near(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(others[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        yield w, form[w], root, n[w], len(others[w]), n.get(form[w])


def spelled(seed):
    draw = random.Random(seed)
    words = ["".join(draw.choice("abé") for _ in range(draw.randint(7, 9))) for _ in range(60)] + ["zzzzzzzz", "zzzzzzzzz", "z" * 3000, "z" * 3001]
    rows = []
    for i in range(40):
        rows.append((i, " ".join(words[min(int(draw.expovariate(0.1)), 63)].upper() for _ in range(60)) + " ÀÿÀÿÀÿÀ ×÷×÷×÷× ab1cdefgh"))
    return [*rows, (None, rows[0][1]), rows[1], (99, None), (100, ""), (101, "z" * 3000 + ", " + "z" * 3001)]


def documents(spark, rows):
    return clashing(frame(spark, [(*r, "en", "s", 1) for r in rows], DOCS)).withColumnsRenamed({"n": "form", "h": "word"})


@pytest.mark.parametrize("state_words", [2, 7, spelling.STATE_WORDS])
def test_spellings_whatever_a_task_takes(spark, state_words):
    rows = spelled(state_words)
    same(spelling.group_spellings(documents(spark, rows), state_words=state_words).collect(), spellings(rows))


def test_spellings_of_a_table(spark):
    table = spark.read.parquet(f"{ROOT}/documents.parquet").select("doc_id", "text")
    same(queries.op11_spelling(spark, ROOT).collect(), spellings([tuple(r) for r in table.collect()]))
    assert spelling.group_spellings(table.limit(0)).count() == 0


def test_acceptor_is_minimal_and_numbers_its_words():
    words = sorted({"", "a", "ab", "abc", "b", "bb", "bc", "cbc", "dbc"})
    a = spelling.Acceptor(words)
    assert a.words[a.start] == len(words)
    states = {(final, tuple((s, t) for s, t, _ in arcs)) for final, arcs in zip(a.final, a.arcs, strict=True)}
    assert len(states) == len(a.final)
    found = {(words[i], words[j]) for i, j in spelling.near_pairs(words)}
    assert {tuple(sorted(p)) for p in found} == {(x, y) for x in words for y in words if x < y and near(x, y)}
    assert len(found) == len(spelling.near_pairs(words))


def digest(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def leaf_of(row, tampered=False):
    values = list(row)
    if tampered and values[4] is not None:
        values[4] = lowered(values[4])
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels_of(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])
    return levels


def sides_of(levels, i):
    for level in levels[:-1]:
        first = i // 16 * 16
        yield level[first:i], level[i + 1 : first + 16]
        i //= 16


def proofs(rows):
    sources = {}
    for row in rows:
        sources.setdefault(row[1], []).append(row)
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        sources[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
    trees = [levels_of([leaf_of(r) for r in sources[s]]) for s in order]
    top = levels_of([t[-1][0] for t in trees])
    for k, s in enumerate(order):
        for i, row in enumerate(sources[s]):
            sides = [*sides_of(trees[k], i), *sides_of(top, k)]
            own = leaf_of(row, row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0)
            for left, right in sides:
                own = digest(*left, own, *right)
            proof = digest(*(x for left, right in sides for x in left + right))
            yield row[0], trees[k][0][i], trees[k][-1][0], top[-1][0], proof, own, own == top[-1][0]


def leaves(counts, seed=1):
    """doc_id, source, lang, n_chars, text; ``counts`` rows of each source."""
    draw = random.Random(seed)
    ids = iter(draw.sample(range(10**6), 10**5))
    rows = [(next(ids), s, "en", 3, draw.choice(("Abc", "abc", "É", ""))) for s, n in counts.items() for _ in range(n)]
    odd = [(None, None, None, None, None), (-7, "é", None, 5, None), (12, "z", "", 0, "Long " * 50000)]
    rows += odd + [rows[0], rows[0], (None, "a", "en", 1, "X")]
    draw.shuffle(rows)
    return rows


def as_documents(spark, rows):
    made = frame(spark, rows, "doc_id long, source string, lang string, n_chars long, text string")
    return clashing(made).withColumnsRenamed({"node": "digest", "root": "leaf", "h": "tree", "v": "pos"})


@pytest.mark.parametrize("n", [1, 15, 16, 17, 256, 257, 4095, 4096])
def test_appender_folds_a_tree_of_one_block(n):
    levels = levels_of([digest(str(i)) for i in range(n)])
    appender = merkle.Appender()
    for leaf in levels[0]:
        appender.append(leaf)
    assert appender.finish(True) == levels[-1][0]
    for i in {0, n // 2, n - 1}:
        made = [(run[:k], run[k + 1 :]) for run, k in appender.witness[i]]
        assert made == list(sides_of(levels, i))


def test_proofs(spark):
    rows = leaves({"a": 300, "b": 17, "c": 16, "d": 1, "e": 257, **{f"x{i}": 2 for i in range(20)}})
    same(merkle.manifest(as_documents(spark, rows)).collect(), proofs(rows))


def test_proofs_over_several_rounds(spark):
    rows = leaves({"hot": 3 * merkle.BLOCK + 17, "b": merkle.BLOCK, "c": merkle.BLOCK + 1, "d": 5})
    same(merkle.manifest(as_documents(spark, rows)).collect(), proofs(rows))


def test_proofs_of_no_rows_and_of_one(spark):
    assert merkle.manifest(frame(spark, [], "doc_id long, source string, lang string, n_chars long, text string")).count() == 0
    one = [(5, None, "en", 1, "a")]
    same(merkle.manifest(as_documents(spark, one)).collect(), proofs(one))


@pytest.mark.parametrize("name", ["op11_spelling", "op13_merkle"])
def test_sql_twins(spark, name):
    connection = duckdb.connect()
    connection.execute(f"create view documents as select * from '{ROOT}/documents.parquet'")
    found = connection.execute(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, ROOT)
    assert [d[0] for d in found.description] == got.columns
    same(got.collect(), found.fetchall())


@pytest.fixture(scope="module")
def model():
    return html_text.default_model()


def test_main_text_of_layouts_that_were_not_trained_on(model):
    """Held-out accuracy: pages of another seed, block by block and page by page."""
    right = wrong = missed = whole = 0
    pages = html_text.sample_pages(300, seed=4711)
    for page, main in pages:
        got = [t for t in html_text.main_text(page, model).split("\n\n") if t]
        both = sum((Counter(got) & Counter(main)).values())
        right, wrong, missed = right + both, wrong + len(got) - both, missed + len(main) - both
        whole += got == main
    assert right / (right + wrong) > 0.97 and right / (right + missed) > 0.97
    assert whole / len(pages) > 0.85


def test_main_text_of_a_table(spark, model):
    """In these pages the article is one element of paragraphs and a heading, so its text can be cut out by pattern."""
    want = []
    for page_id, url, page in spark.read.parquet(f"{ROOT}/pages.parquet").select("page_id", "url", "html").collect():
        article = re.search("<article>(.*?)</article>", page, re.DOTALL)[1].replace("<br>", " ")
        texts = [" ".join(html.unescape(re.sub("<[^>]*>", "", t)).split()) for t in re.split("</?p>|</?h1>", article)]
        text = "\n\n".join(t for t in texts if t)
        want.append((page_id, url, text, len(text)))
    same(queries.op12_html_text(spark, ROOT).collect(), want)


CASES = [
    (None, []),
    ("", []),
    ("plain  text &amp; more", ["plain text & more"]),
    ("<p>a<p>b<ul><li>c<li>d</ul>e", ["a", "b", "c", "d", "e"]),
    ("<div>a <b>b</b>\n<br>c&nbsp;d&#x41;</div>", ["a b c dA"]),
    ("<table><tr><td>a<td>b<tr><td>c</table>", ["a", "b", "c"]),
    ("x<script>var a = '<p>no</p>';</script><style>p{}</style><!-- <p>no</p> -->y", ["xy"]),
    ("<title>no</title><select><option>no</select><textarea><p>no</textarea><P>Yes", ["Yes"]),
    ("a < b <p title='x > y'>c</p><p title=\"open>d</p>", ["a < b", "c", "d"]),
    ("<b><p>a</b>b</p></div></p>c", ["ab", "c"]),
    ("a<!-- never closed <p>no", ["a"]),
    ("a<p", ["a"]),
    ("a<!-- x", ["a"]),
    ("<script>never closed <p>no</p>", []),
    ("<a" * 20000, []),
]


@pytest.mark.parametrize(("page", "texts"), CASES)
def test_blocks(page, texts):
    assert [b.text for b in html_text.blocks_of(page)] == texts


def test_main_text_of_odd_rows(spark, model):
    long = "<article>" + "<p>A long paragraph follows the one before it.</p>" * 30000 + "</article><footer>© x</footer>"
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<nav><a href=x>y</a></nav>"), (3, "v", long), (3, "v", long)]
    pages = clashing(frame(spark, rows, "page_id long, url string, html string")).withColumnRenamed("n", "text")
    got = html_text.extract_text(pages).collect()
    assert [(r.page_id, r.url) for r in got] == [r[:2] for r in rows]
    assert [r.text for r in got[:3]] == ["", "", ""]
    assert got[3].text == got[4].text == "\n\n".join(["A long paragraph follows the one before it."] * 30000)
    assert all(r.n_chars == len(r.text) for r in got)
    assert html_text.extract_text(pages.limit(0)).count() == 0


def test_a_model_of_own_pages():
    keep, drop = "<div class=keep><p>{} kept words</p></div>", "<div class=drop><p>{} other words</p></div>"
    pages = [((keep + drop if i % 2 else drop + keep).format(i, i), [f"{i} kept words"]) for i in range(20)]
    model = html_text.train(pages, rounds=80)
    assert html_text.main_text("<div class=drop><p>a b c</p></div><div class=keep><p>d e f</p></div>", model) == "d e f"
