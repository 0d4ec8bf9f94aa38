"""One query for each corpus operator, over its whole table, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from martlet.llm import (
    decontaminate,
    embedding_dedup,
    html_text,
    language,
    licenses,
    merkle,
    minhash,
    mixing,
    spelling,
    substring_dedup,
    token_counts,
    token_files,
    url_filter,
)
from martlet.llm.common import table

#: Files of public tokenizers, which every machine has.
WORD_BPE = str(public_tokenizers.path("word_bpe_49k.json"))
BYTE_BPE = str(public_tokenizers.path("byte_bpe_50k.json"))
BYTE_RANKS = str(public_tokenizers.path("byte_bpe_50k.tiktoken"))

RULES = [
    url_filter.Rule("net", "/", "block"),
    url_filter.Rule("example.net", "/en/", "allow"),
    url_filter.Rule("example.com", "/de/", "block"),
    url_filter.Rule("org", "/fr/", "allow"),
]

MIX = mixing.Plan(
    domain_of={f"src{i}": "web" if i == 0 else "reference" if i < 7 else "forum" for i in range(20)},
    domains={"web": 2, "reference": 5, "forum": 3},
    languages={"en": 6, "de": 2, "fr": 1, "es": 1},
    sources={"src1": 3},
)


def op1_substring_dedup(spark: SparkSession, root: str) -> DataFrame:
    kept = substring_dedup.remove_repeats(table(spark, root, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_url_filter(spark: SparkSession, root: str) -> DataFrame:
    return url_filter.judge(table(spark, root, "pages"), RULES)


def op3_embedding_dedup(spark: SparkSession, root: str) -> DataFrame:
    return embedding_dedup.link_vectors(table(spark, root, "embeddings"))


def op4_decontaminate(spark: SparkSession, root: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, root, "documents"), table(spark, root, "benchmark"))


def op5_token_files(spark: SparkSession, root: str) -> DataFrame:
    return token_files.encode_to_orc(table(spark, root, "documents"), WORD_BPE)


def op6_mixing(spark: SparkSession, root: str) -> DataFrame:
    return mixing.mix_sources(table(spark, root, "documents"), MIX)


def op7_language(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents")
    made = language.identify(docs, language.train(docs))
    return made.select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op8_licenses(spark: SparkSession, root: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, root, "documents"))


def op9_minhash(spark: SparkSession, root: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, root, "documents"))


def op10_token_counts(spark: SparkSession, root: str) -> DataFrame:
    return token_counts.count_sections(table(spark, root, "documents"), BYTE_RANKS)


def op11_spelling(spark: SparkSession, root: str) -> DataFrame:
    return spelling.group_spellings(table(spark, root, "documents"))


def op12_html_text(spark: SparkSession, root: str) -> DataFrame:
    return html_text.extract_text(table(spark, root, "pages"))


def op13_merkle(spark: SparkSession, root: str) -> DataFrame:
    return merkle.manifest(table(spark, root, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = (
        op1_substring_dedup,
        op2_url_filter,
        op3_embedding_dedup,
        op4_decontaminate,
        op5_token_files,
        op6_mixing,
        op7_language,
        op8_licenses,
        op9_minhash,
        op10_token_counts,
        op11_spelling,
        op12_html_text,
        op13_merkle,
    )
    return {f.__name__: f for f in made}


_WORDS_GONE = r"""
WITH texts AS (
  SELECT doc_id, ROW_NUMBER() OVER () AS row_id,
         regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
starts AS (
  SELECT row_id, i, array_to_string(words[i:i + 34], ' ') AS seq
  FROM (SELECT row_id, words, UNNEST(range(1, len(words) - 33)) AS i FROM texts WHERE len(words) >= 35)),
twice AS (SELECT seq FROM starts GROUP BY seq HAVING COUNT(*) > 1),
gone AS (SELECT DISTINCT row_id, UNNEST(range(i, i + 35)) AS place FROM starts JOIN twice USING (seq)),
each_word AS (SELECT row_id, UNNEST(words) AS word, UNNEST(range(1, len(words) + 1)) AS place FROM texts),
kept AS (
  SELECT row_id, string_agg(word, ' ' ORDER BY place) AS kept, COUNT(*) AS n
  FROM each_word ANTI JOIN gone USING (row_id, place) GROUP BY row_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - COALESCE(n, 0) AS BIGINT) AS n_removed,
       sha256(COALESCE(kept, '')) AS kept_sha256
FROM texts LEFT JOIN kept USING (row_id)"""

_URLS = """
WITH urls AS (
  SELECT page_id,
         translate(CASE WHEN url LIKE '%://%' THEN regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1) ELSE '' END,
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         CASE WHEN url LIKE '%://%' THEN regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages),
rules(rule_host, rule_path, verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
fit AS (
  SELECT page_id, rule_host || rule_path AS rule, verdict,
         ROW_NUMBER() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC) AS nth
  FROM urls JOIN rules ON (host = rule_host OR host LIKE '%.' || rule_host) AND starts_with(path, rule_path))
SELECT urls.page_id, host, path, rule, COALESCE(verdict, 'allow') AS verdict
FROM urls LEFT JOIN fit ON fit.page_id = urls.page_id AND nth = 1"""

_VECTORS = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
good AS (SELECT * FROM v WHERE list_inner_product(e, e) > 0),
links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM good a JOIN good b ON a.vec_id <> b.vec_id
  AND list_inner_product(a.e, b.e) >= 0.9 * sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))),
reach(x, y) AS (SELECT x, y FROM links UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x),
low AS (SELECT x, MIN(y) AS y FROM reach GROUP BY x),
many AS (SELECT x, COUNT(*) AS n FROM links GROUP BY x)
SELECT vec_id, COALESCE(n, 0) AS n_links, LEAST(vec_id, COALESCE(y, vec_id)) AS component_id,
       vec_id = LEAST(vec_id, COALESCE(y, vec_id)) AS kept
FROM v LEFT JOIN low ON low.x = vec_id LEFT JOIN many ON many.x = vec_id"""


def _case(column: str, weights: dict, other: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in weights.items()) + f" ELSE {other} END"


def _mix_sql() -> str:
    """Budgets level by level, then the texts of each epoch in seeded order."""
    word = r"[^ \t\n\x0B\f\r]+"
    steps = [
        f"""
rows_ AS (SELECT doc_id, COALESCE(lang, '?') AS lang, COALESCE(source, '?') AS source,
  {_case("source", dict(MIX.domain_of), repr(MIX.other_domain))} AS domain,
  CAST(COALESCE(len(regexp_extract_all(text, '{word}')), 0) AS BIGINT) AS n_tokens FROM documents),
leaves AS (SELECT domain, lang, source, SUM(n_tokens) AS tokens FROM rows_ GROUP BY ALL),
caps AS (SELECT *, tokens * {MIX.max_epochs} AS cap FROM leaves WHERE tokens > 0),
given0 AS (SELECT LEAST((SELECT SUM(cap) FROM caps), (SELECT SUM(tokens) * {MIX.budget_share} // 1000 FROM leaves)) AS budget)"""
    ]
    above: list[str] = []
    for level, child in enumerate(mixing.LEAF):
        names = ", ".join([*above, child])
        part = f"PARTITION BY {', '.join(above)}" if above else ""
        using = f"JOIN given{level} USING ({', '.join(above)})" if above else f", given{level}"
        keys = f"{', '.join(above)}, " if above else ""
        steps.append(f"""
nodes{level} AS (SELECT {names}, cap, budget, {_case(child, dict(MIX.weights(level)), "1")} AS w
  FROM (SELECT {names}, SUM(cap) AS cap FROM caps GROUP BY ALL) {using}),
fill{level} AS (SELECT *,
    COALESCE(SUM(cap) OVER ({part} ORDER BY CAST(cap AS DOUBLE) / w, {child} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    SUM(w) OVER ({part} ORDER BY CAST(cap AS DOUBLE) / w, {child} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
  FROM nodes{level}),
flag{level} AS (SELECT *, (budget - before) * w >= cap * rest AS whole FROM fill{level}),
open{level} AS (SELECT *, budget - SUM(CASE WHEN whole THEN cap ELSE 0 END) OVER ({part}) AS left_,
    SUM(CASE WHEN whole THEN 0 ELSE w END) OVER ({part}) AS open_w FROM flag{level}),
part{level} AS (SELECT *, CASE WHEN whole THEN cap ELSE left_ * w // open_w END AS part_ FROM open{level}),
over{level} AS (SELECT *, budget - SUM(part_) OVER ({part}) AS over_,
    ROW_NUMBER() OVER ({part} ORDER BY whole, {child}) AS nth FROM part{level}),
given{level + 1} AS (SELECT {keys}{child}, part_ + CASE WHEN NOT whole AND nth <= over_ THEN 1 ELSE 0 END AS budget FROM over{level})""")
        above.append(child)
    steps.append(f"""
plans AS (SELECT domain, lang, source, budget // tokens AS epochs, budget % tokens AS rest
  FROM leaves JOIN given3 USING (domain, lang, source) WHERE budget > 0),
keyed AS (SELECT rows_.*, epochs, rest,
    CAST('0x' || substr(md5('{MIX.seed}:' || CAST(epochs + 1 AS BIGINT) || ':' || COALESCE(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS key
  FROM rows_ JOIN plans USING (domain, lang, source) WHERE n_tokens > 0),
sums AS (SELECT *, SUM(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY key)
    - SUM(n_tokens) OVER (PARTITION BY domain, lang, source, key) AS upto FROM keyed),
taken AS (SELECT *, CAST(epochs AS INTEGER) + CASE WHEN upto < rest THEN 1 ELSE 0 END AS copies FROM sums)
SELECT doc_id, domain, lang, source, CAST(UNNEST(range(1, copies + 1)) AS INTEGER) AS epoch, n_tokens FROM taken""")
    return "WITH " + ",".join(steps)


# The checksum of bytes: its 256-entry table by the polynomial, then one byte after another.
_CRC = """
crc AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda v, x: CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END) ORDER BY i) AS t
  FROM (SELECT CAST(UNNEST(range(256)) AS BIGINT) AS i))"""
_CRC_OF = "xor(list_reduce([4294967295] || {bytes}, lambda a, b: xor(a >> 8, t[xor(a & 255, b) + 1])), 4294967295)"

_SPELLING = r"""
WITH RECURSIVE {crc},
runs AS (
  SELECT id, run, COUNT(*) AS n FROM (
    SELECT COALESCE(CAST(doc_id AS VARCHAR), '') AS id, UNNEST(regexp_extract_all(
      translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents)
  WHERE length(run) >= 7 GROUP BY ALL),
bytes AS (
  SELECT run, n, flatten(list_transform(string_split(id || ':' || run, ''), lambda c:
    CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [195, unicode(c) - 64] END)) AS b FROM runs),
sums AS (SELECT run, n, {crc_of} AS h FROM bytes, crc),
slipped AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM sums),
words AS (SELECT word, CAST(SUM(n) AS BIGINT) AS n FROM slipped WHERE length(word) >= 7 GROUP BY word HAVING SUM(n) >= 2),
less AS (
  SELECT word, n, k, substr(word, 1, k) || chr(1) || substr(word, k + 2) AS cut, substr(word, 1, k) || substr(word, k + 2) AS short
  FROM (SELECT word, n, UNNEST(range(length(word))) AS k FROM words)),
longer AS (SELECT DISTINCT less.word, less.n, words.word AS near, words.n AS near_n FROM less JOIN words ON words.word = less.short),
pairs AS (
  SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM less a JOIN less b ON a.cut = b.cut AND a.word <> b.word
  UNION ALL SELECT * FROM longer UNION ALL SELECT near, near_n, word, n FROM longer),
best AS (
  SELECT *, COUNT(*) OVER (PARTITION BY word) AS n_near, ROW_NUMBER() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS nth FROM pairs),
forms AS (SELECT word, near AS form, near_n AS form_n FROM best WHERE nth = 1 AND near_n >= 10 * n),
path(word, root, step) AS (
  SELECT word, form, 1 FROM forms
  UNION ALL SELECT path.word, forms.form, step + 1 FROM path JOIN forms ON forms.word = path.root),
roots AS (SELECT word, arg_max(root, step) AS root FROM path GROUP BY word)
SELECT words.word, form, COALESCE(root, words.word) AS root, words.n, COALESCE(n_near, 0) AS n_near, form_n
FROM words LEFT JOIN forms USING (word) LEFT JOIN roots USING (word)
LEFT JOIN (SELECT DISTINCT word, n_near FROM best) USING (word)"""


def _hash_sql(text: str) -> str:
    values = ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text)
    return "sha256(" + " || ".join(f"COALESCE(strlen({v}) || ':' || {v}, '-')" for v in values) + ")"


def _grown_sql(name: str, base: str) -> str:
    """Nodes of every level over ``base`` (tree, pos, h, n), and each node's run with its place in it."""
    return f"""
{name}(tree, level, pos, h, n) AS (
  SELECT tree, 0, pos, h, n FROM {base}
  UNION ALL
  SELECT tree, level + 1, pos // 16, sha256(string_agg(h, '' ORDER BY pos)), MAX((n + 15) // 16) FROM {name} WHERE n > 1 GROUP BY tree, level, pos // 16),
{name}_runs AS (SELECT tree, level, pos // 16 AS run, list(h ORDER BY pos) AS hs FROM {name} WHERE n > 1 GROUP BY ALL),
{name}_sides AS (
  SELECT b.tree, b.pos, level, array_to_string(list_slice(hs, 1, nth), '') AS l, array_to_string(list_slice(hs, nth + 2, 16), '') AS r
  FROM (SELECT *, (b.pos // CAST(pow(16, level) AS BIGINT)) % 16 AS nth FROM {base} b
        JOIN {name}_runs USING (tree) WHERE run = b.pos // CAST(pow(16, level + 1) AS BIGINT)) b),
{name}_proof AS (
  SELECT tree, pos, list({{'l': l, 'r': r}} ORDER BY level) AS sides FROM {name}_sides GROUP BY ALL)"""


_MERKLE = f"""
WITH RECURSIVE {{crc}},
leaves AS (
  SELECT doc_id, source, {_hash_sql("text")} AS leaf,
    CASE WHEN {{crc_of}} % 5 = 0
    THEN {_hash_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS other
  FROM documents, crc),
placed AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, COUNT(*) OVER (PARTITION BY source) AS n,
    DENSE_RANK() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM leaves),
base AS (SELECT tree, pos, leaf AS h, n FROM placed),
{_grown_sql("low", "base")},
subroots AS (SELECT tree, h AS subroot FROM low WHERE n = 1),
tops AS (SELECT 0 AS tree, tree AS pos, subroot AS h, COUNT(*) OVER () AS n FROM subroots),
{_grown_sql("high", "tops")},
whole AS (
  SELECT doc_id, leaf, subroot, (SELECT h FROM high WHERE n = 1) AS root,
    COALESCE(low_proof.sides, []) || COALESCE(high_proof.sides, []) AS sides, COALESCE(other, leaf) AS own
  FROM placed JOIN subroots USING (tree) LEFT JOIN low_proof ON low_proof.tree = placed.tree AND low_proof.pos = placed.pos
  LEFT JOIN high_proof ON high_proof.pos = placed.tree),
folded AS (
  SELECT *, list_reduce([{{{{'l': own, 'r': ''}}}}] || sides, lambda x, y: {{{{'l': sha256(y.l || x.l || y.r), 'r': ''}}}}).l AS folded_root FROM whole)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(sides, lambda s: s.l || s.r), '')) AS proof_sha256, folded_root,
  folded_root = root AS verified
FROM folded"""


def _with_crc(sql: str, values: str) -> str:
    return sql.replace("{crc}", _CRC.strip()).replace("{crc_of}", _CRC_OF.format(bytes=values)).replace("{{", "{").replace("}}", "}")


def oracle_sql() -> dict[str, str]:
    return {
        "op1_substring_dedup": _WORDS_GONE,
        "op2_url_filter": _URLS,
        "op3_embedding_dedup": _VECTORS,
        "op6_mixing": _mix_sql(),
        "op11_spelling": _with_crc(_SPELLING, "b"),
        "op13_merkle": _with_crc(_MERKLE, "list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))"),
    }
