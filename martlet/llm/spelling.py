"""Groups of spelling variants: words one edit apart, each led to its most frequent form.

Method: finite-state composition. The vocabulary is an acyclic acceptor A, one edit
is a transducer T, and the paths of A o T o A are the pairs of near words. The part
of the composition before the edit runs through one and the same state on both
sides, so the pairs are dealt by the state that a prefix leads to: each task
minimises the acceptor of the words below one such initial state and enumerates
what the composition accepts there. Words have ``SHORTEST`` code points at least, so
two near ones share their first ``HEAD`` or their last ``TAIL`` code points; the
second case is the same composition over reversed words.

A state that more than ``STATE_WORDS`` words pass is not given to one task. Its arcs
are followed instead: words go on to longer prefixes, whose states are smaller, and
a pair that is edited at the state itself has equal rests after the edit, which is a
join on (prefix, rest). Such a key has at most one word for each code point. So no
task holds more than ``STATE_WORDS`` words and no pair is lost.

An inserted code point within a run of equal ones could stand in several places; the
last one counts, so that each pair is found once.

Defined cases: a null text has no words; a null id counts as empty text in the
checksum; a word without near words has n_near 0 and null form; an empty table has
no row; further columns are not read.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martlet.llm.common import blank, partitions, pick, saved

#: Code points of a word, at least.
SHORTEST = 7
#: Occurrences of a word, at least.
OFTEN = 2
#: A form occurs at least so many times as often as the word.
TIMES = 10
#: One code point goes where this divides the checksum of id and run.
SLIP = 31
HEAD, TAIL = 3, 4
#: Words below one state that a task takes at most.
STATE_WORDS = 20_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_RUN = "[a-zÀ-ÿ]{%d,}" % SHORTEST


def words_of(docs: DataFrame) -> DataFrame:
    """word and n over all texts, slips applied."""
    rows = pick(docs, doc_id=("doc_id", "bigint"), text=("text", "string"))
    runs = F.regexp_extract_all(F.translate("text", _UPPER, _LOWER), F.lit(_RUN), F.lit(0))
    rows = rows.select(blank(F.col("doc_id").cast("string")).alias("id"), F.explode(runs).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    rows = rows.select("run", h.alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    slipped = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(F.col("h") % SLIP == 0, slipped).otherwise(F.col("run"))
    counts = rows.select(word.alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return counts.where((F.length("word") >= SHORTEST) & (F.col("n") >= OFTEN))


class Acceptor:
    """The minimised acyclic acceptor of sorted distinct strings, built one string after another.

    States are numbered so that a state comes after those its arcs lead to.
    ``words[s]`` is how many strings state s accepts and ``least[s]`` the length of
    the shortest. A string's number is its place among all, by which its path is known.
    """

    def __init__(self, strings: list[str]):
        self.final: list[bool] = []
        self.arcs: list[list[tuple[str, int, int]]] = []
        self.words: list[int] = []
        self.least: list[int] = []
        known: dict[tuple, int] = {}
        # The last string's path: whether a state is final and its finished arcs.
        path: list[tuple[bool, list[tuple[str, int]]]] = [(False, [])]
        last = ""

        def finish(down_to: int) -> None:
            while len(path) - 1 > down_to:
                final, arcs = path.pop()
                key = (final, *arcs)
                state = known.get(key)
                if state is None:
                    state = known[key] = self._state(final, arcs)
                path[-1][1].append((last[len(path) - 1], state))

        for text in strings:
            same = 0
            for a, b in zip(text, last, strict=False):
                if a != b:
                    break
                same += 1
            finish(same)
            path += [(False, []) for _ in range(len(text) - same)]
            path[-1] = (True, path[-1][1])
            last = text
        finish(0)
        self.start = self._state(*path[0])

    def _state(self, final: bool, arcs: list[tuple[str, int]]) -> int:
        made, n = [], int(final)
        for symbol, state in arcs:
            made.append((symbol, state, n))
            n += self.words[state]
        self.final.append(final)
        self.arcs.append(made)
        self.words.append(n)
        self.least.append(0 if final else 1 + min((self.least[s] for _, s in arcs), default=0))
        return len(self.final) - 1


def near_pairs(strings: list[str], rest: int | None = None) -> list[tuple[int, int]]:
    """Places of all pairs of the sorted ``strings`` that are one edit apart, each once.

    ``rest``: only pairs whose equal part after the edit has at most so many symbols need be found.
    """
    a = Acceptor(strings)
    met: dict[tuple[int, int], list[tuple[int, int]]] = {}

    def meet(p: int, q: int) -> list[tuple[int, int]]:
        """After the edit: numbers of the strings that both states accept."""
        if p == q:
            return [(i, i) for i in range(a.words[p])]
        found = met.get((p, q))
        if found is None:
            found = met[p, q] = common(p, q, None)
        return found

    def common(p: int, q: int, but: str | None) -> list[tuple[int, int]]:
        found = [(0, 0)] if a.final[p] and a.final[q] else []
        theirs = {symbol: (state, at) for symbol, state, at in a.arcs[q]}
        for symbol, state, at in a.arcs[p]:
            if symbol != but and symbol in theirs:
                other, place = theirs[symbol]
                found += [(at + i, place + j) for i, j in meet(state, other)]
        return found

    before: list[list[tuple[int, int]]] = []
    for p, arcs in enumerate(a.arcs):
        found = [(at + i, at + j) for _, state, at in arcs for i, j in before[state]]
        if rest is None or a.least[p] <= rest + 1:
            for k, (symbol, state, at) in enumerate(arcs):
                for _, other, place in arcs[:k]:
                    found += [(place + i, at + j) for i, j in meet(other, state)]
                found += [(i, at + j) for i, j in common(p, state, symbol)]
        before.append(found)
    return before[a.start]


def _enumerate(reverse: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sys.setrecursionlimit(10_000_000)
        key, held = None, []
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("state", "path", "n"))
            for state, path, n in zip(*columns, strict=True):
                if state != key:
                    yield from _near_words(key, held, reverse)
                    key, held = state, []
                held.append((path, n))
        yield from _near_words(key, held, reverse)

    return run


def _near_words(state: str | None, held: list[tuple[str, int]], reverse: bool) -> Iterator[pa.RecordBatch]:
    """word, n_near, and the best near word, of the words below one state."""
    if len(held) < 2:
        return
    words = [path[::-1] if reverse else path for path, _ in held]
    rests = [path[len(state) :] for path, _ in held]
    n_near: dict[int, int] = {}
    best: dict[int, tuple[int, str]] = {}
    for i, j in near_pairs(rests, HEAD - 1 if reverse else None):
        if reverse and words[i][:HEAD] == words[j][:HEAD]:
            continue
        for x, y in ((i, j), (j, i)):
            n_near[x] = n_near.get(x, 0) + 1
            mine = (-held[y][1], words[y])
            if x not in best or mine < best[x]:
                best[x] = mine
    yield pa.record_batch(
        {
            "word": pa.array([words[x] for x in n_near], pa.string()),
            "n_near": pa.array(list(n_near.values()), pa.int64()),
            "less": pa.array([best[x][0] for x in n_near], pa.int64()),
            "near": pa.array([best[x][1] for x in n_near], pa.string()),
        }
    )


_NEAR = "word string, n_near long, less long, near string"


def _merged(rows: DataFrame) -> DataFrame:
    best = F.min(F.struct("less", "near"))
    rows = rows.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
    return rows.select("word", "n_near", "best.less", "best.near")


def _one_way(words: DataFrame, reverse: bool, state_words: int) -> DataFrame:
    """Near words that share their beginning, or with ``reverse`` their end, as in ``_NEAR``."""
    first = TAIL if reverse else HEAD
    paths = words.select((F.reverse("word") if reverse else F.col("word")).alias("path"), "n")

    def prefix(n: Column | int) -> Column:
        return F.substring("path", F.lit(1), F.lit(n) if isinstance(n, int) else n)

    # States that too many words pass: first those of the shortest prefix, then what lies beyond these.
    wide = paths.groupBy(prefix(first).alias("_state")).agg(F.count("*").alias("_n")).where(F.col("_n") > state_words)
    deep = paths.join(wide, prefix(first) == F.col("_state"), "left_semi")
    steps = saved(
        deep.withColumn("at", F.explode(F.sequence(F.lit(first), F.length("path")))).withColumn("state", prefix(F.col("at"))),
        "steps",
    )
    wide = steps.groupBy(F.col("state").alias("_state")).agg(F.count("*").alias("_n")).where(F.col("_n") > state_words)
    wide = saved(wide.select("_state"), "wide")
    passed = saved(steps.join(wide, F.col("state") == F.col("_state")).select("path", "n", "at", "state"), "passed")

    # Below narrow states: one acceptor for each.
    upto = passed.groupBy(F.col("path").alias("_path")).agg(F.max("at").alias("_at"))
    cut = F.coalesce(F.col("_at") + 1, F.lit(first))
    narrow = paths.join(upto, F.col("path") == F.col("_path"), "left").where(cut <= F.length("path"))
    narrow = narrow.select(prefix(cut).alias("state"), "path", "n")
    dealt = narrow.repartition(partitions(words.sparkSession), "state").sortWithinPartitions("state", "path")
    below = dealt.mapInArrow(_enumerate(reverse), _NEAR)

    # At wide states: the edit is made there, and what follows is equal.
    size = F.length("path")
    own = F.substring("path", F.col("at") + 1, F.lit(1))
    key = lambda skip: F.concat("state", F.lit("\0"), F.substring("path", F.col("at") + 1 + skip, size))
    edits = passed.select("path", "n", own.alias("symbol"), key(0).alias("key"), F.lit(True).alias("short"))
    edits = edits.union(
        passed.where(F.col("at") < size).select("path", "n", own.alias("symbol"), key(1).alias("key"), F.lit(False).alias("short"))
    )
    edits = saved(edits, "edits")
    other = edits.select(*(F.col(c).alias(f"_{c}") for c in edits.columns))
    pairs = edits.join(other, F.col("key") == F.col("_key")).where("symbol <> _symbol and not (short and _short)")
    if reverse:
        pairs = pairs.select(F.reverse("path").alias("path"), F.reverse("_path").alias("_path"), "_n")
        pairs = pairs.where(F.substring("path", 1, HEAD) != F.substring("_path", 1, HEAD))
    at_wide = pairs.select(F.col("path").alias("word"), F.lit(1).cast("long").alias("n_near"), (-F.col("_n")).alias("less"), F.col("_path").alias("near"))
    return below.union(_merged(at_wide))


def _rooted(forms: DataFrame) -> DataFrame:
    """word and root: forms are followed to the last, twice as far in each round.

    A form occurs ``TIMES`` as often as its word, so no chain has over nineteen words.
    """
    rooted = saved(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = rooted.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
        joined = rooted.join(further, F.col("root") == F.col("_word"), "left")
        made = joined.select("word", F.coalesce("_root", "root").alias("root"), F.col("_root").isNotNull().alias("moved"))
        made = saved(made, "roots")
        rooted = made.select("word", "root")
        if made.where("moved").isEmpty():
            return rooted


def group_spellings(docs: DataFrame, *, state_words: int = STATE_WORDS) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of the vocabulary."""
    words = saved(words_of(docs), "vocabulary")
    near = _merged(_one_way(words, False, state_words).union(_one_way(words, True, state_words)))
    near = near.withColumnRenamed("word", "_word")
    rows = words.join(near, F.col("word") == F.col("_word"), "left")
    led = -F.col("less") >= TIMES * F.col("n")
    rows = saved(
        rows.select(
            "word",
            F.when(led, F.col("near")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(led, -F.col("less")).alias("form_n"),
        ),
        "near",
    )
    rooted = _rooted(rows.where("form is not null")).withColumnRenamed("word", "_word")
    rows = rows.join(rooted, F.col("word") == F.col("_word"), "left")
    return rows.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
