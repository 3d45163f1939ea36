"""Spelling variants by finite-state composition: vocabulary acceptor o one-edit transducer o vocabulary acceptor.

The acceptor A is the minimal deterministic automaton of the words, the transducer T copies all symbols but one, which it
inserts, deletes or replaces. A path of A o T o A reads a word on either side; its states are (a, edited?, b). Until the edit both
sides have read the same, so they are in one state of A; after it both must read the same rest, so what is left is the
intersection of two states' languages.

The machine is not built as a whole. Its unedited states are cut at a frontier of word beginnings: a beginning (of a
length in STEPS) that at most `most` words share is a partition's initial state. A task builds the minimal acceptor of its
partition and enumerates the accepted pairs from there. Pairs that are edited before the frontier leave it in edited states,
where only equal rests are accepted: each word sends its rest, for every place before its frontier, once as read
past the symbol there and once as read up to it, and equal rests meet in a shuffle. Such a group holds words that differ in
one symbol, so it is no larger than the alphabet.

A symbol of a run of equal ones can be deleted at several places with one result; the first place counts. So every pair is accepted
once, and a word's near words are counted without a list of pairs.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut_lineage, ship, small

ship(__name__)

RUN = re.compile("[a-zÀ-ÿ]+")  # after A-Z are lower-cased
TYPO = 31  # a run loses a symbol where the hash is a multiple
LEAST_CHARS, LEAST_TIMES, RATIO = 7, 2, 10
MOST = 4096  # words of a partition
STEPS = (0, 1, 2, 3, 4, 5, 6, 8, 10, 12, 16, 20, 24, 32, 48, 64, 128, 256, 512, 1024)  # places a frontier may lie at; beyond, powers of two
HELD = 300_000  # distinct words a counting task holds before it passes them on


# --- words ----------------------------------------------------------------------------------------------------


def typed(doc_id: int | None, run: str, typo: int = TYPO) -> str:
    """The run, without one symbol where its hash says so."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    at = h % len(run)
    return run if h % typo else run[:at] + run[at + 1 :]


def _count(typo: int, least_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def emit() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for i in range(batch.num_rows):
                text = batch.column("text")[i].as_py()
                if not text:
                    continue
                doc = batch.column("doc_id")[i].as_py()
                text = text.encode().lower().decode()  # bytes: A-Z alone
                for word, n in Counter(RUN.findall(text)).items():
                    if len(word) >= least_chars:
                        word = typed(doc, word, typo)
                        if len(word) >= least_chars:
                            held[word] += n
                if len(held) >= HELD:
                    yield emit()
        if held:
            yield emit()

    return run


def vocabulary(docs: DataFrame, typo: int = TYPO, least_chars: int = LEAST_CHARS, least_times: int = LEAST_TIMES) -> DataFrame:
    """word, n: runs of ASCII letters and U+00C0 to U+00FF, A-Z lower-cased, with the typos of typed()."""
    runs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_count(typo, least_chars), "word string, n long")
    return runs.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_times)


# --- the machine ----------------------------------------------------------------------------------------------


class Acceptor:
    """Minimal acyclic automaton of sorted distinct words: states are numbers, arcs[state] maps symbols, final tells where words end."""

    def __init__(self, words: list[str]):
        self.arcs: list[dict[str, int]] = []
        self.final: list[bool] = []
        known: dict[tuple, int] = {}
        # The path of the latest word is open; states off it are closed, that is replaced by an equal one if there is any.
        path: list[tuple[dict[str, int], bool]] = [({}, False)]
        last = ""

        def close(down_to: int) -> None:
            while len(path) > down_to + 1:
                arcs, final = path.pop()
                path[-1][0][last[len(path) - 1]] = self._state(arcs, final, known)

        for word in words:
            same = 0
            while same < min(len(word), len(last)) and word[same] == last[same]:
                same += 1
            close(same)
            path.extend(({}, False) for _ in range(len(word) - same))
            path[-1] = (path[-1][0], True)
            last = word
        close(0)
        self.start = self._state(*path[0], known)

    def _state(self, arcs: dict[str, int], final: bool, known: dict[tuple, int]) -> int:
        key = (final, *arcs.items())
        if key not in known:
            known[key] = len(self.arcs)
            self.arcs.append(arcs)
            self.final.append(final)
        return known[key]


class Composition:
    """A o T o A from A's start, or from edited states."""

    def __init__(self, acceptor: Acceptor):
        self.a = acceptor
        self.dead: set[tuple[int, int]] = set()  # pairs of states without a common word
        self.edits: dict[int, list[tuple[str, str, int, int]]] = {}

    def rests(self, s: int, t: int) -> Iterator[str]:
        """Words accepted from either state."""
        path: list[str] = []
        seen, some = [], False
        stack = [(s, t, 0, "")]
        while stack:
            s, t, depth, symbol = stack.pop()
            if (s, t) in self.dead:
                continue
            path[max(depth - 1, 0) :] = [symbol]
            seen.append((s, t))
            if self.a.final[s] and self.a.final[t]:
                some = True
                yield "".join(path)
            x, y = self.a.arcs[s], self.a.arcs[t]
            if len(x) <= len(y):
                stack.extend((to, y[c], depth + 1, c) for c, to in x.items() if c in y)
            else:
                stack.extend((x[c], to, depth + 1, c) for c, to in y.items() if c in x)
        if not some:
            self.dead.update(seen)

    def edited_here(self, state: int) -> list[tuple[str, str, int, int]]:
        """(read on one side, read on the other, the states after): all ways to edit at the state's next symbol. Empty: nothing is read there."""
        if state not in self.edits:
            arcs = list(self.a.arcs[state].items())
            ways = [(c, d, s, t) for i, (c, s) in enumerate(arcs) for d, t in arcs[i + 1 :]] + [(c, "", s, state) for c, s in arcs]
            self.edits[state] = [w for w in ways if next(self.rests(w[2], w[3]), None) is not None]
        return self.edits[state]

    def pairs(self, before: str = "") -> Iterator[tuple[str, str]]:
        """Accepted pairs, each once, in one of its directions. before: the symbol read last before the start."""
        path: list[str] = []
        stack = [(self.a.start, 0, before)]
        while stack:
            state, depth, symbol = stack.pop()
            path[max(depth - 1, 0) :] = [symbol] if depth else []
            stack.extend((to, depth + 1, c) for c, to in self.a.arcs[state].items())
            ways = [w for w in self.edited_here(state) if w[1] or w[0] != symbol]  # of a run of equal symbols the first is deleted
            if ways:
                read = "".join(path)
                for c, d, s, t in ways:
                    for rest in self.rests(s, t):
                        yield read + c + rest, read + d + rest


PART_DDL = "word string, near long, best_n long, best string"


def _tally(words: dict[str, int], pairs: Iterator[tuple[str, str]]) -> pa.Table:
    """For each word of some pair: how many, and the near word of largest n, ties to the smaller."""
    near: dict[str, list] = {}
    for pair in pairs:
        for x, y in (pair, pair[::-1]):
            n = words[y]
            held = near.setdefault(x, [0, -1, ""])
            held[0] += 1
            if n > held[1] or n == held[1] and y < held[2]:
                held[1:] = n, y
    types = (pa.string(), pa.int64(), pa.int64(), pa.string())
    columns = zip(*((w, *held) for w, held in near.items()), strict=True) if near else [()] * 4
    return pa.table([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=["word", "near", "best_n", "best"])


def _compose(table: pa.Table) -> pa.Table:
    """One partition: words with one beginning."""
    words = dict(zip(table.column("word").to_pylist(), table.column("n").to_pylist(), strict=True))
    depth = table.column("depth")[0].as_py()
    start = next(iter(words))[:depth]
    found = Composition(Acceptor(sorted(w[depth:] for w in words))).pairs(start[-1:]) if len(words) > 1 else iter(())
    return _tally(words, ((start + x, start + y) for x, y in found))


def _rests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words to the edited states before their frontier: place, what was read before it and comes after it, the symbol there and
    whether it was read (1, or 2 if it is not the one to be deleted; 0: not read, no symbol)."""
    names = ["place", "state", "symbol", "how", "n"]
    for batch in batches:
        for at in range(0, batch.num_rows, 5000):
            part = batch.slice(at, 5000)
            rows = []
            for word, n, depth in zip(*(part.column(c).to_pylist() for c in ("word", "n", "depth")), strict=True):
                rows += [(i, word, "", 0, n) for i in range(min(depth, len(word) + 1))]
                rows += [(i, word[:i] + word[i + 1 :], word[i], 2 if i and word[i] == word[i - 1] else 1, n) for i in range(min(depth, len(word)))]
            types = (pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int64())
            columns = zip(*rows, strict=True) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=names)


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal rests to what each word has near."""
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            words: dict[str, int] = {}
            pairs = []
            part = batch.slice(at, 2000)
            for i, state, members in zip(*(part.column(c).to_pylist() for c in ("place", "state", "members")), strict=True):
                told = [(state[:i] + m["symbol"] + state[i:], m["how"], m["n"]) for m in members]
                words.update((w, n) for w, _, n in told)
                read = [(w, how) for w, how, _ in told if how]
                pairs += [(x, y) for k, (x, _) in enumerate(read) for y, _ in read[k + 1 :]]
                pairs += [(x, y) for y, how, _ in told if not how for x, of in read if of == 1]
            yield from _tally(words, iter(pairs)).to_batches()


def _steps() -> Iterator[int]:
    yield from STEPS
    at = STEPS[-1]
    while True:
        at *= 2
        yield at


def frontier(words: DataFrame, most: int = MOST) -> DataFrame:
    """words with depth: the first of the STEPS at which at most `most` words have the word's beginning.

    A word that ends before that place has all its places before its frontier. Beginnings that more words share are fewer than words / `most`.
    """
    rest, done = words, None
    for at in _steps():
        begin = F.substring("word", 1, at)
        sizes = rest.where(F.char_length("word") >= at).groupBy(begin.alias("begin")).agg(F.count("*").alias("size"))
        heavy = cut_lineage(sizes.where(F.col("size") > most).select("begin", F.lit(True).alias("over")))
        told = cut_lineage(rest.withColumn("begin", begin).join(small(heavy), "begin", "left").drop("begin"))
        closed = told.where("over IS NULL").drop("over").withColumn("depth", F.lit(at))
        done = closed if done is None else done.unionByName(closed)
        rest = told.where("over").drop("over")
        if not heavy.limit(1).count():
            return done


# --- operator -------------------------------------------------------------------------------------------------


def near_words(words: DataFrame, most: int = MOST) -> DataFrame:
    """word, near (how many words differ by one inserted, deleted or replaced symbol), best_n and best (the one of largest n, ties to the
    smaller in code-point order); no row for a word without any.

    words: word (distinct, not null), n.
    """
    cut = cut_lineage(frontier(words, most))
    below = cut.groupBy(F.col("depth").alias("at"), F.substring(F.col("word"), F.lit(1), F.col("depth")).alias("begin")).applyInArrow(lambda t: _compose(t), PART_DDL)
    rests = cut.where("depth > 0").mapInArrow(_rests, "place int, state string, symbol string, how int, n long")
    groups = rests.groupBy("place", "state").agg(F.collect_list(F.struct("symbol", "how", "n")).alias("members")).where(F.size("members") > 1)  # the alphabet's size at most
    rows = below.unionByName(groups.mapInArrow(_meet, PART_DDL))
    top = F.min(F.struct((-F.col("best_n")).alias("less"), "best"))
    return rows.groupBy("word").agg(F.sum("near").alias("near"), top.alias("top")).select("word", "near", (-F.col("top.less")).alias("best_n"), F.col("top.best").alias("best"))


def spelling_groups(docs: DataFrame, typo: int = TYPO, least_chars: int = LEAST_CHARS, least_times: int = LEAST_TIMES, ratio: int = RATIO, most: int = MOST) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of at least `least_chars` symbols that occurs `least_times` or more.

    docs: doc_id, text; other columns are not read. form: the near word of largest n, ties to the smaller in code-point order, if its n is `ratio` times
    the word's or more, else null. root: the last that forms lead to; n rises along them, so they end. A null text has no words;
    a row without doc_id is hashed as if its doc_id were empty; repeated rows count as often as they stand there. An empty table gives no rows.
    """
    words = cut_lineage(vocabulary(docs, typo, least_chars, least_times))
    near = near_words(words, most)
    told = words.join(near, "word", "left")
    formed = F.col("best_n") >= ratio * F.col("n")
    told = cut_lineage(told.select("word", "n", F.coalesce("near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, F.col("best")).alias("form"), F.when(formed, F.col("best_n")).alias("form_n")))
    # Each turn doubles the forms that a step goes along.
    ways = told.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        further = ways.select(F.col("word").alias("root"), F.col("root").alias("far"))
        ways = cut_lineage(ways.join(further, "root", "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")))
        moved = ways.where("moved").limit(1).count()
        ways = ways.drop("moved")
        if not moved:
            break
    return told.join(ways, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
