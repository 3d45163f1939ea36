"""Ranked search, spelling variants and fingerprints against brute force, and hard inputs."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import SF_DIR
from pyspark.sql import functions as F

from tidemark.llm.impact_ranking import nra, ranked
from tidemark.llm.multiset_hash import changed, document_fingerprints, fingerprints, packed
from tidemark.llm.spelling import Acceptor, Composition, near_words, spelling_groups

LONG = "lorem ipsum dolor " * 9000
HARD = [
    (1, "alpha beta gamma\nThis is a line, of some length.", "x"),
    (2, None, None),
    (3, "", "x"),
    (4, LONG, "y"),
    (5, "alpha beta gamma\nThis is a line, of some length.", "x"),
    (6, " \t\n ", ""),
    (7, "Übermäßig ÜBERMÄSSIG naïveté naïvete", "y"),
    (None, "no id here alpha", None),
    (7, "Übermäßig ÜBERMÄSSIG naïveté naïvete", "y"),
    (7, "another text of document seven alpha", "y"),
    (8, "é Ö ß don't 42 \x1c K İ 中文 alpha", "z"),
    (9, "x" * 5000 + " " + "x" * 4999, "z"),
]


@pytest.fixture(scope="module")
def hard(spark):
    base = spark.createDataFrame(HARD, "doc_id long, text string, source string")
    return base.withColumns({c: F.lit("clash") for c in ("score", "rank", "item_id", "word", "n", "key", "tie", "bucket", "guest", "fingerprint", "terms", "depth", "begin", "over")})


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


# --- ranked search --------------------------------------------------------------------------------------------


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def search(rows, items, k=10):
    words = [(i, Counter(terms(t))) for i, t in rows]
    lengths = [c.total() for _, c in words]
    n, whole = sum(x > 0 for x in lengths), sum(lengths)
    df = Counter(t for _, c in words for t in c)
    asked: dict = {}
    for item, text in items:
        asked.setdefault(item, set()).update(terms(text))
    out = {}
    for item, own in asked.items():
        scored = []
        for (i, c), length in zip(words, lengths, strict=True):
            m = 100 - 90 + 90 * length * n // max(whole, 1)
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in own if c[t])
            if score > 0:
                scored.append((-score, math.inf if i is None else i))
        out[item] = [(-s, None if i == math.inf else i) for s, i in sorted(scored)[:k]]
    return {i: v for i, v in out.items() if v}


def answered(frame):
    got: dict = {}
    for r in frame.orderBy("item_id", "rank").collect():
        got.setdefault(r.item_id, []).append((r.score, r.doc_id))
        assert r["rank"] == len(got[r.item_id])
    return got


@pytest.mark.parametrize("group_terms", [1_000_000, 100])
def test_ranked_against_all_documents(spark, docs, group_terms):
    items = spark.read.parquet(f"{SF_DIR}/benchmark.parquet")
    want = search([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert len(want) > 30
    assert answered(ranked(docs, items, group_terms=group_terms)) == want


def test_ranked_hard(spark, hard):
    items = [(1, "alpha line"), (1, "Beta ALPHA"), (2, None), (3, ""), (4, "nowhere"), (None, "übermäßig Übermäßig dolor"), (5, "x" * 5000), (6, "中文")]
    frame = spark.createDataFrame(items, "item_id long, text string").withColumn("score", F.lit("clash"))
    assert answered(ranked(hard, frame)) == search([(i, t) for i, t, _ in HARD], items)
    assert ranked(hard.limit(0), frame).count() == 0 and ranked(hard, frame.limit(0)).count() == 0


def test_nra_reads_part_of_the_lists_and_settles_ties():
    rng = np.random.default_rng(5)
    n, lists = 3000, 8
    table = (rng.pareto(1.5, (lists, n)) * 40).astype(np.int64) * (rng.random((lists, n)) < 0.5)
    table[:, 7], table[:, 11] = table[:, 3], table[:, 3]  # ties of three documents
    docs, impacts, cuts = [], [], [0]
    for row in table:
        some = np.flatnonzero(row)
        some = some[np.argsort(-row[some], kind="stable")]
        docs.append(some), impacts.append(row[some])
        cuts.append(cuts[-1] + len(some))
    ids = rng.permutation(n)
    for k in (1, 2, 10, 2990, 4000):
        best, score = nra(np.concatenate(docs), np.concatenate(impacts), np.array(cuts[:-1]), np.array(cuts[1:]), n, ids, k, first=4)
        want = sorted(((-int(s), int(i)) for s, i in zip(table.sum(axis=0), ids, strict=True) if s > 0))[:k]
        assert list(zip((-score).tolist(), ids[best].tolist(), strict=True)) == want


# --- spelling -------------------------------------------------------------------------------------------------


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants(rows, typo=31, least_chars=7, least_times=2, ratio=10):
    counts: Counter = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % typo == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= least_chars and c >= least_times}
    by_size: dict = {}
    for w in n:
        by_size.setdefault(len(w), []).append(w)
    out = {}
    for w in n:
        close = [x for size in (len(w) - 1, len(w), len(w) + 1) for x in by_size.get(size, []) if x != w and near(w, x)]
        best = min(close, key=lambda x: (-n[x], x), default=None)
        form = best if best is not None and n[best] >= ratio * n[w] else None
        out[w] = (form, n[w], len(close), None if form is None else n[form])
    roots = {}
    for w in n:
        root = w
        while out[root][0] is not None:
            root = out[root][0]
        roots[w] = root
    return sorted((w, f or "", roots[w], c, m, fn or 0) for w, (f, c, m, fn) in out.items())


def grouped(frame):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in frame.collect())


def test_composition_is_minimal_and_accepts_each_pair_once():
    random.seed(3)
    words = sorted({"".join(random.choice("ab") for _ in range(random.randint(1, 7))) for _ in range(90)})
    machine = Acceptor(words)
    rests = {frozenset(w[i:] for w in words if w[:i] == p) for p in {w[:i] for w in words for i in range(len(w) + 1)} for i in [len(p)]}
    assert len(machine.arcs) == len(rests)  # a state for each distinct set of rests
    got = [tuple(sorted(p)) for p in Composition(machine).pairs()]
    assert len(got) == len(set(got)) and set(got) == {(a, b) for i, a in enumerate(words) for b in words[i + 1 :] if near(a, b)}


@pytest.mark.parametrize("most", [1, 5, 1000])
def test_near_words_at_every_frontier(spark, most):
    random.seed(most)
    words = sorted({"".join(random.choice("ab") for _ in range(random.randint(1, 7))) for _ in range(120)} | {"a" * 40, "a" * 41, "a" * 39 + "b"})
    n = {w: random.randint(1, 5) for w in words}
    got = {r.word: (r.near, r.best_n, r.best) for r in near_words(spark.createDataFrame(list(n.items()), "word string, n long"), most).collect()}
    want = {}
    for w in words:
        close = [x for x in words if near(w, x)]
        if close:
            best = min(close, key=lambda x: (-n[x], x))
            want[w] = (len(close), n[best], best)
    assert got == want


@pytest.mark.parametrize("most", [4096, 20])
def test_spelling_against_brute_force(spark, docs, most):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = variants(rows, typo=3, ratio=2)
    assert sum(w[1] != "" for w in want) > 50 and any(w[1] not in ("", w[2]) for w in want)
    assert grouped(spelling_groups(docs, typo=3, ratio=2, most=most)) == want


def test_spelling_hard(spark, hard):
    rows = [(i, t) for i, t, _ in HARD] * 2
    twice = hard.unionByName(hard)
    assert grouped(spelling_groups(twice)) == variants(rows)
    assert spelling_groups(hard.limit(0)).count() == 0


# --- fingerprints ---------------------------------------------------------------------------------------------


def edited_hashes(rows):
    """By descending doc_id, null last; rows of one doc_id here have one text or stand in any order."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = []
    for k, (i, t) in enumerate(order):
        more = order[(k + 1) % len(order)][1]
        text = t[: len(t) - len(t) // 2] + more[: len(t) // 2]
        out.append((i, len(t), hashlib.sha256(text.encode()).hexdigest(), text))
    return out


@pytest.mark.parametrize("bucket_bytes", [8 << 20, 20_000])
def test_fingerprints_of_texts_and_edited_texts(docs, bucket_bytes):
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    got = {r.doc_id: r for r in document_fingerprints(docs, bucket_bytes).collect()}
    assert len(got) == len(rows)
    text = dict(rows)
    for i, n, digest, new in edited_hashes(rows):
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (n, digest)
        assert r.fingerprint == packed(*fingerprints([text[i]]))[0] and r.edited_fingerprint == packed(*fingerprints([new]))[0]
    ids = sorted(text, reverse=True)
    for a, b in zip(ids, ids[1:] + ids[:1], strict=True):
        assert (got[a].fingerprint == got[b].fingerprint) == (sorted(text[a].split("\n")) == sorted(text[b].split("\n")))
    some = [r for r in got.values() if r.n_chars > 300]
    assert np.mean([r.near_edited for r in some]) > 0.4 > 0.1 > np.mean([r.near_next for r in some])
    assert np.mean([r.near_edited > r.near_next for r in some]) > 0.95


def test_fingerprints_are_homomorphic():
    one = lambda t: packed(*fingerprints([t]))[0]
    parts = ["first paragraph here", "", "second one of seven words and more", "first paragraph here", "x"]
    assert one("\n".join(parts)) == one("\n".join(parts[::-1])) != one("\n".join(parts[1:]))
    assert changed(one("\n".join(parts[:2])), inserted=parts[2:]) == one("\n".join(parts))
    assert changed(one("\n".join(parts)), deleted=parts[3:], inserted=["y"]) == one("\n".join([*parts[:3], "y"]))
    assert one("a\n") != one("a") and one("A") != one("a") and one("a b") != one("a  b")


def test_fingerprints_estimate_common_shingles():
    from tidemark.llm.multiset_hash import likeness

    words = [f"w{i}" for i in range(3000)]
    texts = [" ".join(words), " ".join(words[:1500] + [f"z{i}" for i in range(1500)]), " ".join(f"y{i}" for i in range(3000))]
    strong, like = fingerprints(texts)
    pick = lambda i: (strong[i : i + 1], like[i : i + 1])
    assert likeness(pick(0), pick(0))[0] == 1 and likeness(pick(0), pick(1))[0] == pytest.approx(0.5, abs=0.2) and likeness(pick(0), pick(2))[0] < 0.2


def test_fingerprints_hard(spark, hard):
    got = document_fingerprints(hard).collect()
    assert sorted((r.doc_id or 0, r.n_chars) for r in got) == sorted((i or 0, len(t or "")) for i, t, _ in HARD)
    by = {(r.doc_id, r.n_chars): r for r in got}
    assert by[1, len(HARD[0][1])].fingerprint == by[5, len(HARD[0][1])].fingerprint
    assert by[2, 0].fingerprint == by[3, 0].fingerprint and by[3, 0].near_next == 1.0 and by[3, 0].near_edited == 1.0
    # the row without doc_id is last, so the first, document 9, follows it
    text = "no id here alpha"
    assert by[None, 16].edited_sha256 == hashlib.sha256((text[:8] + "x" * 8).encode()).hexdigest()
    assert document_fingerprints(hard.limit(0)).count() == 0
    alone = document_fingerprints(hard.where("doc_id = 1")).first()
    assert alone.near_next == 1.0
