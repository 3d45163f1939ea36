"""Operators against plain Python or SQL, and hard inputs: nulls, empty and long texts, ties, repeated rows, no rows, extra columns."""

import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from conftest import SF_DIR
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tidemark.llm.bagminhash import bags, keep_one, near_duplicates, signatures
from tidemark.llm.cover_tree import dual_search, exact_top_k
from tidemark.llm.interpolation import interpolated_scores
from tidemark.llm.licenses import BASE, license_scan, rules
from tidemark.llm.lines import line_dedup, repeated_lines
from tidemark.llm.mixing import mix_rows, mixed, split_quotas
from tidemark.llm.packing import packed, plan
from tidemark.llm.projected_knn import nearest_projected
from tidemark.llm.quality import quality_scores
from tidemark.llm.queries import SQL, QUERIES, WORD_BPE, mix_sql
from tidemark.llm.token_files import Shard, _fs, read_token_files, write_token_files
from tidemark.llm.tokens import END_ID, Encoder

PATH = public_tokenizers.path(WORD_BPE)
LONG = "lorem ipsum dolor " * 9000
HARD = [
    (1, "a b c d e f g\nThis is a line of some length.", "en", "x", 5),
    (2, None, None, None, None),
    (3, "", "en", "x", 0),
    (4, LONG, "en", "y", 9),
    (5, "a b c d e f g\nThis is a line of some lengt.", "en", "x", 5),
    (6, " \t\n ", "en", "", 4),
    (7, "MIT License\nmit  license, CC-BY!", None, "y", 1),
    (None, "no id here", "en", None, 1),
    (7, "MIT License\nmit  license, CC-BY!", None, "y", 1),
    (8, "é Ö ß <|endoftext|> don't 42 \x1c K İ", "de", "z", 1),
]


@pytest.fixture(scope="module")
def hard(spark):
    # size, draws, bag and the like clash with names that operators use
    base = spark.createDataFrame(HARD, "doc_id long, text string, lang string, source string, n_chars long")
    return base.withColumns({"size": F.lit("s"), "label": F.lit(1), "bag": F.lit(2), "n_lines": F.lit("n"), "key": F.lit(0), "score": F.lit(1.5)})


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


def test_encoder_equals_whole_texts():
    encode, whole = Encoder(PATH), Tokenizer.from_file(PATH)
    texts = [t for _, t, *_ in HARD] + ["", " ,. a. b, c.d 'S I'm", "ﬁ é ́ 中文 ŉ. ª"]
    sizes, ids = encode.encode(pa.array(texts))
    at = 0
    for text, n in zip(texts, sizes, strict=True):
        assert ids[at : at + n].tolist() == [*whole.encode(text or "", add_special_tokens=False).ids, END_ID]
        at += n


def test_encoder_keeps_no_word_again_for_its_stop_or_comma():
    encode, whole = Encoder(PATH), Tokenizer.from_file(PATH)
    texts = ["Alpha, beta. x1. .. é, a.b. ß,, T\u0308 t\u0308. I\u0307! É.", "alpha alpha. alpha, beta, don't. , . ALPHA!?' beta's beta' A's_ b-_"]
    for t in texts:
        assert encode.encode(pa.array([t]))[1].tolist() == [*whole.encode(t, add_special_tokens=False).ids, END_ID]
    assert {"alpha", "beta", ".", ","} <= set(encode.known) and not {"Alpha", "Alpha,", "alpha.", "alpha,", "beta,", "beta."} & set(encode.known)


def test_token_files_round_trip(spark, hard):
    manifest = write_token_files(hard, PATH, length=16, rows=4, shards=3)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in read_token_files(manifest, 2).collect())
    whole, at, want = Tokenizer.from_file(PATH), 0, []
    for i, t in sorted(((i, t or "") for i, t, *_ in HARD), key=lambda x: (x[0] is not None, x[0] or 0)):
        ids = np.array([*whole.encode(t, add_special_tokens=False).ids, END_ID], dtype="<u4")
        want.append((at, i, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want
    for row in manifest.collect():
        store, root = _fs(row.path)
        with store.open_input_stream(root + ".arrows") as f:
            shard = Shard(f.read_buffer())
        assert sum(int(shard[i].real.sum()) for i in range(len(shard))) == row.tokens
        assert shard[len(shard) - 1].tokens.shape == (16,)
        assert len(shard) == math.ceil(row.tokens / 16)
    assert read_token_files(write_token_files(hard.limit(0), PATH)).count() == 0


def test_packing(spark, hard):
    rows = packed(hard, PATH, capacity=50).toPandas().sort_values(["sequence_id", "offset"])
    groups = rows.groupby("sequence_id").length
    assert (groups.cumsum() - rows.length == rows.offset).all() and groups.sum().max() <= 50
    assert len(rows[rows.doc_id == 7]) == 2 * rows[rows.doc_id == 7].piece.nunique()
    assert packed(hard.limit(0), PATH).count() == 0


def test_plan_is_best_fit_decreasing():
    random.seed(1)
    sizes = [random.randint(1, 40) for _ in range(400)]
    room: list[int] = []
    for s in sorted(sizes, reverse=True):
        fits = [i for i, r in enumerate(room) if r >= s]
        if fits:
            room[min(fits, key=lambda i: room[i])] -= s
        else:
            room.append(40 - s)
    runs = plan(dict(Counter(sizes)), 40)
    assert int((runs[:, 3] + runs[:, 2]).max()) == len(room)
    assert int(runs[:, 2].sum()) == 400


def test_interpolation(spark, hard, docs):
    part = F.crc32(F.col("doc_id").cast("string")) % 7
    rows = interpolated_scores(docs, part != 2, part == 3, block_tokens=20_000).toPandas()
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    tokens = {i: [*t.encode().lower().split(), None] for i, t in text.items()}
    train = Counter(w for i, t in tokens.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in t)
    n, v = sum(train.values()), len(train)
    for r in rows.itertuples():
        assert (r.n_tokens, r.train_tokens, r.n_known) == (len(tokens[r.doc_id]), n, sum(w in train for w in tokens[r.doc_id]))
        assert r.base_score == pytest.approx(sum(math.log10((train[w] + 1) / (n + v + 1)) for w in tokens[r.doc_id]))
    held = rows[rows.held_out]
    assert held.score.sum() > held.base_score.sum() + 0.1 * held.n_tokens.sum()
    got = interpolated_scores(hard, F.lit(True), F.col("doc_id") == 4, order=3, block_tokens=100)
    assert got.count() == len(HARD) and got.where("score IS NULL OR isnan(score)").count() == 0
    assert interpolated_scores(hard.limit(0), F.lit(True), F.lit(False)).count() == 0
    assert interpolated_scores(hard, F.lit(False), F.lit(False)).where("score != 0").count() == 0


def dictionary_model(tokens, role, rounds=20):
    """Scores by dictionaries: bigram and unigram likelihoods mixed by weights per context-frequency bucket."""

    def counts(*roles):
        one, two, docs = Counter(), Counter(), 0
        for i, words in tokens.items():
            if role[i] in roles:
                docs += 1
                one.update(words)
                two.update(zip([0, *words[:-1]], words, strict=True))
        return one, two, docs

    def chain(words, one, two, docs):
        n = sum(one.values())
        for before, w in zip([0, *words[:-1]], words, strict=True):
            yield ((one[w], n), (two[before, w], docs if before == 0 else one[before]))

    bucket = lambda h: int(math.log2(h)) + 1 if h else 0
    fit = counts("fit")
    v = len(fit[0])
    dev = Counter(c for i, words in tokens.items() if role[i] == "dev" for c in chain(words, *fit))
    weights = [[0.0] + [0.5] * 40, [0.0] + [0.5] * 40]
    for _ in range(rounds):
        mine, reach = [Counter(), Counter()], [Counter(), Counter()]
        for (low, high), times in dev.items():
            p, made, rest = 1 / (v + 1), [], []
            for k, (c, h) in enumerate((low, high)):
                share = weights[k][bucket(h)]
                made.append(share * c / max(h, 1))
                rest.append((1 - share) * p)
                p = made[k] + rest[k]
            left = 1.0
            for k, (_, h) in ((1, high), (0, low)):
                post = made[k] / (made[k] + rest[k])
                mine[k][bucket(h)] += left * post * times
                reach[k][bucket(h)] += left * times
                left *= 1 - post
        new = [[0.0], [0.0]]
        for k in range(2):
            for b in range(1, 41):
                some = reach[k][b] > 0
                new[k].append(min(max(mine[k][b] / reach[k][b], 1e-9), 1 - 1e-9) if some else new[k][b - 1] if b > 1 else 0.5)
        done = max(abs(x - y) for k in range(2) for x, y in zip(new[k], weights[k], strict=True)) < 1e-4
        weights = new
        if done:
            break
    whole = counts("fit", "dev")
    out = {}
    for i, words in tokens.items():
        total = 0.0
        for steps in chain(words, *whole):
            p = 1 / (len(whole[0]) + 1)
            for k, (c, h) in enumerate(steps):
                share = weights[k][bucket(h)]
                p = share * c / max(h, 1) + (1 - share) * p
            total += math.log10(p)
        out[i] = total
    return out


@pytest.mark.parametrize("block_tokens", [700_000, 3_000])
def test_interpolation_against_dictionaries(docs, block_tokens):
    part = F.crc32(F.col("doc_id").cast("string")) % 7
    got = {r.doc_id: r.score for r in interpolated_scores(docs, part != 2, part == 3, block_tokens=block_tokens).collect()}
    tokens = {r.doc_id: [*(r.text or "").encode().lower().split(), None] for r in docs.collect()}
    role = {i: {2: "rest", 3: "dev"}.get(zlib.crc32(str(i).encode()) % 7, "fit") for i in tokens}
    assert got == pytest.approx(dictionary_model(tokens, role), rel=1e-9)


def near(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


@pytest.mark.parametrize("least", [1, 6])
def test_lines_against_all_pairs(spark, least):
    random.seed(least)
    texts = ["\n".join("".join(random.choice("ab") for _ in range(random.choice([0, 1, 5, 6, 7]))) for _ in range(4)) for _ in range(40)]
    got = {(r.doc, r.line): r.near for r in repeated_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), least).collect()}
    lines = [(d, i, x) for d, t in enumerate(texts) for i, x in enumerate(t.split("\n"))]
    want = {}
    for k, (d, i, x) in enumerate(lines):
        if x:
            first = next(j for j, y in enumerate(lines) if y[2] == x)
            close = any(max(len(x), len(y)) >= least and near(x, y) for *_, y in lines[:first] if y)
            if close or first != k:
                want[d, i] = close
    assert got == want


def test_lines_hard(hard):
    out = {(r.doc_id, r.text): r for r in line_dedup(hard).collect()}
    assert len(line_dedup(hard).collect()) == len(HARD)
    assert out[2, None].n_lines == 0 and out[3, ""].n_kept == 1
    assert out[5, ""].n_near == 1 and out[5, ""].size == "s"
    assert line_dedup(hard.limit(0)).count() == 0


def test_quality(spark, hard):
    big = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{big}/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    rows = quality_scores(docs, labels, ~held).where(held).join(labels, "doc_id").toPandas()
    assert (rows.predicted == rows.quality).mean() > 0.95
    out = quality_scores(hard, labels.limit(0), F.lit(True)).collect()
    assert len(out) == len(HARD) and all(r.score == pytest.approx(0.7) and r.predicted == 1 for r in out)
    assert quality_scores(hard, labels, F.lit(True)).where("score IS NULL").count() == 0


def test_licenses(hard):
    assert len(rules()) > 200
    out = {(r.doc_id, r.text): r for r in license_scan(hard).collect()}
    row = out[7, HARD[6][1]]
    assert row.n_words == 6 and [(b.start, b.label) for b in row.base] == [(4, "cc-by"), (0, "mit"), (2, "mit")] or sorted((b.start, b.label) for b in row.base) == [(0, "mit"), (2, "mit"), (4, "cc-by")]
    assert out[2, None].n_words == 0 and out[2, None].detections == []
    spots = row.detections
    assert not any(a != b and a.start >= b.start and a.stop <= b.stop and b.tier < a.tier for a in spots for b in spots)
    assert license_scan(hard.limit(0)).count() == 0


def test_every_license_rule_fires_on_its_own_wording(spark):
    def wording(pattern, pick):
        return " ".join(re.sub(r"\(\?:([^)]*)\)(\?)?", lambda m: "" if m[2] and pick else m[1].split("|")[-pick], pattern).split())

    texts = sorted({wording(r.pattern, pick) for r in rules() for pick in (0, 1)})
    out = license_scan(spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    assert len(out) == len(texts) > 600
    assert [r.text for r in out if not any(d.start == 0 and d.stop == r.n_words for d in r.detections)] == []
    said = {"All rights reserved.": "all-rights-reserved", "Released under GPLv3": "gpl-3.0", "BSD 3-Clause": "bsd-3-clause", "GNU GFDL 1.3": "gfdl-1.3"}
    told = license_scan(spark.createDataFrame([(t,) for t in said], "text string")).collect()
    assert all(said[r.text] in {d.label for d in r.detections} for r in told)


def test_license_base_columns_match_sql(spark):
    """Words and phrases of whole texts by DuckDB."""
    path = "/root/testdata/sf0.01/documents.parquet"
    phrases = ", ".join(f"('{p}', '{label}')" for p, label in BASE)
    want = duckdb.sql(f"""
      WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM '{path}'),
      p AS (SELECT string_split(phrase, ' ') AS phrase, label FROM (VALUES {phrases}) t(phrase, label)),
      spots AS (SELECT doc_id, label, unnest(list_filter(range(len(words)), lambda i: words[i + 1 : i + len(phrase)] = phrase)) AS word FROM w, p)
      SELECT w.doc_id, any_value(len(words)) AS n_words, count(word) AS n_base, min(word) AS first_word, max(word) AS last_word, coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS base_labels
      FROM w LEFT JOIN spots ON spots.doc_id = w.doc_id GROUP BY w.doc_id""").to_arrow_table().to_pylist()
    got = QUERIES["op5_license_scan"](spark, "/root/testdata/sf0.01").select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect()
    assert sum(r["n_base"] for r in want) > 20
    assert sorted((tuple(r.asDict().values()) for r in got)) == sorted(tuple(r.values()) for r in want)


def test_a_text_of_many_detections_ends_in_time(spark):
    import time

    text = "MIT License, Apache License 2.0; all rights reserved. " * 33_000  # 1.8 MB
    start = time.perf_counter()
    row = license_scan(spark.createDataFrame([(text,), (text[:108],)], "text string")).orderBy(F.desc(F.length("text"))).collect()
    assert time.perf_counter() - start < 120
    few = row[1].detections
    assert len(few) == 6 and len(row[0].detections) == 33_000 * 3 and len(row[0].base) == 66_000
    assert [(d.start, d.stop, d.label) for d in row[0].detections[:6]] == [(d.start, d.stop, d.label) for d in few]
    assert [d.start for d in row[0].detections] == [9 * (i // 3) + (0, 2, 6)[i % 3] for i in range(99_000)]


def test_a_text_of_many_equal_lines_ends_in_time(spark):
    import time

    rows = [(1, "the same line of more than twenty characters\n" * 20_000 + "end"), (2, "\n".join(f"line {i} of its own, long enough to be looked at" for i in range(5_000)))]
    start = time.perf_counter()
    out = {r.doc_id: r for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert time.perf_counter() - start < 120
    assert out[1].text == "the same line of more than twenty characters\nend" and (out[1].n_lines, out[1].n_kept) == (20_001, 2)


def vectors(spark, n=300):
    rng = np.random.default_rng(2)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((n, 12)).astype("f4"))]
    rows += [(n, None), (n + 1, []), (n + 2, [0.0] * 12), (n + 3, [None] + [1.0] * 11), (n + 4, [float("nan")] * 12), (n + 5, rows[3][1]), (n + 6, [1.0, 2.0]), (None, [1.0] * 12), (n + 20, [float("inf")] * 12)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash")), rows


def best(rows, value, zero, k=20):
    use = {i: np.array([value(float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    use = {i: v for i, v in use.items() if zero or v.any()}
    return {q: sorted(((float(use[q] @ v), -i) for i, v in use.items() if i != q and len(v) == len(use[q])), reverse=True)[:k] for q in use if q % 20 == 0}


@pytest.mark.parametrize("scale", [3e5, 5e6])
def test_cover_tree_keeps_large_vectors(spark, scale):
    rng = np.random.default_rng(4)
    rows = [(i, v.tolist()) for i, v in enumerate((rng.standard_normal((300, 8)) * np.where(np.arange(300) % 3, 0.3, scale)[:, None]).astype("f4"))]
    rows += [(300, [1e25] + [0.0] * 7), (301, [1e30] + [0.0] * 7)]  # out of range with each other and themselves
    rows = [(i, [0.0] + v[1:]) if i < 300 else (i, v) for i, v in rows]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got: dict = {}
    for r in exact_top_k(frame.where("vec_id < 301"), F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.score, -r.vec_id))
    whole = {i: [math.floor(64 * x) for x in v] for i, v in rows if i < 301}
    assert got == {q: sorted(((sum(x * y for x, y in zip(whole[q], v)), -i) for i, v in whole.items() if i != q), reverse=True)[:20] for q in whole if q % 20 == 0}
    with pytest.raises(Exception, match="does not fit a long"):
        exact_top_k(frame, F.col("vec_id") == 300).collect()


def test_cover_tree_keeps_ties_of_negative_scores():
    data = np.array([[100.0, 50.0]] * 200 + [[100.0, -50.0]] * 200)
    row, found, score, _ = dual_search(np.arange(400), data, np.array([1000]), np.array([[-100.0, 0.0]]), np.array([-np.inf]), 20)
    assert sorted(found) == list(range(20)) and set(score) == {-10000}


def test_cover_tree_is_exact(spark):
    frame, rows = vectors(spark)
    got: dict = {}
    for r in exact_top_k(frame, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((float(r.score), -r.vec_id))
    assert got == {q: v for q, v in best(rows, lambda x: math.floor(64 * x), True).items() if v}
    assert exact_top_k(frame.limit(0), F.lit(True)).count() == 0


def test_projected_recall(spark):
    frame, rows = vectors(spark)
    got: dict = {}
    for r in nearest_projected(frame, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, set()).add(-r.vec_id)
    want = best(rows, float, False)
    assert np.mean([len(got[q] & {i for _, i in v}) / len(v) for q, v in want.items() if v]) >= 0.9


def clustered(n=4000, groups=40, dims=16, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((groups, dims)) * 4
    return np.round((centres[rng.integers(0, groups, n)] + rng.standard_normal((n, dims)) * 0.15) * 64)


def brute(ids, data, own, queries, k=20):
    out = []
    for i, q in zip(own, queries, strict=True):
        best: dict = {}
        for j, s in zip(ids, data @ q, strict=True):
            if j != i:
                best[j] = max(best.get(j, -math.inf), s)
        out.append(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k])
    return out


def test_dual_trees_score_a_part_of_the_pairs():
    data = clustered()
    ids = np.arange(len(data))
    own, queries = ids[::20], data[::20]
    none = np.full(len(own), -np.inf)
    row, found, score, scored = dual_search(ids, data, own, queries, none, 20)
    got = [[] for _ in own]
    for r, f, s in zip(row, found, score, strict=True):
        got[r].append((f, s))
    want = brute(ids, data, own, queries)
    assert [sorted(g, key=lambda x: (-x[1], x[0])) for g in got] == want
    assert scored < 0.5 * len(data) * len(own)
    # With scores known from elsewhere fewer still, and no less is found.
    kth = np.array([w[-1][1] for w in want])
    row2, found2, _, again = dual_search(ids, data, own, queries, kth, 20)
    assert again <= scored and sorted(zip(row2, found2)) == sorted(zip(row, found))


def test_cells_of_the_whole_table_are_left_out():
    from tidemark.llm.cover_tree import CoverCells

    data, space = clustered(), CoverCells()
    model = space.fit(data[:1000], 30)
    cell = space.assign(model, data)
    cells = np.unique(cell)
    low, high = (np.array(x) for x in zip(*(space.extent(model, c, data[cell == c]) for c in cells), strict=True))
    queries = data[::20]
    kth = np.array([w[-1][1] for w in brute(np.arange(len(data)), data, np.arange(len(data))[::20], queries)])
    worth = space.worth(model, cells, low, high, queries, kth)
    held = (queries @ data.T >= kth[:, None])
    assert worth.mean() < 0.5 and not any(held[:, cell == c].any(axis=1)[~worth[:, i]].any() for i, c in enumerate(cells))


@pytest.mark.parametrize("kind", ["clustered", "even"])
def test_projections_verify_a_part_of_the_pairs(kind):
    from tidemark.llm.projected_knn import DIMS, SURE, ProjectedCells

    rng = np.random.default_rng(8)
    data = clustered() / 64 if kind == "clustered" else rng.standard_normal((4000, 64))
    data /= np.linalg.norm(data, axis=1)[:, None]
    ids = np.arange(len(data))
    own, queries = ids[::20], data[::20]
    space = ProjectedCells(1 + 1e-9, DIMS, SURE, 7)
    row, found, score, count = space.verified(ids, data, own, queries, np.full(len(own), -np.inf), 20)
    want = brute(ids, data, own, queries)
    hits = sum(len({i for i, _ in want[r]} & set(found[row == r])) for r in range(len(own)))
    assert hits >= 0.9 * 20 * len(own) and count < 0.8 * len(data) * len(own)
    assert kind == "even" or count < 0.5 * len(data) * len(own)
    model = space.fit(data[:1000], 30)
    cell = space.assign(model, data)
    assert len(np.unique(cell)) == 30
    low, high = (np.array(x) for x in zip(*(space.extent(model, c, data[cell == c]) for c in range(30)), strict=True))
    worth = space.worth(model, np.arange(30), low, high, queries, np.array([w[-1][1] for w in want]))
    assert kind == "even" or worth.mean() < 0.5


@pytest.mark.parametrize("name", ["cover", "projected"])
def test_searches_over_many_cells_and_repeated_ids(spark, monkeypatch, name):
    from tidemark.llm import knn

    monkeypatch.setattr(knn, "BLOCK_ROWS", 100)
    monkeypatch.setattr(knn, "QUERY_ROWS", 7)
    data = clustered(1500, 30, 8) / 64
    rows = [(i, v.tolist()) for i, v in enumerate(data.astype("f4"))]
    rows += [(5000, (data[0] * (1 + j / 100)).tolist()) for j in range(30)]  # one id, best with the longest
    rows += [(20, data[7].tolist())] * 3 + [(6000 + j, data[40].tolist()) for j in range(60)]  # a query's id again, ties
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    asked = F.col("vec_id") % 20 == 0
    value = (lambda x: math.floor(64 * x)) if name == "cover" else float
    out = (exact_top_k if name == "cover" else nearest_projected)(frame, asked).orderBy("query_id", "rank").collect()
    ids = np.array([i for i, _ in rows])
    whole = np.array([[value(float(np.float32(x))) for x in v] for _, v in rows])
    got: dict = {}
    for r in out:
        got.setdefault(r.query_id, []).append((r.vec_id, float(r.score)))
        assert r["rank"] == len(got[r.query_id])
    hits = total = 0
    for q in {i for i in ids.tolist() if i % 20 == 0}:
        best: dict = {}
        for v in whole[ids == q]:
            for j, s in zip(ids.tolist(), whole @ v, strict=True):
                if j != q:
                    best[j] = max(best.get(j, -math.inf), float(s))
        want = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:20]
        assert len(got[q]) == 20
        if name == "cover":
            assert got[q] == want
        hits, total = hits + len({i for i, _ in got[q]} & {i for i, _ in want}), total + 20
        assert all(s == pytest.approx(best[j], abs=1e-5) for j, s in got[q])
    assert hits >= 0.9 * total


def test_signatures_estimate_weighted_jaccard():
    base = [f"w{i % 90}" for i in range(500)]
    texts = [" ".join(base), " ".join(base[:430] + ["z"] * 70), "a b c " * 200, "a b c " * 170]
    doc, keys, times = bags(pa.array(texts))
    s = signatures(doc, keys, times, 4, 4096)
    for a, b in ((0, 1), (2, 3)):
        x, y = (dict(zip(keys[doc == i].tolist(), times[doc == i].tolist(), strict=True)) for i in (a, b))
        true = sum(min(v, y.get(k, 0)) for k, v in x.items()) / sum(max(x.get(k, 0), y.get(k, 0)) for k in {*x, *y})
        assert (s[a] == s[b]).mean() == pytest.approx(true, abs=0.04)


def test_bit_sketch_keeps_pairs_at_the_limit():
    from tidemark.llm.bagminhash import LONGER, agreeing, bit_pieces, least_agreeing

    base = [f"w{i}" for i in range(1000)]
    texts = [" ".join(base), " ".join(base[:890] + [f"z{i}" for i in range(110)]), " ".join(base[:500] + [f"y{i}" for i in range(500)]), "one"]
    pieces = bit_pieces(signatures(*bags(pa.array(texts)), 4, LONGER))
    count = agreeing(pieces[0], pieces)
    assert count[0] == LONGER and agreeing(pieces[3], pieces[3:])[0] == LONGER
    assert count[1] >= least_agreeing(0.8) > count[2]  # 886 of 1,106 shingles; 496 of 1,496
    assert count[2] == pytest.approx(LONGER * (1 + 3 * 496 / 1496) / 4, abs=70)
    assert least_agreeing(1.0) == LONGER and least_agreeing(0.0) < LONGER / 4


def classes(texts):
    """Smallest index of each text's class, by all pairs."""
    bag = []
    for t in texts:
        w = t.encode().lower().split()
        bag.append(Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter())
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = sum((bag[i] & bag[j]).values())
            if both and both >= 0.8 * (bag[i].total() + bag[j].total() - both) and group[i] != group[j]:
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    return group


@pytest.mark.parametrize("most", [1024, 8])
def test_near_duplicates_in_a_group_that_is_mostly_below_the_limit(spark, monkeypatch, most):
    """A chain of edits from one text: neighbours at 0.8 or just below, the rest far less; and copies of one of them."""
    from tidemark.llm import bagminhash

    monkeypatch.setattr(bagminhash, "MOST", most)
    random.seed(11)
    words = [f"w{i}" for i in range(120)]
    texts = []
    for k in range(150):
        own = list(words)
        for at in random.sample(range(0, 120, 6), random.choice([1, 2, 3, 4, 6])):
            own[at] = f"x{k}{at}"
        texts.append(" ".join(own))
        if k % 3 == 0:
            words = own
    texts += [texts[3]] * 20 + [texts[0].upper()]
    group = classes(texts)
    assert 5 < len(set(group)) < 140
    rows = near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in rows} == dict(enumerate(group))


@pytest.mark.parametrize("depth", [1, 2])
def test_pairs_meet_in_split_buckets(depth):
    """Pairs at the limit, all of whose buckets are split: each meets in one spot of one band."""
    from tidemark.llm import bagminhash

    rng, texts, n = np.random.default_rng(11), [], 40
    for _ in range(n):
        words = [f"w{x}" for x in rng.integers(0, 1 << 40, 204)]
        other = [*words]
        for at in (30, 80, 130, 180)[: 4 if rng.random() < 0.5 else 3]:  # each changes 5 of 200 shingles
            other[at] = "new"
        texts += [" ".join(words), " ".join(other)]
    parts = bags(pa.array(texts))
    keys = bagminhash.band_keys(signatures(*parts, 2 * n))
    pieces = bagminhash.bit_pieces(signatures(*parts, 2 * n, bagminhash.LONGER))
    split = [depth * sum(1 << 3 * b for b in range(16))] * (2 * n)
    rows = {
        "bucket": keys.view(np.int64).T.reshape(-1), "band": np.repeat(np.arange(32, dtype=np.int32), 2 * n), "bag": np.tile(np.arange(2 * n), 32),
        "n": np.full(64 * n, 200), "label": np.tile(np.arange(2 * n), 32), "depth": np.full(64 * n, depth, np.int32),
        "pieces": pa.array([x.tobytes() for x in pieces] * 32, pa.binary()), "depths0": split * 32, "depths1": split * 32,
        "keys": pa.array([x.astype("<u4").tobytes() for x in keys] * 32, pa.binary()),
    }
    spots = pa.Table.from_batches(bagminhash._split(pa.table(rows).to_batches())).sort_by("spot").combine_chunks()
    met = pa.Table.from_batches(bagminhash._meet(0.8)(spots.to_batches()))
    assert sorted(zip(met["a"].to_pylist(), met["b"].to_pylist())) == [(2 * i, 2 * i + 1) for i in range(n)]


def test_keep_one_with_names_of_its_own(spark):
    frame = spark.createDataFrame([(1, "a b c d e f", 7, "x", "r"), (2, "a b c d e f", 8, "y", "s"), (3, " ", 9, "z", "t")], "doc_id long, text string, _id long, keeper_key string, row string").withColumn("id", F.lit("i")).withColumn("wordless", F.lit(5))
    assert [tuple(r) for r in keep_one(frame).orderBy("doc_id").collect()] == [(1, "a b c d e f", 7, "x", "r", "i", 5), (3, " ", 9, "z", "t", "i", 5)]


def test_near_duplicates_against_all_pairs(spark, docs, hard):
    rows = [(r.doc_id, (r.text or "")) for r in docs.collect()]
    bag = []
    for _, t in rows:
        w = t.encode().lower().split()
        bag.append(Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter())
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = sum((bag[i] & bag[j]).values())
            if both and both >= 0.8 * (bag[i].total() + bag[j].total() - both) and group[i] != group[j]:
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    want = {}
    for (i, _), g in zip(rows, group, strict=True):
        want[i] = min(d for (d, _), h in zip(rows, group, strict=True) if h == g)
    got = {r.doc_id: r.class_id for r in near_duplicates(docs).collect()}
    assert got == want
    assert near_duplicates(hard).count() == len(HARD)
    # documents 1 and 5 share 10 of 12 shingles; document 7 stands there twice
    assert keep_one(hard).count() == len(HARD) - 2 and keep_one(hard).columns == hard.columns
    assert near_duplicates(hard.limit(0)).count() == 0


def test_mix(spark, hard):
    out = mixed(hard, block_words=100).collect()
    assert len(out) == len(HARD) and all(len(r.draws) <= 3 for r in out)
    assert sum({r.source: r.target for r in out}.values()) == pytest.approx(sum(r.size for r in out))
    assert mix_rows(hard).columns == hard.columns and mixed(hard.limit(0)).count() == 0


def test_quotas_stay_exact_and_follow_the_urn(spark):
    quotas = spark.createDataFrame([(0, 50), (1, 7), (2, 0), (3, 1)], "source int, blocks long")
    leaves = split_quotas(quotas, 5, 3).toPandas()
    assert leaves.groupby("source").blocks.sum().to_dict() == {0: 50, 1: 7, 3: 1}
    assert leaves.groupby("shard").blocks.sum().between(11, 12).all()
    # Of 20 and 60 blocks a half of 40 gets 10 of the first on average, with the urn's variance of 3.8.
    pair = spark.createDataFrame([(0, 20), (1, 60)], "source int, blocks long")
    left = [split_quotas(pair, 2, seed).where("shard = 0 AND source = 0").first().blocks for seed in range(25)]
    assert np.mean(left) == pytest.approx(10, abs=1.6) and 1 < np.var(left) < 9


def test_mix_deals_disjoint_blocks_to_shards(spark):
    rng = random.Random(4)
    rows = [(i, f"s{min(rng.randrange(8), 2)}", " ".join(["w"] * rng.randrange(0, 40))) for i in range(400)] + [(1000 + i, "silent", "") for i in range(300)]
    names = ["rank", "passes", "rest", "n_blocks", "_block", "pass", "shard", "seat", "cut", "words", "turn", "_row", "_size", "size", "row", "key", "place", "low"]
    frame = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumns({n: F.lit(f"own {n}") for n in names})
    options = {"block_words": 100, "shard_words": 500}
    out = mixed(frame, **options).collect()
    assert all(getattr(r, n) == f"own {n}" for r in out for n in names if n not in ("size",))
    size, source = {i: len(t.split()) for i, _, t in rows}, {i: s for i, s, _ in rows}
    taken: Counter = Counter()
    for r in out:
        taken[r.source] += r.size * len(r.draws)
        assert len({d["pass"] for d in r.draws}) == len(r.draws) <= 3 and r.size == size[r.doc_id]
    for r in out:
        assert abs(taken[r.source] - r.target) <= 20
    shards = max(d.shard for r in out for d in r.draws) + 1
    assert shards == math.ceil(sum(size.values()) / 500) > 4
    again = {r.doc_id: r.draws for r in mixed(frame.repartition(7), **options).collect()}
    assert again == {r.doc_id: r.draws for r in out}
    mix = mix_rows(frame, **options)
    assert mix.columns == frame.columns
    # Each row stands where its seat says, with the rows of its shard.
    got = [r.doc_id for r in mix.collect()]
    want: dict = {}
    for r in out:
        for d in r.draws:
            want.setdefault(d.shard, []).append((d.seat, d["pass"], r.doc_id))
    runs = [[i for *_, i in sorted(v)] for v in want.values()]
    text = "," + ",".join(map(str, got)) + ","
    assert len(got) == sum(map(len, runs)) and all("," + ",".join(map(str, run)) + "," in text for run in runs)
    assert len({i for i in source if source[i] == "silent"} & {r.doc_id for r in out}) == 300


@pytest.mark.parametrize("words", [(300, 2_000), (2_000, 5_000)])
def test_mix_matches_sql_with_many_shards(spark, words):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF_DIR}/documents.parquet'")
    want = {r[0]: r[-1] for r in con.sql(mix_sql(*words)).to_arrow_table().select(["doc_id", "draws"]).to_pandas().itertuples(index=False)}
    got = {r.doc_id: ",".join(f"{d['pass']}:{d.shard}:{d.seat}" for d in r.draws) for r in mixed(docs, block_words=words[0], shard_words=words[1]).collect()}
    assert got == want and len({d.split(":")[1] for v in got.values() for d in v.split(",") if d}) > 8


@pytest.mark.parametrize("name", sorted(SQL))
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    tables = [QUERIES[name](spark, SF_DIR).toArrow(), con.sql(SQL[name]).to_arrow_table()]
    a, b = (sorted(tuple(map(repr, (r[c] for c in sorted(r)))) for r in t.to_pylist()) for t in tables)
    assert a == b


def test_pipeline(spark, hard):
    assert corpus_pipeline.run(spark, SF_DIR).count() > 0
    frame = hard
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, frame, SF_DIR)
        if name != "packing":
            assert out.columns == hard.columns
        frame = spark.createDataFrame(out.collect(), out.schema)
        empty = stage(spark, hard.limit(0), SF_DIR)
        assert empty.count() == 0
