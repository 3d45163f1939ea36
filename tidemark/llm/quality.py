"""Quality scores from preference pairs (Bradley-Terry), cut at a score quantile.

A document's score is w . f(text). The weights maximise the likelihood that the better document of a pair has the
higher score: logistic loss on the difference of the features. The cut is the quantile of the learning rows'
scores at the share of poor documents among them; scores are mapped to 0..1 so that the cut lies at 0.7.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut_lineage, give_back, ship, slices, split_words

ship(__name__)

MOST_LABELLED = 20_000  # learning rows of each label, those with the smallest hash of doc_id
PAIRS_EACH = 8  # preference pairs for each row of the larger label
CUT = 0.7
FEATURES = ["log_size", "upper", "digit", "space", "stop", "bang", "bar", "mark", "wide", "word_size", "distinct", "repeat", "shout", "marked", "line_size"]
# Classes of bytes: 0 other letters, 1 A-Z, 2 digits, 3 white space, 4 plain punctuation, 5 "!" and "?", 6 "|", 7 other marks, 8 non-ASCII
_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[:128] = 7
_CLASS[[*range(97, 123)]] = 0
_CLASS[[*range(65, 91)]] = 1
_CLASS[[*range(48, 58)]] = 2
_CLASS[[9, 10, 11, 12, 13, 32]] = 3
_CLASS[[ord(c) for c in ".,;:'\"()-"]] = 4
_CLASS[[ord("!"), ord("?")]] = 5
_CLASS[ord("|")] = 6
_CLASS[128:] = 8


def text_features(texts: pa.Array) -> np.ndarray:
    """(texts, FEATURES); an empty or null text has zeros."""
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    ends = np.frombuffer(texts.buffers()[1], dtype=np.int64, count=n + 1, offset=8 * texts.offset)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]] if data is not None else np.empty(0, np.uint8)
    size = np.diff(ends)
    row = np.repeat(np.arange(n), size)
    kinds = np.bincount(row * 9 + _CLASS[raw], minlength=9 * n).reshape(n, 9)
    lines = np.bincount(row[raw == 10], minlength=n) + 1
    share = kinds / np.maximum(size, 1)[:, None]
    counts, words = split_words(texts)
    out = np.zeros((n, len(FEATURES)))
    out[:, 0] = np.log1p(size)
    out[:, 1:9] = share[:, 1:9]
    if len(words):
        coded = words.dictionary_encode()
        code = coded.indices.to_numpy().astype(np.int64)
        doc = np.repeat(np.arange(n), counts)
        bytes_of = np.diff(np.frombuffer(coded.dictionary.buffers()[1], dtype=np.int64, count=len(coded.dictionary) + 1))
        width = np.asarray([[w.isupper() and len(w) > 1, not w[-1].isalnum() and w[-1] not in ".,;:'\")-"] for w in coded.dictionary.to_pylist()], dtype=bool)
        same = (code[1:] == code[:-1]) & (doc[1:] == doc[:-1])
        pairs = np.unique(doc * len(bytes_of) + code) // len(bytes_of)
        per = np.maximum(counts, 1)
        out[:, 9] = np.log1p(np.bincount(doc, weights=bytes_of[code], minlength=n) / per)
        out[:, 10] = (np.bincount(pairs, minlength=n) / per) * np.log1p(counts)
        out[:, 11] = np.bincount(doc[1:][same], minlength=n) / per
        out[:, 12] = np.bincount(doc, weights=width[code, 0], minlength=n) / per
        out[:, 13] = np.bincount(doc, weights=width[code, 1], minlength=n) / per
    out[:, 14] = np.where(size > 0, np.log1p(size / lines), 0.0)
    return out


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            f = text_features(part.column("text"))
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(f) + 1) * f.shape[1], pa.int32()), pa.array(f.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*part.drop_columns(["text"]).columns, vectors], names=[c for c in part.schema.names if c != "text"] + ["features"])
    give_back()


@dataclass
class Ranking:
    """centre, scale: of each feature; weights: of the standardised features; cut, spread: raw score at 0.7, and per logit."""

    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    spread: float

    def raw(self, f: np.ndarray) -> np.ndarray:
        return np.clip((f - self.centre) / self.scale, -8, 8) @ self.weights

    def score(self, f: np.ndarray) -> np.ndarray:
        raw = self.raw(f)
        score = 1 / (1 + np.exp(-np.clip(np.log(CUT / (1 - CUT)) + (raw - self.cut) / self.spread, -500, 500)))
        return np.where(raw >= self.cut, np.maximum(score, CUT), np.minimum(score, np.nextafter(CUT, 0)))


def fit_ranking(good: np.ndarray, poor: np.ndarray, share_poor: float, decay: float = 1e-3, steps: int = 60) -> Ranking:
    """Learn from features of good and of poor documents.

    Without one of the two kinds there is no pair: all weights are 0 and every score is exactly the cut.
    """
    both = np.concatenate([good, poor])
    centre = both.mean(axis=0) if len(both) else np.zeros(len(FEATURES))
    scale = np.maximum(both.std(axis=0), 1e-6) if len(both) else np.ones(len(FEATURES))
    weights = np.zeros(len(FEATURES))
    if not len(good) or not len(poor):
        return Ranking(centre, scale, weights, 0.0, 1.0)
    g, p = (np.clip((x - centre) / scale, -8, 8) for x in (good, poor))
    many = max(len(g), len(p))
    i = np.tile(np.arange(many), PAIRS_EACH)
    shift = np.repeat(np.arange(PAIRS_EACH), many) * 7919
    diff = g[(i + (shift if len(g) < len(p) else 0)) % len(g)] - p[(i + (shift if len(p) <= len(g) else 0)) % len(p)]
    for _ in range(steps):  # Newton's method; the loss is convex
        wrong = 1 / (1 + np.exp(np.clip(diff @ weights, -30, 30)))
        slope = decay * weights - diff.T @ wrong / len(diff)
        curve = (diff * (wrong * (1 - wrong))[:, None]).T @ diff / len(diff) + decay * np.eye(len(weights))
        step = np.linalg.solve(curve, slope)
        weights = weights - step
        if np.abs(step).max() < 1e-6:
            break
    raw = np.concatenate([g @ weights, p @ weights])
    # Each label may have been cut to MOST_LABELLED rows: weigh it by its true share.
    mass = np.concatenate([np.full(len(g), (1 - share_poor) / len(g)), np.full(len(p), share_poor / len(p))])
    order = np.argsort(raw, kind="stable")
    at = int(np.searchsorted(np.cumsum(mass[order]), share_poor - 1e-12))
    at = min(at, len(raw) - 2)
    cut = (raw[order[at]] + raw[order[at + 1]]) / 2
    return Ranking(centre, scale, weights, float(cut), float(max(raw.std() / 4, 1e-9)))


def _apply(ranking: Ranking):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = batch.column("features").flatten().to_numpy().reshape(-1, len(FEATURES))
            rest = batch.drop_columns(["features"])
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(ranking.score(f))], names=[*rest.schema.names, "score"])

    return run


def learned(features: DataFrame, labels: DataFrame, learn: Column, most: int = MOST_LABELLED) -> Ranking:
    """Fit on the rows of `features` (doc_id, features) with a label (doc_id, quality) where `learn` holds.

    The sample that comes to the driver is bounded: `most` rows of each label, of the smallest hashes.
    Labels that are null or neither 0 nor 1 are not used; a doc_id with both labels counts for both.
    """
    rows = features.where(learn).join(labels.where("quality in (0, 1)").select("doc_id", F.col("quality").cast("int").alias("quality")), "doc_id")
    tally = {r["quality"]: r["count"] for r in rows.groupBy("quality").count().collect()}
    sample = {q: rows.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select("features").collect() for q in tally}
    f = {q: np.array([r["features"] for r in sample.get(q, [])], dtype=float).reshape(-1, len(FEATURES)) for q in (0, 1)}
    total = sum(tally.values())
    return fit_ranking(f[1], f[0], tally.get(0, 0) / total if total else 0.0)


def quality_scores(docs: DataFrame, labels: DataFrame, learn: Column, most: int = MOST_LABELLED) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (1 from 0.7 on) of every row of docs.

    Only `text` is looked at. learn: over doc_id, the rows whose labels may be used. Null text counts as empty; an
    empty text has all features 0 and a score like any other. Repeated rows get equal scores; an empty table gives none.
    """
    features = cut_lineage(docs.select("doc_id", "text").mapInArrow(_features, "doc_id long, features array<double>"))
    ranking = learned(features, labels, learn, most)
    return features.mapInArrow(_apply(ranking), "doc_id long, score double").withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, learn: Column, most: int = MOST_LABELLED) -> DataFrame:
    """The rows of docs with a score of 0.7 or more; columns as they are. Sampling, nulls: as in quality_scores."""
    known = docs.join(labels.where("quality in (0, 1)").select("doc_id").distinct(), "doc_id", "left_semi")
    features = cut_lineage(known.where(learn).select("doc_id", "text").mapInArrow(_features, "doc_id long, features array<double>"))
    ranking = learned(features, labels, F.lit(True), most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield part.filter(pa.array(ranking.score(text_features(part.column("text"))) >= CUT))
        give_back()

    return docs.mapInArrow(run, docs.schema)
