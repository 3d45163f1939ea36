"""Document fingerprints by a homomorphic multiset hash.

A paragraph (what lies between line breaks, empty ones too) is hashed to a wide vector; a text's fingerprint is the sum of
its paragraphs' vectors, modulo a power of two in every place. So it does not depend on the order of paragraphs, and
paragraphs are inserted or deleted by adding or subtracting their vectors, without the rest of the text.

A vector has two parts. STRONG places modulo 2^64, filled from a 128-bit hash of the whole paragraph, tell
multisets of paragraphs apart. LIKE places modulo 2^16 count the paragraph's five-word shingles (all words, if fewer), each in
one place with a sign, both from its hash: inner products of such parts estimate those of the shingle counts (standard
error about 1 / sqrt(LIKE)), so two fingerprints alone tell how much two texts have in common.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import mix, ship, split_words, word_keys

ship(__name__)

STRONG = 32  # places modulo 2^64
LIKE = 256  # places modulo 2^16
WORDS = 5
SPREAD = np.uint64(0x9E3779B97F4A7C15)
BUCKET_BYTES = 8 << 20  # of text in a range of neighbours
TEXTS = 256  # fingerprinted at once
BYTES = 4 << 20  # of text fingerprinted at once, unless one text is longer


def fingerprints(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(n, STRONG) unsigned 64-bit and (n, LIKE) signed 16-bit sums."""
    return _summed([t.split("\n") for t in texts])


def _summed(texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    counts = np.array([len(t) for t in texts], dtype=np.int64)
    paragraphs = [p for t in texts for p in t]
    owner = np.repeat(np.arange(len(texts)), counts)
    strong = np.zeros((len(texts), STRONG), dtype=np.uint64)
    digest = xxhash.xxh3_128_intdigest
    wide = [digest(p.encode()) for p in paragraphs]
    high = np.array([x >> 64 for x in wide], dtype=np.uint64)
    low = np.array([x & 0xFFFFFFFFFFFFFFFF for x in wide], dtype=np.uint64)
    with np.errstate(over="ignore"):
        turn = np.arange(1, STRONG + 1, dtype=np.uint64) * SPREAD
        for at in range(0, len(owner), 8192):
            part = slice(at, at + 8192)
            vectors = mix(mix(low[part, None] + turn) + high[part, None])
            here, first = np.unique(owner[part], return_index=True)  # owners ascend
            strong[here] += np.add.reduceat(vectors, first, axis=0)
    each, words = split_words(pa.array(paragraphs, pa.large_string()))
    keys = word_keys(words)
    like = np.zeros(len(texts) * LIKE, dtype=np.int64)
    if len(keys):
        place = np.repeat(np.arange(len(paragraphs)), each)
        left = np.cumsum(each)[place] - np.arange(len(keys))  # words from here to the paragraph's end
        short = each[place] < WORDS
        chain = mix(keys + SPREAD)
        with np.errstate(over="ignore"):
            for d in range(1, WORDS):
                there = left > d
                chain[:-d] = np.where(there[:-d], mix(chain[:-d] * SPREAD + keys[d:]), chain[:-d]) if len(keys) > d else chain[:-d]
        starts = np.where(short, left == each[place], left >= WORDS)
        own, chain = owner[place][starts], chain[starts]
        spot = own * LIKE + (chain % np.uint64(LIKE)).astype(np.int64)
        sign = 1 - 2 * (chain >> np.uint64(63)).astype(np.int64)
        like = np.bincount(spot, weights=sign, minlength=len(like)).astype(np.int64)
    return strong, like.reshape(len(texts), LIKE).astype(np.int16)


def packed(strong: np.ndarray, like: np.ndarray) -> list[str]:
    """Fingerprints as text: base64 of the places, little-endian, STRONG ones first."""
    return [base64.b64encode(a.astype("<u8").tobytes() + b.astype("<i2").tobytes()).decode() for a, b in zip(strong, like, strict=True)]


def unpacked(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    data = base64.b64decode(fingerprint)
    return np.frombuffer(data, "<u8", STRONG), np.frombuffer(data, "<i2", LIKE, 8 * STRONG)


def changed(fingerprint: str, inserted: list[str] = (), deleted: list[str] = ()) -> str:
    """The fingerprint after paragraphs come and go, without the text."""
    strong, like = (x.copy() for x in unpacked(fingerprint))
    with np.errstate(over="ignore"):
        for paragraphs, sign in ((inserted, 1), (deleted, -1)):
            if paragraphs:
                more, alike = _summed([list(paragraphs)])
                strong = strong + more[0] if sign > 0 else strong - more[0]
                like = like + alike[0] if sign > 0 else like - alike[0]
    return packed(strong[None], like[None])[0]


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Row by row, 0 to 1: twice the common shingles by all of both, as the sums estimate it; 1 if the fingerprints are equal."""
    x, y = a[1].astype(np.float64), b[1].astype(np.float64)
    whole = (x * x).sum(axis=1) + (y * y).sum(axis=1)
    out = np.clip(2 * (x * y).sum(axis=1) / np.maximum(whole, 1.0), 0.0, 1.0)
    return np.where((a[0] == b[0]).all(axis=1) & (a[1] == b[1]).all(axis=1), 1.0, out)


# --- operator -------------------------------------------------------------------------------------------------

OUT_DDL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _rows(held: list[tuple[int | None, str, str]]) -> pa.RecordBatch:
    """(id, text, next text) to output rows."""
    texts, nexts = [t for _, t, _ in held], [t for _, _, t in held]
    edited = [t[: len(t) - len(t) // 2] + more[: len(t) // 2] for t, more in zip(texts, nexts, strict=True)]
    # A row's next is mostly the row after it, so it is hashed once.
    follow = all(a is b for a, b in zip(texts[1:], nexts, strict=False))
    both = fingerprints([*texts, nexts[-1]] if follow else texts + nexts)
    own = tuple(x[: len(texts)] for x in both)
    after = tuple(x[1:] if follow else x[len(texts) :] for x in both)
    new = fingerprints(edited)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([i for i, _, _ in held], pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
            pa.array(packed(*own)), pa.array(packed(*new)), pa.array(likeness(own, new)), pa.array(likeness(own, after)),
        ],
        names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


def _deal(firsts: np.ndarray):
    """Rows to their range; a range's first row also goes, as a guest, to the range before it in descending order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column("key").to_numpy()
            bucket = np.searchsorted(firsts, key)
            guest = np.flatnonzero(firsts[bucket] == key)
            rows = np.concatenate([np.arange(len(key)), guest])
            to = np.concatenate([bucket, (bucket[guest] + 1) % len(firsts)]).astype(np.int32)
            is_guest = np.arange(len(rows)) >= len(key)
            for at in range(0, len(rows), 2000):
                part = slice(at, at + 2000)
                some = batch.take(pa.array(rows[part]))
                yield pa.RecordBatch.from_arrays([pa.array(to[part]), pa.array(is_guest[part]), *some.columns], names=["bucket", "guest", *some.schema.names])

    return run


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges in order of their documents, each ended by its guest."""
    held: list[tuple[int | None, str, str]] = []
    last: tuple[int | None, str] | None = None  # waits for the text after it
    weight = 0
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            for guest, i, text in zip(*(part.column(c).to_pylist() for c in ("guest", "doc_id", "text")), strict=True):
                if last is not None:
                    held.append((*last, text))
                    weight += len(last[1])
                last = None if guest else (i, text)
                if len(held) >= TEXTS or weight >= BYTES:
                    yield _rows(held)
                    held, weight = [], 0
    if held:
        yield _rows(held)


def document_fingerprints(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Fingerprints of every text and of its edited text: the last half of its characters replaced by the first as many of the next document's.

    docs: doc_id, text; other columns are not read. Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    The next document: by descending doc_id, after the last the first. Null text is empty. Rows of equal doc_id stand in the order of a hash of their
    texts; rows without doc_id come last. One row alone is its own next. An empty table gives no rows.

    Texts are dealt once, into ranges of doc_id of about `bucket_bytes`, and read in order as a stream. Ranges end at
    quantiles of doc_id, of which the driver holds one a range.
    """
    text = F.coalesce("text", F.lit(""))
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    size = docs.agg(F.sum(F.octet_length(text).cast("long") + 64)).first()[0]
    if not size:
        return docs.sparkSession.createDataFrame([], OUT_DDL)
    parts = max(12, -(-size // bucket_bytes))
    cuts = docs.agg(F.percentile_approx(key, [i / parts for i in range(1, parts)], 100 * parts), F.max(key)).first()
    firsts = np.array(sorted({*cuts[0], cuts[1]}), dtype=np.int64)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), key.alias("key"), F.xxhash64(text).alias("tie"))
    dealt = base.mapInArrow(_deal(firsts), "bucket int, guest boolean, doc_id long, text string, key long, tie long")
    ordered = dealt.repartitionById(len(firsts), F.col("bucket")).sortWithinPartitions("bucket", "guest", F.desc("key"), "tie")
    return ordered.mapInArrow(_walk, OUT_DDL)
