"""Line deduplication by a deletion-neighbourhood join.

Two lines are copies if they are equal, or (from MIN_NEAR characters on) if one edit turns one into the other. A
line goes if an earlier line, by (doc_id, hash of the text, line number), is its copy.

Each distinct line emits the hashes of its variants: itself, and the line without character i. Lines that share a variant
are within two edits; with the deleted place in the key they are within one: equal (variant, place) means a
substitution at that place, variant = whole line means an insertion. So the earliest line of a key stands for all
its lines and no pairs are listed, however many lines share a key. The edit distance of each line to the earlier line
found is then verified on the texts.

Only lines that can have a copy emit variants: one edit leaves the first or the last half of the shorter line
intact, so a line whose halves no other line shares has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut_lineage, mix, ship, small

ship(__name__)

MIN_NEAR = 20  # characters; shorter lines are copies only if equal
BASE = np.uint64(0x9E3779B97F4A7C55)  # odd, so it has an inverse
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
VARIANT_DDL = "id long, variant long, place int"


def variants(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the text (place -1) and of the text without character i (place i)."""
    codes = mix(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64) + np.uint64(1))
    n = len(codes)
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, BASE, dtype=np.uint64)]), dtype=np.uint64)
        upto = np.concatenate([[np.uint64(0)], np.cumsum(codes * powers[:n], dtype=np.uint64)])
        place = np.arange(n)
        less = upto[place] + (upto[n] - upto[place + 1]) * INVERSE
        # The length is mixed in, so that variants of unequal length never meet.
        whole = mix(upto[n : n + 1] + powers[n] * np.uint64(3))
        less = mix(less + powers[n - 1] * np.uint64(3)) if n else less
    return np.concatenate([whole, less]), np.concatenate([[-1], place]).astype(np.int32)


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, found, size = [], [], 0
        for line, text in zip(batch.column("id").to_pylist(), batch.column("content").to_pylist(), strict=True):
            ids.append(line)
            found.append(variants(text))
            size += len(found[-1][0])
            if size > 200_000:
                yield _rows(ids, found)
                ids, found, size = [], [], 0
        if ids:
            yield _rows(ids, found)


def _rows(ids: list[int], found: list) -> pa.RecordBatch:
    n = [len(v) for v, _ in found]
    return pa.RecordBatch.from_arrays(
        [pa.array(np.repeat(ids, n), pa.int64()), pa.array(np.concatenate([v for v, _ in found]).view(np.int64)), pa.array(np.concatenate([p for _, p in found]))],
        names=["id", "variant", "place"],
    )


def _halves(content):
    """Keys of which two lines within one edit share at least one: (side, length of the half, hash)."""
    n = F.char_length(content)
    keys = []
    for h in (F.floor(n / 2).cast("int"), F.floor((n - 1) / 2).cast("int")):
        keys.append(F.xxhash64(F.lit(0), h, F.substring(content, F.lit(1), h)))
        keys.append(F.xxhash64(F.lit(1), h, F.substring(content, n - h + 1, h)))
    return F.array_distinct(F.array(*keys))


def repeated_lines(docs: DataFrame, min_near: int = MIN_NEAR) -> DataFrame:
    """Lines that go: doc (doc_id, null as the largest long), tie (hash of the text), line (from 0), near (boolean).

    Line breaks are "\\n". Blank lines (spaces only) never go. Rows with equal doc_id and text are one document here:
    each gets the same lines removed. near: the earlier copy differs by one edit.
    """
    text = F.coalesce("text", F.lit(""))
    each = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("doc"), F.xxhash64(text).alias("tie"), F.posexplode(F.split(text, "\n")).alias("line", "content")
    ).where(F.trim("content") != "")
    # The key stands for the line's text; 64 bits make an accidental match of two lines of one corpus unlikely.
    each = each.withColumn("key", F.xxhash64("content"))
    at = F.struct("doc", "tie", "line")
    # An edit makes a line of min_near characters or more; the shorter one of an insertion may have one less.
    halves = F.when(F.char_length("content") >= min_near - 1, _halves(F.col("content")))
    lines = cut_lineage(each.withColumn("halves", halves).groupBy("key").agg(F.min(at).alias("first"), F.count("*").alias("n"), F.first("halves").alias("halves")))
    half = lines.select("key", F.explode("halves").alias("half"))
    shared = cut_lineage(half.groupBy("half").agg(F.min("key").alias("p"), F.max("key").alias("q")).where("p != q").select("half"))
    able = cut_lineage(half.join(small(shared), "half", "left_semi").select("key").distinct().join(lines.select("key", "first"), "key"))
    same = (F.col("doc") == F.col("first.doc")) & (F.col("tie") == F.col("first.tie")) & (F.col("line") == F.col("first.line"))
    texts = cut_lineage(each.join(small(able), "key").where(same).select("key", "first", "content").dropDuplicates(["key"]))
    emitted = texts.select(F.col("key").alias("id"), "content").mapInArrow(_emit, VARIANT_DDL)
    # Most variants belong to one line alone: only the others go on.
    met = cut_lineage(emitted.groupBy("variant").agg(F.min("id").alias("p"), F.max("id").alias("q")).where("p != q").select("variant"))
    order = texts.select(F.col("key").alias("id"), "first", F.char_length("content").alias("size"))
    placed = cut_lineage(emitted.join(small(met), "variant", "left_semi").join(order, "id"))
    known = placed.select("id", "variant", "place", "first", F.struct("first", "id").alias("who"), "size")
    whole, cut = known.where("place = -1"), known.where((F.col("place") >= 0) & (F.col("size") >= min_near))
    best = lambda df, *on: df.groupBy(*on).agg(F.min("who").alias("best"))
    ask = lambda left, right, on: left.join(right, on).where(F.col("best.first") < F.col("first")).select("id", F.col("best.id").alias("other"))
    hits = ask(cut, best(cut, "variant", "place"), ["variant", "place"]).unionByName(ask(cut, best(whole, "variant"), ["variant"])).unionByName(ask(whole, best(cut, "variant"), ["variant"]))
    text_of = lambda name, column: texts.select(F.col("key").alias(name), F.col("content").alias(column))
    checked = hits.distinct().join(text_of("id", "x"), "id").join(text_of("other", "y"), "other").where(F.levenshtein("x", "y", 1) == 1)
    near = cut_lineage(checked.select(F.col("id").alias("key"), F.lit(True).alias("near")).distinct())
    # Lines that go: all occurrences of a near copy, and all but the first of the rest.
    bad = lines.select("key", "first", "n").join(near, "key", "left").where("n > 1 OR near").select("key", "first", F.coalesce("near", F.lit(False)).alias("near"))
    return each.select("key", "doc", "tie", "line").join(bad, "key").where(F.col("near") | ~same).select("doc", "tie", "line", "near").distinct()


def line_dedup(docs: DataFrame, min_near: int = MIN_NEAR) -> DataFrame:
    """docs with the repeated lines taken out of `text`, and n_lines, n_kept, n_near (long).

    All other columns stay; ones of the names n_lines, n_kept or n_near are replaced (names that begin with _ are ours). Every row stays: a text all of whose lines
    are copies becomes empty, a null text stays null (0 lines). An empty text has one blank line, which stays. The
    order of the lines stays. Equal lines within one text count too. Repeated rows get equal results.
    """
    text = F.coalesce("text", F.lit(""))
    gone = repeated_lines(docs, min_near).groupBy("doc", "tie").agg(F.collect_list("line").alias("_gone"), F.count_if("near").alias("_near"))
    own = docs.withColumn("_doc", F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))).withColumn("_tie", F.xxhash64(text))
    joined = own.join(gone.toDF("_doc", "_tie", "_gone", "_near"), ["_doc", "_tie"], "left")
    parts = F.split("text", "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), "_gone")  # by hashing, so linear in the lines of a text
    kept = F.array_join(F.transform(stay, lambda i: F.get(parts, i)), "\n")
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size(parts)).cast("long")
    less = F.coalesce(F.size("_gone"), F.lit(0))
    return joined.select(
        *[F.when(F.col("_gone").isNull(), F.col("text")).otherwise(kept).alias(c) if c == "text" else F.col(c) for c in docs.columns if c not in ("n_lines", "n_kept", "n_near")],
        n.alias("n_lines"),
        (n - less).cast("long").alias("n_kept"),
        F.coalesce("_near", F.lit(0)).cast("long").alias("n_near"),
    )
