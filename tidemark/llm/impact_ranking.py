"""Ranked lexical search by NRA: impact-sorted lists read in order, with a score interval for every document.

Documents lie in blocks; a block holds an inverted list for each query term it has, highest impact first. For an item, its
lists are read side by side, deeper each round, never by random access. What was read of a document is the lower end of its
score; the upper end adds the next unread impact of each list in which the document has not turned up. Documents whose
upper end is below the kth best lower end are out. Reading goes on until the interval of every document that is still
in has closed: then membership, ties and scores are final. A list that all remaining documents have turned up in is not
read further. The block's best meet those of other blocks; a document lies in one block, so its score is final.

Texts are cut into terms once. The counts that weights need (documents, lengths, documents a term) are sums over the
blocks. Items come in groups of bounded vocabulary: one group's terms, not the corpus's, travel to the tasks.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import array_of, binary_of, cut_lineage, ship

ship(__name__)

TERM = re.compile(rb"[0-9a-z\x80-\xff]+")  # over bytes whose A-Z are lower-cased: what is not ASCII has bytes from 0x80 on
BLOCK_POSTINGS = 1_000_000
BLOCK_DOCS = 32_768
GROUP_TERMS = 1_000_000  # terms of the items searched together, about
FIRST = 64  # postings of a list in the first round; twice as many in each later one


def terms_of(text: str | None) -> list[bytes]:
    return TERM.findall(text.encode().lower()) if text else []


# --- blocks of postings ---------------------------------------------------------------------------------------

BLOCK_DDL = "docs long, terms long, ids binary, null_ids binary, lengths binary, sizes binary, postings binary, times binary"


def _index(vocabulary: dict[bytes, int]):
    """Texts to blocks: ids, lengths in terms, and each document's query terms with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lengths, sizes, postings, times = [], [], [], [], []

        def emit() -> pa.RecordBatch:
            n = np.array(lengths, dtype=np.int64)
            row = [
                int((n > 0).sum()), int(n.sum()), binary_of(np.array([i or 0 for i in ids], dtype=np.int64)), binary_of(np.array([i is None for i in ids], dtype=np.int8)),
                binary_of(n), binary_of(np.array(sizes, dtype=np.int64)), binary_of(np.array(postings, dtype=np.int32)), binary_of(np.array(times, dtype=np.int64)),
            ]
            for held in (ids, lengths, sizes, postings, times):
                held.clear()
            return pa.RecordBatch.from_arrays([pa.array([v]) for v in row], names=["docs", "terms", "ids", "null_ids", "lengths", "sizes", "postings", "times"])

        for batch in batches:
            for i in range(batch.num_rows):
                words = terms_of(batch.column("text")[i].as_py())
                found = [(t, n) for w, n in Counter(words).items() if (t := vocabulary.get(w)) is not None]
                ids.append(batch.column("doc_id")[i].as_py())
                lengths.append(len(words))
                sizes.append(len(found))
                postings.extend(t for t, _ in found)
                times.extend(n for _, n in found)
                if len(postings) >= BLOCK_POSTINGS or len(ids) >= BLOCK_DOCS:
                    yield emit()
        if ids:
            yield emit()

    return run


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many documents of a block hold each term."""
    for batch in batches:
        for data in batch.column("postings").to_pylist():
            counts = np.bincount(array_of(data, "<i4"))
            some = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int64)), pa.array(counts[some].astype(np.int64))], names=["term", "df"])


# --- the search -----------------------------------------------------------------------------------------------


def nra(docs: np.ndarray, impacts: np.ndarray, starts: np.ndarray, stops: np.ndarray, n: int, ids: np.ndarray, k: int, first: int = FIRST) -> tuple[np.ndarray, np.ndarray]:
    """(document, score) of the k best of one block, best first; equal scores by ids.

    List i is docs[starts[i]:stops[i]] with its impacts, positive and falling. n: documents of the block.
    """
    lower = np.zeros(n, dtype=np.int64)
    alive = np.ones(n, dtype=bool)
    at, reading, step = starts.copy(), starts < stops, first
    of_doc, of_list = np.empty(0, np.int64), np.empty(0, np.int64)  # what was read, of documents still in
    while True:
        upto = np.where(reading, np.minimum(at + step, stops), at)
        many = upto - at
        lists = np.repeat(np.arange(len(at)), many)
        spot = np.arange(len(lists)) + np.repeat(at - (np.cumsum(many) - many), many)
        doc, value = docs[spot], impacts[spot]
        mine = alive[doc]
        np.add.at(lower, doc[mine], value[mine])
        of_doc, of_list = np.concatenate([of_doc, doc[mine]]), np.concatenate([of_list, lists[mine]])
        at, step = upto, step * 2
        left = at < stops
        heads = np.where(left, impacts[np.minimum(at, len(impacts) - 1)], 0) if len(impacts) else np.zeros(len(at), np.int64)
        # Upper ends: all heads but those of lists in which the document has turned up.
        turned = np.zeros(n, dtype=np.int64)
        np.add.at(turned, of_doc, heads[of_list])
        open_by = heads.sum() - turned
        kth = max(1, int(np.partition(lower, n - k)[n - k])) if n >= k else 1
        alive &= lower + open_by >= kth
        if not (open_by[alive] > 0).any():
            break
        keep = alive[of_doc]
        of_doc, of_list = of_doc[keep], of_list[keep]
        reading = left & (np.bincount(of_list, minlength=len(at)) < alive.sum())
    found = np.flatnonzero(alive & (lower > 0))
    best = found[np.lexsort((ids[found], -lower[found]))[:k]]
    return best, lower[best]


def _search(items: list[tuple[int | None, np.ndarray]], weights: np.ndarray, total_docs: int, total_terms: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, nulls = array_of(row["ids"], "<i8"), array_of(row["null_ids"], "i1").astype(bool)
                lengths, sizes = array_of(row["lengths"], "<i8"), array_of(row["sizes"], "<i8")
                term, times = array_of(row["postings"], "<i4"), array_of(row["times"], "<i8")
                doc = np.repeat(np.arange(len(ids)), sizes)
                longer = 10 + (90 * lengths * total_docs) // max(total_terms, 1)
                impact = weights[term] * ((1_000_000_000 * times) // (1000 * times + 8 * longer[doc]))
                order = np.lexsort((-impact, term))
                order = order[impact[order] > 0]
                term, doc, impact = term[order], doc[order], impact[order]
                cuts = np.searchsorted(term, np.arange(len(weights) + 1))
                rank_of = np.where(nulls, np.iinfo(np.int64).max, ids)
                out = []
                for item, own in items:
                    best, score = nra(doc, impact, cuts[own], cuts[own + 1], len(ids), rank_of, k)
                    out.append((np.full(len(best), item is None), np.full(len(best), item or 0), best, score))
                none, item, best, score = (np.concatenate(x) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(item.astype(np.int64), mask=none), pa.array(ids[best], mask=nulls[best]), pa.array(score)], names=["item_id", "doc_id", "score"]
                )

    return run


# --- operator -------------------------------------------------------------------------------------------------


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            own = sorted(set(terms_of(text)))
            if own:
                yield pa.RecordBatch.from_arrays([pa.array([item], pa.int64()), pa.array([own], pa.list_(pa.binary()))], names=["item_id", "terms"])


def ranked(docs: DataFrame, items: DataFrame, k: int = 10, group_terms: int = GROUP_TERMS) -> DataFrame:
    """item_id, rank (from 1), doc_id, score (long) of each item's k best documents of score above 0.

    docs: doc_id, text; items: item_id, text; other columns are not read. Terms are runs of ASCII letters and digits and of all characters
    from U+0080 on, with A-Z lower-cased; a null text has none. Every row of docs is a document of its own, also where doc_id is repeated or
    null; equal scores go by ascending doc_id, null last, and rows equal in both in any order. Rows of items with equal item_id are one item with
    the terms of all of them; an item without terms, or whose terms no document holds, has no rows. Empty tables give no rows. An item's
    terms travel together, so an item of a million terms makes a group of its own.
    """
    asked = cut_lineage(items.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(_item_terms, "item_id long, terms array<binary>"))
    total = asked.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
    groups = max(1, -(-total // group_terms))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = None
    for group in range(groups):
        rows = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(groups)) == group).collect()  # about `group_terms` terms
        vocabulary: dict[bytes, int] = {}
        own: dict[int | None, set[int]] = {}
        for r in rows:
            own.setdefault(r.item_id, set()).update(vocabulary.setdefault(bytes(t), len(vocabulary)) for t in r.terms)
        if not own and groups > 1:
            continue
        blocks = cut_lineage(texts.mapInArrow(_index(vocabulary), BLOCK_DDL))
        n, length = blocks.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("terms"), F.lit(0))).first()
        df = np.zeros(len(vocabulary), dtype=np.int64)
        for r in blocks.select("postings").mapInArrow(_frequencies, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():  # one row a term of the group
            df[r.term] = r.df
        weights = np.floor(1000 * np.log((2 * n + 2) / (2 * df + 1))).astype(np.int64)
        searched = [(item, np.array(sorted(terms), dtype=np.int64)) for item, terms in own.items()]
        if not searched:
            blocks = blocks.limit(0)
        part = blocks.mapInArrow(_search(searched, weights, n, length, k), "item_id long, doc_id long, score long")
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
