"""Near duplicates by BagMinHash over multisets of word shingles.

A text is the bag of its five-word shingles with their counts. For a shingle of weight w every unit of weight owns a Poisson
process of points (time, component); a component's value is its earliest time over all units of the bag. Two bags agree in a
component with probability sum min / sum max, their weighted Jaccard similarity. Units are grouped in dyadic blocks of
weight (0, 1], (1, 2], (2, 4], ...: one process makes a block's points in order of time, and a point falls on one
unit of its block; it counts if the bag's weight reaches that unit. A process stops at the first point that comes later than all
components, so most shingles cost one point.

Bags that agree in a band of the signature are compared on their whole bags. Bags, not rows, are compared, so copies
cost nothing; first one hub of each band's bucket is compared with all others there, which joins the copies of a text to one class.

A bucket that then holds several classes stays open: texts that are alike, but less than the limit, or not to the hub. Its bags
get a longer signature, kept as two bits a component; two components agree in both with probability (1 + 3 similarity) / 4. A
large open bucket is split by deeper bands: pieces of the longer signature, more of them the larger the bucket, in as many draws as keep
a pair at the limit together somewhere. Within what is left, bags of different classes whose bits show that they can reach the limit
are compared on their bags, in the first bucket that they share alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import exp, lgamma, log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut_lineage, give_back, mix, ship, slices, split_words, word_keys

ship(__name__)

WORDS = 5
SIMILAR = 0.8
COMPONENTS, BANDS = 128, 32  # a pair at 0.8 shares no band with a chance of 5e-8
PIECES, PIECE = 172, 6  # of the longer signature: pieces of so many components, two bits each
LONGER = PIECES * PIECE
MISS = 5e-8  # chance that a pair exactly as similar as asked fails the count of agreeing components
MOST = 1024  # bags of an open bucket that is not split
FALL = 6  # times as few bags in a bucket for each more piece, about
# Draws for 0, 1, 2, ... pieces: a pair at 0.8 agrees in each of the same 172 pieces with probability 0.85^6 and shares each band with 0.8^4.
# With so many draws of its own in each band it meets nowhere with a chance of 1e-7 at most, if all its buckets are split so deep.
DRAWS = (1, 8, 27, 92, 340, 1500, 7500)
SPREAD = np.uint64(0x9E3779B97F4A7C15)


def bags(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, count) of every distinct shingle; A-Z lower-cased, words between ASCII spaces.

    A text of fewer words has one shingle, all its words; a null text or one without words has none.
    """
    counts, parts = split_words(texts, lower=True)
    keys = word_keys(parts)
    ends = np.cumsum(counts)
    doc = np.repeat(np.arange(len(counts)), counts)
    left = ends[doc] - np.arange(len(keys)) if len(keys) else np.empty(0, np.int64)  # words from here to the text's end
    short = counts[doc] < words if len(keys) else np.empty(0, bool)
    with np.errstate(over="ignore"):
        chain = mix(keys + SPREAD)
        for d in range(1, words):
            there = (left > d) & (~short | (counts[doc] > d))
            more = np.zeros_like(keys)
            more[:-d] = keys[d:] if len(keys) > d else more[:-d]
            chain = np.where(there, mix(chain * SPREAD + more), chain)
    starts = np.where(short, left == counts[doc], left >= words) if len(keys) else np.empty(0, bool)
    doc, chain = doc[starts], chain[starts]
    with np.errstate(over="ignore"):
        _, at, times = np.unique(mix(chain + mix(doc.astype(np.uint64) * SPREAD + np.uint64(1))), return_index=True, return_counts=True)
    return doc[at], chain[at], times


def signatures(doc: np.ndarray, keys: np.ndarray, weights: np.ndarray, n: int, components: int = COMPONENTS) -> np.ndarray:
    """(n, components) earliest times; rows without shingles stay infinite."""
    blocks = np.where(weights > 1, np.ceil(np.log2(np.maximum(weights, 1))).astype(np.int64) + 1, 1)
    entry = np.repeat(np.arange(len(doc)), blocks)
    block = np.arange(len(entry)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    low = np.where(block > 0, 1 << np.maximum(block - 1, 0), 0)
    size = np.where(block > 0, low, 1)
    row, weight = doc[entry], weights[entry]
    with np.errstate(over="ignore"):
        seed = mix(keys[entry] + (block.astype(np.uint64) + np.uint64(1)) * SPREAD)
    out = np.full(n * components, np.inf)
    time = np.zeros(len(entry))
    turn = 0
    while len(row):
        with np.errstate(over="ignore"):
            first, second = mix(seed + np.uint64(2 * turn + 1) * SPREAD), mix(seed + np.uint64(2 * turn + 2) * SPREAD)
        time = time - np.log((first >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54) / (components * size)
        part = (second % np.uint64(components)).astype(np.int64)
        unit = low + ((second >> np.uint64(11)).astype(np.float64) * 2.0**-53 * size).astype(np.int64)
        hit = unit < weight
        np.minimum.at(out, row[hit] * components + part[hit], time[hit])
        live = np.flatnonzero(np.bincount(row, minlength=n))
        last = np.zeros(n)
        last[live] = out.reshape(n, components)[live].max(axis=1)
        go = time < last[row]
        row, weight, low, size, seed, time = row[go], weight[go], low[go], size[go], seed[go], time[go]
        turn += 1
    return out.reshape(n, components)


def band_keys(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    parts = signature.view(np.uint64).reshape(len(signature), bands, -1)
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * SPREAD, parts.shape[:2])
    with np.errstate(over="ignore"):
        for i in range(parts.shape[2]):
            out = mix(out * SPREAD + parts[:, :, i])
    return out


def bit_pieces(signature: np.ndarray) -> np.ndarray:
    """(n, PIECES) of 12 bits, two for each of a piece's components: equal times agree in both, a quarter of the others do."""
    mixed = mix(np.ascontiguousarray(signature).view(np.uint64)).reshape(len(signature), PIECES, PIECE)
    out = np.zeros((len(signature), PIECES), dtype=np.uint16)
    for i in range(PIECE):
        bits = mixed[:, :, i].astype(np.uint16)
        out |= (bits & np.uint16(1)) << np.uint16(i) | (bits >> np.uint16(1) & np.uint16(1)) << np.uint16(PIECE + i)
    return out


def agreeing(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Components in which a row of pieces agrees with others."""
    apart = one[None] ^ others
    return LONGER - np.bitwise_count((apart | apart >> np.uint16(PIECE)) & np.uint16((1 << PIECE) - 1)).sum(axis=1, dtype=np.int64)


def least_agreeing(similar: float, components: int = LONGER, miss: float = MISS) -> int:
    """The largest count that a pair of that similarity falls short of with a chance of at most `miss` (binomial tail)."""
    p = (1 + 3 * similar) / 4
    if p >= 1:
        return components
    below, count = 0.0, 0
    while count < components:
        below += exp(lgamma(components + 1) - lgamma(count + 1) - lgamma(components - count + 1) + count * log(p) + (components - count) * log1p(-p))
        if below > miss:
            break
        count += 1
    return count


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two bags (sorted shingles, counts)."""
    at = np.searchsorted(b[0], a[0])
    at[at == len(b[0])] = 0
    same = b[0][at] == a[0] if len(b[0]) else np.zeros(len(a[0]), bool)
    both = np.minimum(a[1][same], b[1][at[same]]).sum()
    whole = a[1].sum() + b[1].sum() - both
    return float(both / whole) if whole else 0.0


SIGN_DDL = "doc_id long, text_key long, bag long, n long, bands array<long>"


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            n = part.num_rows
            doc, keys, times = bags(part.column("text"))
            size = np.bincount(doc, weights=times, minlength=n).astype(np.int64)
            with np.errstate(over="ignore"):
                # A sum over the bag does not depend on order.
                bag = np.zeros(n, dtype=np.uint64)
                np.add.at(bag, doc, mix(keys * SPREAD + times.astype(np.uint64)))
                bag = mix(bag + size.astype(np.uint64) * SPREAD)
            bands = band_keys(signatures(doc, keys, times, n))
            some = size > 0
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(some, BANDS, 0))]), pa.int32()), pa.array(bands[some].view(np.int64).reshape(-1)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_key"), pa.array(bag.view(np.int64)), pa.array(size), lists], names=["doc_id", "text_key", "bag", "n", "bands"])
    give_back()


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", most=1 << 18):
            pieces = bit_pieces(signatures(*bags(part.column("text")), part.num_rows, LONGER))
            yield pa.RecordBatch.from_arrays([part.column("bag"), pa.array([x.tobytes() for x in pieces], pa.binary())], names=["bag", "pieces"])
    give_back()


def _picks(depth: int) -> np.ndarray:
    """(bands, draws, depth) pieces that a bucket is split by. Each band has its own, else a pair that no draw joins would be lost in all bands."""
    every, rng = np.tile(np.arange(PIECES, dtype=np.int16), (DRAWS[depth], 1)), np.random.default_rng(depth)
    return np.stack([rng.permuted(every, axis=1)[:, :depth] for _ in range(BANDS)])


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of open buckets to the spots in which they are compared: a large bucket falls apart by deeper bands."""
    picks: dict[int, np.ndarray] = {}
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            bucket = part.column("bucket").to_numpy().view(np.uint64)
            depth, band = (part.column(c).to_numpy() for c in ("depth", "band"))
            pieces = np.stack([np.frombuffer(x, "<u2") for x in part.column("pieces").to_pylist()]) if part.num_rows else np.empty((0, PIECES), np.uint16)
            for d in np.unique(depth):
                mine = np.flatnonzero(depth == d)
                some = part.take(pa.array(mine)).drop_columns(["bucket", "depth"])
                if d not in picks:
                    picks[d] = _picks(int(d))
                for draw in range(DRAWS[d]):
                    key = bucket[mine]
                    with np.errstate(over="ignore"):
                        for i in range(d):
                            key = mix(key * SPREAD + pieces[mine, picks[d][band[mine], draw, i]] + np.uint64(draw << 16))
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.full(len(mine), draw, np.int32)), *some.columns], names=["spot", "draw", *some.schema.names])


def _meet(similar: float):
    """Rows of spots in order to pairs of bags of different classes that can reach the limit, each in the first spot that both are in."""
    enough = least_agreeing(similar)
    picks: dict[int, np.ndarray] = {}

    def pairs(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        bag, label, n = (rows.column(c).to_numpy() for c in ("bag", "label", "n"))
        if (label == label[0]).all():
            return np.empty(0, np.int64), np.empty(0, np.int64)
        pieces = np.stack([np.frombuffer(x, "<u2") for x in rows.column("pieces").to_pylist()])
        keys = np.stack([np.frombuffer(x, "<u4") for x in rows.column("keys").to_pylist()])
        band, draw = rows.column("band")[0].as_py(), rows.column("draw")[0].as_py()
        depths = np.stack([rows.column(c).to_numpy() for c in ("depths0", "depths1")], axis=1)[:, :, None] >> (3 * np.arange(16)) & 7
        depths = depths.reshape(len(bag), BANDS)
        a, b = [], []
        for i in range(1, len(bag)):
            j = np.flatnonzero((label[:i] != label[i]) & (np.minimum(n[:i], n[i]) / np.maximum(n[:i], n[i]) >= similar))
            j = j[agreeing(pieces[i], pieces[j]) >= enough]
            if len(j):
                # Both are in a band's bucket if their keys agree; if it is split, in the first draw in which their pieces agree.
                met, same, first = keys[j] == keys[i], pieces[j] == pieces[i], 0
                for at in range(band + 1):
                    d = int(depths[i, at])
                    if d and met[:, at].any():
                        if d not in picks:
                            picks[d] = _picks(d)
                        drawn = same[:, picks[d][at]].all(axis=2)
                        first = drawn.argmax(axis=1)
                        met[:, at] &= drawn.any(axis=1)
                # After the loop, first is that of this band: its pairs are here, so it was met.
                here = met.argmax(axis=1) == band
                if depths[i, band]:
                    here &= first == draw
                j = j[here]
                a.append(np.full(len(j), bag[i]))
                b.append(bag[j])
        return (np.concatenate(a), np.concatenate(b)) if a else (np.empty(0, np.int64), np.empty(0, np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.RecordBatch | None = None  # rows of the bucket that the next batch may go on with
        for batch in batches:
            held = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0] if rest is not None and rest.num_rows else batch
            if not held.num_rows:
                continue
            spot = held.column("spot").to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(spot)) + 1])
            yield from emit(held, cuts)
            rest = held.slice(int(cuts[-1]))
        if rest is not None and rest.num_rows:
            yield from emit(rest, np.array([0, rest.num_rows]))

    def emit(rows: pa.RecordBatch, cuts: np.ndarray) -> Iterator[pa.RecordBatch]:
        found = [pairs(rows.slice(int(x), int(y - x))) for x, y in zip(cuts, cuts[1:], strict=False) if y - x > 1]
        if found:
            a, b = (np.concatenate(x) for x in zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b), pa.int64()), pa.array(np.maximum(a, b), pa.int64())], names=["a", "b"])

    return run


def _compare(similar: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "x", "y", most=1 << 21):
                a, b = part.column("a").to_numpy(), part.column("b").to_numpy()
                ids, first = np.unique(np.concatenate([a, b]), return_index=True)
                texts = pa.chunked_array([part.column("x"), part.column("y")]).take(pa.array(first)).combine_chunks()
                doc, keys, times = bags(texts)
                order = np.lexsort((keys, doc))
                doc, keys, times = doc[order], keys[order], times[order]
                cut = np.searchsorted(doc, np.arange(len(ids) + 1))
                held = [(keys[cut[i] : cut[i + 1]], times[cut[i] : cut[i + 1]]) for i in range(len(ids))]
                i, j = np.searchsorted(ids, a), np.searchsorted(ids, b)
                good = np.array([overlap(held[p], held[q]) >= similar for p, q in zip(i, j, strict=True)], dtype=bool)
                yield pa.RecordBatch.from_arrays([pa.array(a[good]), pa.array(b[good])], names=["a", "b"])
        give_back()

    return run


def _classes(links: DataFrame) -> DataFrame:
    """bag, label: the smallest bag that links lead to, for all bags with links. Labels halve their way by jumps."""
    both = cut_lineage(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut_lineage(both.groupBy(F.col("a").alias("bag")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        seen = both.join(labels.select(F.col("bag").alias("b"), "label"), "b").groupBy(F.col("a").alias("bag")).agg(F.min("label").alias("near"))
        low = labels.join(seen, "bag").select("bag", "label", F.least("label", "near").alias("new"))
        jump = low.join(labels.select(F.col("bag").alias("new"), F.col("label").alias("far")), "new", "left")
        new = cut_lineage(jump.select("bag", "label", F.least("new", F.coalesce("far", "new")).alias("new")))
        changed = new.where("new != label").limit(1).count()
        labels = new.select("bag", F.col("new").alias("label"))
        if not changed:
            return labels


def _verified(pairs: DataFrame, source: DataFrame, similar: float) -> DataFrame:
    """The pairs (a, b) whose bags are as similar as asked."""
    # Sorted and merged at every size: the texts are far larger than the pairs, which may be many.
    text = lambda end, name: source.select(F.col("bag").alias(end), F.col("text").alias(name)).hint("merge")
    whole = pairs.join(text("a", "x"), "a").join(text("b", "y"), "b")
    return cut_lineage(whole.select("a", "b", "x", "y").mapInArrow(_compare(similar), "a long, b long"))


def _linked(signed: DataFrame, keyed: DataFrame, one: DataFrame, similar: float) -> DataFrame:
    """bag, label of all bags that belong to a class of several bags. one: for each bag a row of keyed (id, text_key) that has it."""
    sizes = cut_lineage(signed.where("n > 0").groupBy("bag").agg(F.first("n").alias("n"), F.first("bands").alias("bands")))
    bucket = sizes.select("bag", "n", F.posexplode("bands").alias("band", "bucket"))
    full = bucket.groupBy("bucket").agg(F.min("bag").alias("p"), F.max("bag").alias("q"), F.count("*").alias("members")).where("p != q").select("bucket", "members")
    rows = cut_lineage(bucket.join(full, "bucket"))
    needed = one.join(rows.select("bag").distinct(), "bag", "left_semi")
    source = cut_lineage(keyed.join(needed.hint("merge"), ["id", "text_key"]).select("bag", "text").dropDuplicates(["bag"]))
    # A bag that meets many others is likely the one that the copies of a group were made from: a hub.
    centre = rows.groupBy("bag").agg(F.sum("members").alias("meets"))
    hubs = rows.join(centre, "bag").groupBy("bucket").agg(F.max(F.struct("meets", "bag", "n")).alias("hub")).select("bucket", F.col("hub.bag").alias("hub"), F.col("hub.n").alias("hub_n"))
    met = rows.join(hubs, "bucket").where((F.col("bag") != F.col("hub")) & (F.least("n", "hub_n") / F.greatest("n", "hub_n") >= similar))
    pairs = met.select(F.least("bag", "hub").alias("a"), F.greatest("bag", "hub").alias("b")).distinct()
    labels = _classes(_verified(pairs, source, similar))
    # Buckets of several classes stay open.
    labelled = rows.join(labels, "bag", "left").withColumn("label", F.coalesce("label", "bag"))
    mixed = labelled.groupBy("bucket").agg(F.min("label").alias("p"), F.max("label").alias("q")).where("p != q").select("bucket")
    depth = F.least(F.greatest(F.ceil(F.log(F.col("members") / MOST) / F.log(F.lit(float(FALL)))), F.lit(0)), F.lit(len(DRAWS) - 1)).cast("int")
    still = cut_lineage(labelled.join(mixed, "bucket", "left_semi").select("bucket", "band", "bag", "n", "label", depth.alias("depth")))
    if not still.limit(1).count():
        return labels
    # Three bits a band: how deep its bucket is split.
    place = F.expr("shiftleft(CAST(depth AS BIGINT), 3 * (band % 16))")
    deep = still.groupBy("bag").agg(*[F.bit_or(F.when(F.floor(F.col("band") / 16) == half, place).otherwise(0)).alias(f"depths{half}") for half in (0, 1)])
    sketched = source.join(deep, "bag").select("bag", "text").mapInArrow(_sketch, "bag long, pieces binary")
    keys = sizes.join(deep, "bag").select("bag", "depths0", "depths1", F.to_binary(F.array_join(F.transform("bands", lambda x: F.lpad(F.hex(x.bitwiseAND(0xFFFFFFFF)), 8, "0")), ""), F.lit("hex")).alias("keys"))
    known = cut_lineage(sketched.join(keys, "bag"))
    split = still.join(known, "bag").mapInArrow(_split, "spot long, draw int, bag long, band int, n long, label long, pieces binary, depths0 long, depths1 long, keys binary")
    near = split.repartition("spot").sortWithinPartitions("spot").mapInArrow(_meet(similar), "a long, b long")
    more = _verified(cut_lineage(near), source, similar)
    # Links between classes join them; their graph is that of the labels.
    end = lambda c: labels.select(F.col("bag").alias(c), F.col("label").alias(f"{c}_label"))
    ends = more.join(end("a"), "a", "left").join(end("b"), "b", "left")
    joined = _classes(ends.select(F.coalesce("a_label", "a").alias("a"), F.coalesce("b_label", "b").alias("b")))
    known_bags = labels.unionByName(joined.select("bag", F.col("bag").alias("label"))).dropDuplicates(["bag"])
    return cut_lineage(known_bags.join(joined.select(F.col("bag").alias("label"), F.col("label").alias("least")), "label", "left").select("bag", F.coalesce("least", "label").alias("label")))


def near_duplicates(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """doc_id, class_id, class_size, first (boolean) for every row of docs.

    docs: doc_id, text; other columns are not read. Texts whose bags have weighted Jaccard similarity `similar` or
    more are linked; a class is what links join. class_id: its smallest doc_id (null if it has none); first: the row has
    that doc_id. A null text, or one without words, is in a class of its own, of size 1. Rows with a null doc_id take part; repeated rows are
    copies of each other. An empty table gives no rows. Bags are known by 64-bit hashes. A pair of exactly the limit's similarity
    is missed with a chance of 1e-7 (bands and bits, 5e-8 each), in buckets of over MOST bags of several classes with one of 2e-7; one more alike, with less.
    """
    classes = _class_of(docs, similar)[0]
    alone = F.col("n") == 0
    return classes.select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.when(alone, F.lit(1)).otherwise(F.col("class_size")).cast("long").alias("class_size"), F.coalesce(alone | (F.col("doc_id") == F.col("class_id")), F.lit(False)).alias("first"))


def _class_of(docs: DataFrame, similar: float) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, text_key, bag, n, class_id, class_size), and for each class the row that stays (doc_id, text_key)."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))
    signed = cut_lineage(keyed.mapInArrow(_sign, SIGN_DDL))
    pick = signed.where("n > 0").groupBy("bag").agg(F.min(F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("id"), "text_key")).alias("row"), F.count("*").alias("rows"))
    pick = cut_lineage(pick.select("bag", "row.id", "row.text_key", "rows"))
    one = pick.select("bag", "id", "text_key")
    labels = _linked(signed, keyed.withColumn("id", F.coalesce("doc_id", F.lit((1 << 63) - 1))), one, similar)
    named = pick.join(labels, "bag", "left").withColumn("label", F.coalesce("label", "bag"))
    groups = named.groupBy("label").agg(F.min(F.struct("id", "text_key")).alias("keeper"), F.sum("rows").alias("class_size"))
    known = cut_lineage(named.select("bag", "label").join(groups, "label").select("bag", F.nullif(F.col("keeper.id"), F.lit((1 << 63) - 1)).alias("class_id"), "class_size", F.col("keeper.text_key").alias("keeper_key")))
    rows = signed.select("doc_id", "text_key", "bag", "n").join(known, "bag", "left")
    keepers = known.groupBy("class_id", "keeper_key").count().drop("count")
    return rows, keepers


def keep_one(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """docs with one row of each class, that of the smallest doc_id; rows without words all stay. Columns as they are, whatever their names.

    Null doc_ids come last; of rows equal in doc_id and text one stays. An empty table gives no rows.
    """
    keepers = _class_of(docs, similar)[1].select(F.coalesce("class_id", F.lit((1 << 63) - 1)).alias("id"), "keeper_key")
    wordless = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]")), F.lit(0)) == 0
    own = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("id"), F.xxhash64("text").alias("keeper_key"), wordless.alias("wordless"), F.struct("*").alias("row"))
    kept = own.where(~F.col("wordless")).join(keepers, ["id", "keeper_key"]).dropDuplicates(["id", "keeper_key"])
    return kept.select("row.*").unionByName(own.where("wordless").select("row.*"))
