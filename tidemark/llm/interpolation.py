"""Deleted interpolation: n-gram likelihoods mixed by weights that held-out counts decide.

P_k(w|h) = l_k(b) c_k(h w) / c_k(h) + (1 - l_k(b)) P_{k-1}, with P_0 = 1 / (V + 1). b is the bucket (a power of two)
of the context's frequency c_k(h). The weights l_k(b) maximise the likelihood of one part of the training texts
under the counts of the rest (expectation-maximisation); the counts of the whole training part then score all texts.

How it runs. Each text belongs to one role: fit, dev (for the weights), or rest (scored only). Tasks cut
their texts into blocks of bounded size and write them as word numbers with a list of word keys. A block asks
for the counts of its distinct n-grams, one row of sorted keys for each (block, bucket of keys); a bucket adds up what
all blocks hold and answers each in the order it asked. A frequent n-gram costs one key a block, however many
times it stands there, so no key is hot, and no task holds more than a block or a bucket.

Words and n-grams are known by 64-bit hashes: among n distinct ones some n^2 / 2^65 pairs are counted as one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import array_of, binary_of, cut_lineage, give_back, mix, ship, slices, split_words, word_keys

ship(__name__)

FIT, DEV, REST = 0, 1, 2
START = np.uint64(0x51A27D0C3B9F6E11)  # stands before the first token
END = np.uint64(0xE4D08B5517C2A963)  # the token after the last word
KEYS_A_BUCKET = 1_500_000  # n-grams that a counting task holds, about
MOST_BUCKET = 40  # context frequencies over 2**40 share one weight


# --- blocks ---------------------------------------------------------------------------------------------------


def _block_schema() -> pa.Schema:
    return pa.schema(
        [("block", pa.string()), ("role", pa.int32()), ("n", pa.int64()), ("ids", pa.binary()), ("null_ids", pa.binary()), ("sizes", pa.binary()), ("words", pa.binary()), ("vocab", pa.binary())]
    )


BLOCK_DDL = "block string, role int, n long, ids binary, null_ids binary, sizes binary, words binary, vocab binary"


def _blocks(most_tokens: int):
    """Texts to blocks: document ids, sizes with the end token, and tokens as numbers of sorted word keys."""

    def emit(name: str, role: int, held: list) -> pa.RecordBatch:
        ids, nulls, sizes, keys = (np.concatenate(x) for x in zip(*held, strict=True))
        vocab, words = np.unique(keys, return_inverse=True)
        row = [name, role, len(keys), binary_of(ids), binary_of(nulls), binary_of(sizes), binary_of(words.astype(np.int32)), binary_of(np.diff(vocab, prepend=np.uint64(0)))]
        return pa.RecordBatch.from_arrays([pa.array([v], type=t.type) for v, t in zip(row, _block_schema(), strict=True)], schema=_block_schema())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), 0
        held: dict[int, list] = {FIT: [], DEV: [], REST: []}
        tokens = dict.fromkeys(held, 0)
        for batch in batches:
            for piece in slices(batch, "text"):
                counts, words = split_words(piece.column("text"), lower=True)
                keys = word_keys(words)
                sizes = counts + 1
                ends = np.cumsum(sizes)
                stream = np.empty(int(sizes.sum()), dtype=np.uint64)
                last = np.zeros(len(stream), dtype=bool)
                last[ends - 1] = True
                stream[last], stream[~last] = END, keys
                ids = piece.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                nulls = piece.column("doc_id").is_null().to_numpy(zero_copy_only=False).astype(np.int8)
                roles = piece.column("role").to_numpy(zero_copy_only=False)
                for role in np.unique(roles):
                    mine = roles == role
                    held[role].append((ids[mine], nulls[mine], sizes[mine], stream[np.repeat(mine, sizes)]))
                    tokens[role] += int(sizes[mine].sum())
                    if tokens[role] >= most_tokens:
                        yield emit(f"{part}-{made}", int(role), held[role])
                        made, held[role], tokens[role] = made + 1, [], 0
        for role, parts in held.items():
            if parts:
                yield emit(f"{part}-{made}", role, parts)
                made += 1

    return run


def _freed(table: pa.Table) -> pa.Table:
    """A group's result, once what its work has freed is given back: workers stay, and two share an executor."""
    give_back()
    return table


class _Block:
    """A block in memory: the keys of its n-grams at every token, by order."""

    def __init__(self, row: dict, order: int):
        self.name, self.role = row["block"], row["role"]
        self.ids, self.nulls = array_of(row["ids"], "<i8"), array_of(row["null_ids"], "i1")
        self.sizes = array_of(row["sizes"], "<i8")
        with np.errstate(over="ignore"):
            vocab = np.cumsum(array_of(row["vocab"], "<u8"), dtype=np.uint64)
        self.first = np.zeros(row["n"], dtype=bool)
        self.first[np.cumsum(self.sizes) - self.sizes] = True
        self.grams = [vocab[array_of(row["words"], "<i4")]]
        for k in range(1, order):
            before = np.empty_like(self.grams[-1])
            before[1:] = self.grams[-1][:-1]
            before[self.first] = mix(np.array([START + np.uint64(k)], dtype=np.uint64))[0]
            with np.errstate(over="ignore"):
                self.grams.append(mix(before * np.uint64(0x9E3779B97F4A7C15) + self.grams[0] + np.uint64(k)))


def _bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Ascending in the key, so a block's sorted keys fall apart into runs."""
    return ((keys >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)


def _asks(order: int, buckets: int):
    """Block to rows (block, role, k, bucket, keys, counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block = _Block(batch.slice(i, 1).to_pylist()[0], order)
                for k in range(order):
                    keys, counts = np.unique(block.grams[k], return_counts=True)
                    cut = np.searchsorted(_bucket_of(keys, buckets), np.arange(buckets + 1))
                    some = np.flatnonzero(np.diff(cut))
                    rows = [(keys[cut[b] : cut[b + 1]], counts[cut[b] : cut[b + 1]]) for b in some]
                    yield pa.RecordBatch.from_pydict(
                        {
                            "block": pa.array([block.name] * len(some)),
                            "role": pa.array([block.role] * len(some), pa.int32()),
                            "k": pa.array([k] * len(some), pa.int32()),
                            "bucket": pa.array(some, pa.int32()),
                            "keys": pa.array([binary_of(np.diff(x, prepend=np.uint64(0))) for x, _ in rows], pa.binary()),
                            "counts": pa.array([binary_of(c.astype(np.int64)) for _, c in rows], pa.binary()),
                        }
                    )

    return run


ASK_DDL = "block string, role int, k int, bucket int, keys binary, counts binary"
REPLY_DDL = "block string, role int, k int, bucket int, fit binary, all binary, tokens long, distinct long, fit_tokens long, fit_distinct long"


def _answer(asked: pa.Table) -> pa.Table:
    """One (k, bucket): the counts of every key over all blocks, to each block in the order of its keys.

    The first row also carries the bucket's sums for N and V.
    """
    asked_by = asked.column("role").to_pylist()
    with np.errstate(over="ignore"):
        keys = [np.cumsum(array_of(a.as_py(), "<u8"), dtype=np.uint64) for a in asked.column("keys")]
    sizes = np.array([len(x) for x in keys])
    uniq, at = np.unique(np.concatenate(keys), return_inverse=True)
    del keys
    at, distinct = at.astype(np.int32), len(uniq)
    del uniq
    ends = np.cumsum(sizes)
    to = [at[e - n : e] for e, n in zip(ends, sizes, strict=True)]
    fit, dev = np.zeros(distinct, dtype=np.int64), np.zeros(distinct, dtype=np.int64)
    for role, x, a in zip(asked_by, to, asked.column("counts"), strict=True):
        if role != REST:  # a block asks for a key once
            (fit if role == FIT else dev)[x] += array_of(a.as_py(), "<i8")
    both = fit + dev
    sums = [both.sum(), (both > 0).sum(), fit.sum(), (fit > 0).sum()]
    columns = {c: asked.column(c) for c in ("block", "role", "k", "bucket")}
    columns["fit"] = pa.array([binary_of(fit[x]) if role == DEV else None for role, x in zip(asked_by, to, strict=True)], pa.binary())
    columns["all"] = pa.array([binary_of(both[x]) for x in to], pa.binary())
    for name, total in zip(("tokens", "distinct", "fit_tokens", "fit_distinct"), sums, strict=True):
        columns[name] = pa.array([int(total)] + [0] * (len(to) - 1), pa.int64())
    return _freed(pa.table(columns))


def _counted(block: _Block, replies: list[dict], order: int, what: str) -> list[np.ndarray]:
    """Counts at every token, by order."""
    out = []
    for k in range(order):
        mine = sorted((r for r in replies if r["k"] == k), key=lambda r: r["bucket"])
        counts = np.concatenate([array_of(r[what], "<i8") for r in mine])
        out.append(counts[np.unique(block.grams[k], return_inverse=True)[1]])
    return out


def _levels(block: _Block, counts: list[np.ndarray], n: int, docs: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(n-gram count, context count) at every token, by order. Before the first token stands the start."""
    out = [(counts[0], np.full(len(counts[0]), n))]
    for k in range(1, len(counts)):
        context = np.empty_like(counts[k])
        context[1:] = counts[k - 1][:-1]
        context[block.first] = docs
        out.append((counts[k], context))
    return out


def _bucket(context: np.ndarray) -> np.ndarray:
    """0 for a context never seen, else 1 + floor(log2(frequency))."""
    return np.minimum(np.frexp(context.astype(np.float64))[1], MOST_BUCKET)


def _distinct(columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of some integer columns, and how often each stands there; columns are folded into one key, never held as a matrix."""
    key = np.zeros(len(columns[0]), dtype=np.int64)
    for x in columns:
        values, code = np.unique(x, return_inverse=True)
        _, key = np.unique(key * len(values) + code, return_inverse=True)  # both codes are below the number of rows
    _, first, times = np.unique(key, return_index=True, return_counts=True)
    return [x[first] for x in columns], times


def _dev_counts(order: int, n: int, docs: int):
    """Dev blocks to the distinct (count, context) chains and how many tokens have each."""

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        names = [f"{x}{k}" for k in range(order) for x in ("c", "h")]
        parts = []
        replies = right.to_pylist()
        for row in left.to_pylist():
            block = _Block(row, order)
            levels = _levels(block, _counted(block, replies, order, "fit"), n, docs)
            chains, times = _distinct([x for level in levels for x in level])
            del block, levels
            parts.append(pa.table({**{c: x.astype(np.int64) for c, x in zip(names, chains, strict=True)}, "times": times.astype(np.int64)}))
        return _freed(pa.concat_tables(parts) if parts else pa.table({c: pa.array([], pa.int64()) for c in [*names, "times"]}))

    return run


def _score(order: int, n: int, v: int, docs: int, weights: np.ndarray):
    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        parts, replies = [], right.to_pylist()
        for row in left.to_pylist():
            block = _Block(row, order)
            counts = _counted(block, replies, order, "all")
            p = np.full(row["n"], 1.0 / (v + 1))
            for k, (c, h) in enumerate(_levels(block, counts, n, docs)):
                share = weights[k, _bucket(h)]
                p = share * (c / np.maximum(h, 1)) + (1 - share) * p
            starts = np.cumsum(block.sizes) - block.sizes
            total = lambda x: np.add.reduceat(x, starts)  # noqa: B023, E731
            parts.append(
                pa.table(
                    {
                        "doc_id": pa.array(block.ids, pa.int64(), mask=block.nulls.astype(bool)),
                        "held_out": pa.array(np.full(len(starts), row["role"] == REST)),
                        "n_tokens": pa.array(block.sizes, pa.int64()),
                        "n_known": pa.array(total((counts[0] > 0).astype(np.int64)), pa.int64()),
                        "train_tokens": pa.array(np.full(len(starts), n), pa.int64()),
                        "base_score": pa.array(total(np.log10((counts[0] + 1.0) / (n + v + 1.0)))),
                        "score": pa.array(total(np.log10(p))),
                    }
                )
            )
        return _freed(pa.concat_tables(parts) if parts else _EMPTY.empty_table())

    return run


_EMPTY = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
SCORE_DDL = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


# --- weights --------------------------------------------------------------------------------------------------


def _expectation(order: int, v: int, weights: np.ndarray) -> tuple[list[Column], list[Column]]:
    """For each order: the share of the tokens that level k made, and that levels up to k made."""
    p = F.lit(1.0 / (v + 1))
    own, below = [], []
    for k in range(order):
        share = F.element_at(F.array(*[F.lit(float(x)) for x in weights[k]]), F.col(f"b{k}") + 1)
        made = share * F.col(f"c{k}") / F.greatest(F.col(f"h{k}"), F.lit(1))
        own.append((p, share, made))
        p = made + (1 - share) * p
    reach = F.lit(1.0)  # the posterior chance that no higher order made the token
    post: list[Column] = []
    for k in reversed(range(order)):
        lower, share, made = own[k]
        mine = made / (made + (1 - share) * lower)
        post.append(reach * mine)
        below.append(reach)
        reach = reach * (1 - mine)
    return post[::-1], below[::-1]


def learn_weights(chains: DataFrame, order: int, v: int, rounds: int = 20) -> np.ndarray:
    """weights[k, bucket]; chains holds (c, h) of every order and the number of tokens with them.

    A bucket without held-out tokens takes the weight of the nearest lower bucket that has some (or 1/2).
    """
    seen = chains
    for k in range(order):
        h = F.col(f"h{k}")
        seen = seen.withColumn(f"b{k}", F.when(h > 0, F.least(F.floor(F.log2(h.cast("double"))).cast("int") + 1, F.lit(MOST_BUCKET))).otherwise(0))
    weights = np.full((order, MOST_BUCKET + 1), 0.5)
    weights[:, 0] = 0.0
    for _ in range(rounds):
        post, below = _expectation(order, v, weights)
        pairs = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"b{k}").alias("b"), (post[k] * F.col("times")).alias("mine"), (below[k] * F.col("times")).alias("reach")) for k in range(order)])
        sums = seen.select(F.inline(pairs)).groupBy("k", "b").agg(F.sum("mine").alias("mine"), F.sum("reach").alias("reach")).collect()  # orders x 41 rows at most
        new = np.full_like(weights, np.nan)
        for r in sums:
            if r["reach"] and r["reach"] > 0:
                new[r["k"], r["b"]] = min(max(r["mine"] / r["reach"], 1e-9), 1 - 1e-9)
        new[:, 0] = 0.0
        for k in range(order):
            for b in range(1, MOST_BUCKET + 1):
                if np.isnan(new[k, b]):
                    new[k, b] = new[k, b - 1] if b > 1 else 0.5
        done = np.abs(new - weights).max() < 1e-4
        weights = new
        if done:
            break
    return weights


# --- operator -------------------------------------------------------------------------------------------------


def interpolated_scores(docs: DataFrame, train: Column, dev: Column, order: int = 2, block_tokens: int = 350_000, rounds: int = 20) -> DataFrame:
    """log10 probability of every text under a model of order `order`.

    docs: doc_id, text; other columns are not read. train: texts to learn from; dev: those of them that decide the
    weights. Tokens are the words between ASCII spaces with A-Z lower-cased, then one end. Null text is empty (it
    has the end alone). Every row gives one row, also where doc_id is null or repeated; repeated rows count as often as they stand
    there. An empty table gives no rows. Without training texts every token has probability 1 / (V + 1) = 1.
    n_known counts tokens seen in training, base_score is the add-one unigram score.
    """
    role = F.when(F.coalesce(train, F.lit(False)), F.when(F.coalesce(dev, F.lit(False)), DEV).otherwise(FIT)).otherwise(REST)
    blocks = cut_lineage(docs.select("doc_id", "text", role.cast("int").alias("role")).mapInArrow(_blocks(block_tokens), BLOCK_DDL))
    facts = {r["role"]: r for r in blocks.groupBy("role").agg(F.sum("n").alias("n"), F.sum(F.length("sizes") / 8).cast("long").alias("docs")).collect()}
    tokens = sum(r["n"] for r in facts.values())
    buckets = max(48, -(-tokens * order // KEYS_A_BUCKET))
    asks = blocks.mapInArrow(_asks(order, buckets), ASK_DDL)
    replies = cut_lineage(asks.groupBy("k", "bucket").applyInArrow(lambda t: _answer(t), REPLY_DDL))
    n, v, fit_n, fit_v = (
        replies.where("k = 0").agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("tokens", "distinct", "fit_tokens", "fit_distinct")]).first()
    )
    docs_of = lambda *roles: sum(facts[r]["docs"] for r in roles if r in facts)
    weights = np.full((order, MOST_BUCKET + 1), 0.5)
    weights[:, 0] = 0.0
    if DEV in facts and FIT in facts:
        chain_ddl = ", ".join(f"c{k} long, h{k} long" for k in range(order)) + ", times long"
        dev_blocks, dev_replies = (x.where(F.col("role") == DEV).groupBy("block") for x in (blocks, replies))
        found = dev_blocks.cogroup(dev_replies).applyInArrow(_dev_counts(order, fit_n, docs_of(FIT)), chain_ddl)
        names = [f"{x}{k}" for k in range(order) for x in ("c", "h")]
        chains = cut_lineage(found.groupBy(*names).agg(F.sum("times").alias("times")))
        weights = learn_weights(chains, order, fit_v, rounds)
    scorer = _score(order, n, v, docs_of(FIT, DEV), weights)
    return blocks.groupBy("block").cogroup(replies.select("block", "k", "bucket", "all").groupBy("block")).applyInArrow(scorer, SCORE_DDL)
