"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source's documents lie in blocks of about `block_words`. A source's target, in words, is drawn as whole passes over
its blocks and a last, partial pass of permuted blocks up to the target. The tree deals the drawn blocks to the output
shards: a node holds exact block quotas of every source; it gives its left half an urn draw without
replacement (all its blocks get random keys, the smallest go left), so the sources' quotas there follow the multivariate hypergeometric law and all
sums stay exact. A shard then takes the next blocks of each source's permutation, disjoint from those of all others, and orders documents by a hash.

Only DataFrame functions. Random choices are hashes of the seed and of what is chosen, so reruns agree. Blocks are ranked by `scan.rank_rows`, so a
source or a node of any size is dealt in many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut_lineage
from tidemark.operators.scan import rank_rows

WEIGHTS = (5, 2, 1)  # by rank of the source, repeating
MOST = 3  # times a source's words at most
BLOCK_WORDS = 1 << 18
SHARD_WORDS = 1 << 22
SOURCE = ["_null", "_name"]


def word_count(text: Column | str) -> Column:
    """Words between ASCII spaces; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """sizes: _null, _name, source_size; adds target, in words.

    Sources by code point, null last, weigh `weights` in turn. All targets sum to all sizes; a target stops at `most` times
    its source's size and the rest is shared by weight. With sources by size per weight, those that stop come first, so two
    running sums find them.
    """
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy("_null", "_name")) - 1)  # one row a source
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")))
    order = Window.orderBy(F.col("source_size") / F.col("weight"), "rank")
    before, every = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    held = lambda x: F.coalesce(F.sum(x).over(before), F.lit(0))
    total, weight = F.sum("source_size").over(every), F.sum("weight").over(every)
    level = (total - most * held("source_size")) / (weight - held("weight"))
    full = ranked.withColumn("full", F.col("source_size") * most <= level * F.col("weight"))
    spare = (total - most * F.coalesce(F.sum(F.when(F.col("full"), F.col("source_size"))).over(every), F.lit(0))) / F.nullif(weight - F.coalesce(F.sum(F.when(F.col("full"), F.col("weight"))).over(every), F.lit(0)), F.lit(0))
    target = F.when(F.col("full"), (F.col("source_size") * most).cast("double")).otherwise(spare * F.col("weight"))
    return full.withColumn("target", target).select(*SOURCE, "rank", "source_size", "target")


def _hex(*parts: Column) -> Column:
    """A hash that any engine can repeat."""
    return F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def _number(digest: Column, digits: int = 13) -> Column:
    """The first hexadecimal digits as a whole number (13: exact as a double)."""
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("long")


def split_quotas(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """quotas: source (int), blocks (long); returns shard, source, blocks, by the splitting tree.

    A node covers shards [low, high) and has a row for each source. Its left half gets blocks in proportion to its shards, as far as that divides.
    """
    nodes = quotas.where("blocks > 0").select(F.lit(0).alias("low"), F.lit(shards).alias("high"), F.col("source").cast("int").alias("source"), F.col("blocks").cast("long").alias("blocks"))
    columns = ["low", "high", "source", "blocks"]
    for level in range((shards - 1).bit_length()):
        open_ = nodes.where("high - low > 1").withColumn("half", F.expr("(low + high) div 2").cast("int"))
        total = open_.groupBy(F.col("low").alias("at")).agg(F.sum("blocks").alias("total"))
        open_ = open_.join(total, F.col("low") == F.col("at")).withColumn("left", F.expr("total * (half - low) div (high - low)"))
        balls = open_.select("low", "high", "half", "left", "source", F.explode(F.sequence(F.lit(1).cast("long"), "blocks")).alias("ball"))
        balls = balls.withColumn("key", _number(_hex(F.lit(seed), F.col("low"), F.lit(level), F.col("source"), F.col("ball"))))
        drawn = rank_rows(balls, ["low"], F.col("key"), ["source", "ball"], "place")
        mine = F.col("place") <= F.col("left")
        halves = drawn.groupBy(F.when(mine, F.col("low")).otherwise(F.col("half")).alias("from"), F.when(mine, F.col("half")).otherwise(F.col("high")).alias("to"), "source").agg(F.count(F.lit(1)).alias("blocks"))
        nodes = cut_lineage(halves.toDF(*columns).unionByName(nodes.where("high - low = 1").select(*columns)))
    return nodes.select(F.col("low").alias("shard"), "source", "blocks")


def mixed(docs: DataFrame, size: Column | None = None, tie: Column | None = None, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, seed: int = 1) -> DataFrame:
    """docs with size, source_size, target and draws: array of (pass, shard, seat), one for each time a document is taken.

    docs: doc_id, source, and text unless size and tie are given; other columns stay, whatever their names (those of the new names are replaced). size: words
    of a row; tie: what tells rows of one doc_id apart (default: hash of the text). A null source is a
    source of its own, the last. Null and empty texts have size 0: they follow their block's draws and take no words; a block counts them
    as one word each, so they spread over blocks too. A source is drawn to within half a document of its target. Rows equal in doc_id and tie lie in
    one block and are taken one by one. An empty table, or one without words, gives rows with target 0 and no draws.
    """
    own = ["size", "source_size", "target", "draws"]
    source = [F.col("source").isNull().alias("_null"), F.coalesce("source", F.lit("")).alias("_name")]
    words = word_count("text") if size is None else size.cast("long")
    spot = _hex(F.lit(seed), F.col("doc_id"), F.md5(F.coalesce("text", F.lit(""))) if tie is None else tie)
    # The row travels as one column: no name of it can clash with those of the plan.
    base = docs.select(F.struct(*docs.columns).alias("_row"), *source, words.alias("_size"), spot.alias("_spot"))
    sizes = base.groupBy(*SOURCE).agg(F.sum("_size").alias("source_size"), F.sum(F.greatest("_size", F.lit(1))).alias("units"))
    sources = cut_lineage(source_targets(sizes.drop("units"), weights, most).join(sizes.select(*SOURCE, "units"), SOURCE))
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    shards = max(1, -(-total // shard_words))
    passes = F.when(F.col("source_size") > 0, F.least(F.lit(most), F.floor(F.col("target") / F.col("source_size")))).otherwise(0).cast("int")
    plan = sources.withColumns({"passes": passes, "n_blocks": F.greatest(F.lit(1), F.ceil(F.col("units") / block_words)).cast("int")}).drop("units")
    plan = plan.withColumn("rest", F.when(F.col("passes") < most, F.greatest(F.lit(0.0), F.col("target") - F.col("passes") * F.col("source_size"))).otherwise(0.0))
    known = base.join(plan, SOURCE).withColumn("_block", F.pmod(_number(F.col("_spot"), 8), F.col("n_blocks")).cast("int"))
    blocks = cut_lineage(known.groupBy(*SOURCE, "_block").agg(F.sum("_size").alias("words"), *[F.first(c).alias(c) for c in ("rank", "passes", "rest")]))
    # Passes 0 to passes - 1 take every block, the pass after them blocks in a random order up to the rest.
    turns = blocks.withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("passes"))))
    turns = turns.withColumn("key", _number(_hex(F.lit(seed), F.col("pass"), F.col("_name"), F.col("_null").cast("int"), F.col("_block"))))
    turns = rank_rows(turns, [*SOURCE, "pass"], F.col("key"), ["_block"], "place", also_sum="words")
    turns = turns.withColumn("cut", F.when(F.col("pass") == F.col("passes"), F.col("rest") - (F.col("running_words") - F.col("words"))))
    every = blocks.groupBy(*SOURCE).agg(F.count(F.lit(1)).alias("held"))
    turns = turns.where("cut IS NULL OR cut > 0").join(every, SOURCE).withColumn("turn", (F.col("pass") * F.col("held") + F.col("place")).cast("long"))
    turns = cut_lineage(turns.select(*SOURCE, "_block", "rank", "pass", "cut", "turn"))
    dealt = split_quotas(turns.groupBy(F.col("rank").alias("source")).agg(F.count("*").alias("blocks")), shards, seed)
    before = F.coalesce(F.sum("blocks").over(Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a shard
    seats = dealt.withColumn("before", before).select(F.col("source").alias("rank"), "shard", F.explode(F.sequence(F.col("before") + 1, F.col("before") + F.col("blocks"))).alias("turn"))
    draws = turns.join(seats, ["rank", "turn"]).groupBy(*SOURCE, "_block").agg(F.sort_array(F.collect_list(F.struct("pass", "shard", "cut"))).alias("_draws"))  # passes + 1 at most
    within = Window.partitionBy(*SOURCE, "_block").orderBy("_spot").rowsBetween(Window.unboundedPreceding, 0)
    placed = known.withColumn("_middle", F.sum("_size").over(within) - F.col("_size") / 2).join(draws, [*SOURCE, "_block"], "left")
    mine = F.filter(F.coalesce("_draws", F.array().cast("array<struct<pass:int,shard:int,cut:double>>")), lambda d: d["cut"].isNull() | (F.col("_middle") <= d["cut"]))
    taken = F.transform(mine, lambda d: F.struct(d["pass"].alias("pass"), d["shard"].alias("shard"), _number(_hex(F.lit(seed), F.col("_spot"), d["pass"]), 15).alias("seat")))
    kept = [F.col("_row").getField(c).alias(c) for c in docs.columns if c not in own]
    return placed.select(*kept, F.col("_size").alias("size"), "source_size", F.coalesce("target", F.lit(0.0)).alias("target"), taken.alias("draws"))


def mix_rows(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: docs' columns, a row for each time a document is taken. A shard's rows stand together, in the order of their seats.

    Options as in mixed(); columns of any name stay as they are. An empty table gives no rows.
    """
    whole = docs.select("doc_id", "source", "text", F.struct(*docs.columns).alias("row"))
    rows = mixed(whole, **options).select("row", F.inline("draws"))
    return rows.repartition("shard").sortWithinPartitions("shard", "seat", "pass").select("row.*")
