"""One query for each operator, with production parameters over the whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.bagminhash import near_duplicates
from tidemark.llm.common import cut_lineage, table
from tidemark.llm.cover_tree import exact_top_k
from tidemark.llm.impact_ranking import ranked
from tidemark.llm.interpolation import interpolated_scores
from tidemark.llm.licenses import TIERS, license_scan
from tidemark.llm.lines import MIN_NEAR, line_dedup
from tidemark.llm.mixing import BLOCK_WORDS, SHARD_WORDS, mixed, word_count
from tidemark.llm.multiset_hash import document_fingerprints
from tidemark.llm.packing import packed
from tidemark.llm.projected_knn import nearest_projected
from tidemark.llm.quality import quality_scores
from tidemark.llm.spelling import spelling_groups
from tidemark.llm.token_files import read_token_files, write_token_files

WORD_BPE = "word_bpe_49k.json"


def fold(column: str, folds: int) -> Column:
    return F.crc32(F.col(column).cast("string")) % folds


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probability of every text; weights from remainder 3, held out: remainder 2."""
    part = fold("doc_id", 7)
    return interpolated_scores(table(spark, sf_dir, "documents"), train=F.coalesce(part != 2, F.lit(True)), dev=part == 3)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_token_files(write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE)))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_kept", "n_near", F.md5("text").alias("text_md5"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.coalesce(fold("doc_id", 4) == 2, F.lit(False))
    out = quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), learn=~held)
    return out.select("doc_id", held.alias("held_out"), "score", "predicted")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """score: confidence of the best tier found, 0 without a detection."""
    found = license_scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    start, joined = F.col("base.start"), lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    best = F.array_min(F.col("detections.tier"))
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(start).cast("long").alias("first_word"), F.array_max(start).cast("long").alias("last_word"),
        joined(F.col("base.label")).alias("base_labels"), joined(F.concat("base.label", "detections.label")).alias("labels"),
        F.when(F.size("detections") > 0, F.element_at(F.array(*map(F.lit, TIERS)), best + 1)).when(F.size("base") > 0, F.lit(TIERS[3])).otherwise(0.0).alias("score"),
    )


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_projected(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """draws: pass:shard:seat for each time the document is taken."""
    docs = table(spark, sf_dir, "documents")
    # Words are counted once; the mix is planned over the counts.
    light = cut_lineage(docs.select("doc_id", "source", word_count("text").alias("words"), F.md5(F.coalesce("text", F.lit(""))).alias("tie")))
    drawn = mixed(light, size=F.col("words"), tie=F.col("tie"))
    told = F.transform("draws", lambda d: F.concat_ws(":", d["pass"], d["shard"], d["seat"]))
    return drawn.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("draws")).cast("long").alias("taken"), F.array_join(told, ",").alias("draws"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(table(spark, sf_dir, "documents"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_fingerprints(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_deleted_interpolation": op1,
    "op2_token_files": op2,
    "op3_line_dedup": op3,
    "op4_quality_ranking": op4,
    "op5_license_scan": op5,
    "op6_projected_knn": op6,
    "op7_bagminhash": op7,
    "op8_source_mix": op8,
    "op9_best_fit_packing": op9,
    "op10_cover_tree": op10,
    "op11_impact_ranking": op11,
    "op12_spelling_variants": op12,
    "op13_multiset_hash": op13,
}

LINES_SQL = f"""
WITH each AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS content,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS line
  FROM documents
),
uniq AS (
  SELECT content, min(doc_id * 10000000 + line) AS spot, length(content) AS n FROM each WHERE trim(content, ' ') <> '' GROUP BY content
),
half AS (
  SELECT DISTINCT content, spot, n, side, h, CASE side WHEN 0 THEN left(content, h) ELSE right(content, h) END AS part
  FROM (SELECT *, unnest([n // 2, (n - 1) // 2]) AS h FROM uniq WHERE n >= {MIN_NEAR} - 1), (VALUES (0), (1)) s(side)
),
pair AS (
  SELECT DISTINCT a.content AS x, b.content AS y, a.n AS nx, b.n AS ny
  FROM half a JOIN half b USING (side, h, part) WHERE a.spot > b.spot AND abs(a.n - b.n) <= 1 AND greatest(a.n, b.n) >= {MIN_NEAR}
),
near AS (
  SELECT DISTINCT x FROM pair
  WHERE CASE WHEN nx = ny THEN len(list_filter(range(1, nx + 1), lambda i: substr(x, i, 1) <> substr(y, i, 1))) = 1
             WHEN nx > ny THEN len(list_filter(range(1, nx + 1), lambda i: left(x, i - 1) || substr(x, i + 1) = y)) > 0
             ELSE len(list_filter(range(1, ny + 1), lambda i: left(y, i - 1) || substr(y, i + 1) = x)) > 0 END
),
told AS (
  SELECT e.*, n.x IS NOT NULL AS near, u.spot IS NOT NULL AND (n.x IS NOT NULL OR u.spot <> e.doc_id * 10000000 + e.line) AS gone
  FROM each e LEFT JOIN uniq u ON u.content = e.content AND trim(e.content, ' ') <> '' LEFT JOIN near n ON n.x = e.content
)
SELECT d.doc_id, CAST(CASE WHEN d.text IS NULL THEN 0 ELSE count(*) END AS BIGINT) AS n_lines,
       CAST(CASE WHEN d.text IS NULL THEN 0 ELSE count(*) FILTER (NOT gone) END AS BIGINT) AS n_kept,
       CAST(count(*) FILTER (near) AS BIGINT) AS n_near,
       CASE WHEN d.text IS NULL THEN NULL ELSE md5(coalesce(string_agg(content, chr(10) ORDER BY line) FILTER (NOT gone), '')) END AS text_md5
FROM documents d JOIN told t ON t.doc_id = d.doc_id GROUP BY d.doc_id, d.text
"""



def mix_sql(block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS) -> str:
    return f"""
WITH RECURSIVE base AS (
  SELECT doc_id, source IS NULL AS s_null, coalesce(source, '') AS s_name,
         CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         md5('1|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))) AS spot
  FROM documents
),
sized AS (SELECT s_null, s_name, CAST(sum(size) AS BIGINT) AS source_size, sum(greatest(size, 1)) AS units FROM base GROUP BY ALL),
ranked AS (SELECT *, [5, 2, 1][CAST((row_number() OVER (ORDER BY s_null, s_name) - 1) % 3 + 1 AS INT)] AS weight, row_number() OVER (ORDER BY s_null, s_name) AS rank FROM sized),
leveled AS (
  SELECT *, sum(source_size) OVER () AS total, sum(weight) OVER () AS weights,
         coalesce(sum(source_size) OVER o, 0) AS held, coalesce(sum(weight) OVER o, 0) AS held_weight
  FROM ranked WINDOW o AS (ORDER BY source_size / CAST(weight AS DOUBLE), rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
told AS (SELECT *, source_size * 3 <= (total - 3 * held) / CAST(weights - held_weight AS DOUBLE) * weight AS is_full FROM leveled),
targets AS (
  SELECT s_null, s_name, source_size, units, rank,
         CASE WHEN is_full THEN CAST(source_size * 3 AS DOUBLE)
              ELSE CAST(total - 3 * coalesce(sum(source_size) FILTER (is_full) OVER (), 0) AS DOUBLE) / (weights - coalesce(sum(weight) FILTER (is_full) OVER (), 0)) * weight END AS target
  FROM told
),
plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(3, CAST(floor(target / source_size) AS INT)) ELSE 0 END AS passes, greatest(1, CAST(ceil(units / {float(block_words)}) AS INT)) AS n_blocks FROM targets
),
rest AS (SELECT *, CASE WHEN passes < 3 THEN greatest(0.0::DOUBLE, target - passes * source_size) ELSE 0.0 END AS left_over FROM plan),
known AS (SELECT *, CAST(('0x' || substr(spot, 1, 8)) AS BIGINT) % n_blocks AS block FROM base JOIN rest USING (s_null, s_name)),
blocks AS (SELECT s_null, s_name, rank, block, sum(size) AS words, any_value(left_over) AS left_over, any_value(passes) AS passes FROM known GROUP BY ALL),
turns AS (
  SELECT *, row_number() OVER o AS place, count(*) OVER (PARTITION BY rank, pass) AS held,
         CASE WHEN pass = passes THEN left_over - (sum(words) OVER (o ROWS UNBOUNDED PRECEDING) - words) END AS cut
  FROM (SELECT *, CAST(('0x' || substr(md5('1|' || pass || '|' || s_name || '|' || CAST(s_null AS INT) || '|' || block), 1, 13)) AS BIGINT) AS turn
        FROM (SELECT *, unnest(range(0, passes + 1)) AS pass FROM blocks))
  WINDOW o AS (PARTITION BY rank, pass ORDER BY turn, block)
),
taken AS (SELECT *, pass * held + place AS nth FROM turns WHERE cut IS NULL OR cut > 0),
-- The tree: the blocks with the smallest keys go to a node's left half.
node AS (
  SELECT 0 AS low, CAST(greatest(1, ceil((SELECT sum(size) FROM base) / {float(shard_words)})) AS INT) AS high, 0 AS level, rank - 1 AS source, count(*) AS blocks FROM taken GROUP BY rank
  UNION ALL
  SELECT CASE WHEN hit THEN low ELSE half END, CASE WHEN hit THEN half ELSE high END, level + 1, source, count(*)
  FROM (
    SELECT *, row_number() OVER (PARTITION BY low ORDER BY key, source, ball) <= total * (half - low) // (high - low) AS hit
    FROM (
      SELECT *, CAST(('0x' || substr(md5('1|' || low || '|' || level || '|' || source || '|' || ball), 1, 13)) AS BIGINT) AS key
      FROM (SELECT *, (low + high) // 2 AS half, CAST(sum(blocks) OVER (PARTITION BY low) AS BIGINT) AS total, unnest(range(1, blocks + 1)) AS ball FROM node WHERE high - low > 1)
    )
  )
  GROUP BY ALL
),
leaves AS (SELECT low AS shard, source, blocks, sum(blocks) OVER (PARTITION BY source ORDER BY low) AS upto FROM node WHERE high - low = 1),
dealt AS (SELECT t.s_null, t.s_name, t.block, t.pass, t.cut, l.shard FROM taken t JOIN leaves l ON l.source = t.rank - 1 AND t.nth > l.upto - l.blocks AND t.nth <= l.upto),
placed AS (SELECT *, sum(size) OVER (PARTITION BY s_null, s_name, block ORDER BY spot ROWS UNBOUNDED PRECEDING) - size / 2.0::DOUBLE AS middle, row_number() OVER () AS row_no FROM known)
SELECT any_value(p.doc_id) AS doc_id, any_value(p.size) AS size, any_value(source_size) AS source_size, any_value(target) AS target,
       CAST(any_value(p.size) * count(d.pass) AS BIGINT) AS taken,
       coalesce(string_agg(d.pass || ':' || d.shard || ':' || CAST(('0x' || substr(md5('1|' || p.spot || '|' || d.pass), 1, 15)) AS BIGINT), ',' ORDER BY d.pass), '') AS draws
FROM placed p LEFT JOIN dealt d ON d.s_null = p.s_null AND d.s_name = p.s_name AND d.block = p.block AND (d.cut IS NULL OR middle <= d.cut) GROUP BY row_no
"""


MIX_SQL = mix_sql()

TOP_K_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
p AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20
"""

RANK_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS spot, doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
tok AS (SELECT spot, doc_id, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
ask AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark
),
len AS (SELECT spot, any_value(doc_id) AS doc_id, count(*) AS n FROM tok GROUP BY spot),
whole AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM len),
post AS (SELECT spot, term, count(*) AS tf FROM tok WHERE term IN (SELECT term FROM ask) GROUP BY spot, term),
weight AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM post, whole GROUP BY term, docs),
part AS (SELECT spot, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms))) AS score FROM post JOIN weight USING (term) JOIN len USING (spot), whole),
told AS (SELECT item_id, doc_id, CAST(sum(score) AS BIGINT) AS score FROM part JOIN ask USING (term) JOIN len USING (spot) GROUP BY item_id, spot, doc_id HAVING sum(score) > 0)
SELECT item_id, CAST(row_number() OVER o AS INTEGER) AS rank, doc_id, score FROM told WINDOW o AS (PARTITION BY item_id ORDER BY score DESC, doc_id)
QUALIFY row_number() OVER o <= 10
"""

SQL = {"op3_line_dedup": LINES_SQL, "op8_source_mix": MIX_SQL, "op10_cover_tree": TOP_K_SQL, "op11_impact_ranking": RANK_SQL}
