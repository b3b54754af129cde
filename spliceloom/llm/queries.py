"""The registered query of each operator, and its SQL where SQL can express it."""

from __future__ import annotations

import os
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .conversations import damage, digest_turns, repair_conversations
from .embedding_dedup import embedding_dedup
from .exact_dedup import exact_dedup
from .line_dedup import line_dedup
from .lm_scoring import score_texts
from .mixing import mix_sources
from .ngram_join import jaccard_join
from .packing import pack
from .secrets import scan_secrets
from .suffix_dedup import suffix_dedup
from .token_alignment import align_tokens
from .token_counts import count_tokens
from .toxicity import score_toxicity

# Where the box keeps the public vocabulary files; the settings in brackets name other files.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"  # SPLICELOOM_RANKS
BYTE_LEVEL = "/opt/tokenizers/byte_bpe_50k.json"  # SPLICELOOM_BYTE_LEVEL
PIECES = "/opt/tokenizers/piece_bpe_32k.model"  # SPLICELOOM_PIECES


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(_table(spark, sf_dir, "embeddings"))


def op3_scan_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_lexed")


def op4_score_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted", "n_passages")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(_table(spark, sf_dir, "documents")).drop("kept")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"))


def op7_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(_table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_join(_table(spark, sf_dir, "documents"), n=4, part=85)
    return found.select("doc_id", "n_shingles", "component_id")


def op10_count_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = Path(os.environ.get("SPLICELOOM_RANKS", RANKS)).read_bytes()
    return count_tokens(_table(spark, sf_dir, "documents"), ranks)


def op11_align_tokenizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    byte_level = Path(os.environ.get("SPLICELOOM_BYTE_LEVEL", BYTE_LEVEL)).read_bytes()
    pieces = Path(os.environ.get("SPLICELOOM_PIECES", PIECES)).read_bytes()
    return align_tokens(_table(spark, sf_dir, "documents"), byte_level, pieces)


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op13_repair_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = _table(spark, sf_dir, "conversations")
    audits, turns = repair_conversations(damage(conversations), conversations)
    digests = digest_turns(turns).withColumnRenamed("conv_id", "mended_id")
    empty = F.sha2(F.lit("").cast("binary"), 256)
    joined = audits.join(digests, audits["conv_id"].eqNullSafe(digests["mended_id"]), "left")
    return joined.select(*audits.columns, F.coalesce("sha256", empty).alias("repaired_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": op1_mix_sources,
    "op2_embedding_dedup": op2_embedding_dedup,
    "op3_scan_secrets": op3_scan_secrets,
    "op4_score_toxicity": op4_score_toxicity,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_deleted_interpolation": op7_deleted_interpolation,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_ngram_jaccard_join": op9_ngram_jaccard_join,
    "op10_count_tokens": op10_count_tokens,
    "op11_align_tokenizers": op11_align_tokenizers,
    "op12_line_dedup": op12_line_dedup,
    "op13_repair_conversations": op13_repair_conversations,
}

OP8_SQL = r"""
WITH rows AS (
    SELECT doc_id, length(coalesce(text, '')) AS points,
           sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
    FROM documents
), ranked AS (
    SELECT doc_id, text_sha256, count(*) OVER (PARTITION BY text_sha256) AS group_size,
           first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id ROWS UNBOUNDED PRECEDING) AS keep_id
    FROM rows
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM ranked
"""

OP2_SQL = r"""
WITH RECURSIVE vectors AS (
    SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
), usable AS (
    SELECT * FROM vectors WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(v) > 0
        AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0
), links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id
    WHERE list_cosine_similarity(a.v, b.v) >= 0.98
), walk(v, w) AS (
    SELECT a, b FROM links UNION SELECT walk.v, links.b FROM walk JOIN links ON links.a = walk.w
), found AS (
    SELECT vec_id, coalesce((SELECT count(*) FROM links WHERE a = vec_id), 0) AS n_links, least(vec_id, coalesce((SELECT min(w) FROM walk WHERE v = vec_id), vec_id)) AS component_id FROM vectors
)
SELECT *, vec_id = component_id AS kept FROM found
"""

OP9_SQL = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s
    FROM words WHERE len(w) > 0
), sizes AS (
    SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingles a JOIN shingles b USING (s) WHERE a.doc_id < b.doc_id GROUP BY ALL
), pairs AS (
    SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)
), links AS (
    SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs
), walk(v, w) AS (
    SELECT a, b FROM links UNION SELECT walk.v, links.b FROM walk JOIN links ON links.a = walk.w
), least_of AS (
    SELECT v, min(w) AS w FROM walk GROUP BY v
)
SELECT words.doc_id, coalesce(n, 0) AS n_shingles, least(words.doc_id, coalesce(least_of.w, words.doc_id)) AS component_id
FROM words LEFT JOIN sizes ON sizes.doc_id = words.doc_id LEFT JOIN least_of ON least_of.v = words.doc_id
"""

OP12_SQL = r"""
WITH texts AS (
    SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), lines AS (
    SELECT doc_id, generate_subscripts(lines, 1) AS place, unnest(lines) AS line FROM texts
), keyed AS (
    SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), frequent AS (
    SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
    SELECT doc_id, place, line, keeper IS NOT NULL AND keeper <> doc_id AS dropped FROM keyed LEFT JOIN frequent USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

ORACLE_SQL: dict[str, str] = {"op2_embedding_dedup": OP2_SQL, "op8_exact_dedup": OP8_SQL, "op9_ngram_jaccard_join": OP9_SQL, "op12_line_dedup": OP12_SQL}
