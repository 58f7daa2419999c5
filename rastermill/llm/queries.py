"""The registered queries opN_<name>: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embeddings, jaccard, media, mixing, packing, quality, recompress, repair, token_counts, toxicity
from .common import documents, scratch


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "token-ids")
    repair.write_ids(documents(spark, sf_dir), path, tokenizer("word_bpe_49k.json"))
    return repair.read_ids(spark, path, with_ids=False).drop("ids")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(documents(spark, sf_dir), labels(spark, sf_dir))


def op3_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.store_and_describe(documents(spark, sf_dir), "text")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"))
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.prefix_token_counts(documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"), keep=False)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > token_counts.LIMIT).alias("over_limit"), "fit_chars")


def op7_recompress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompress.remove_repeats(documents(spark, sf_dir)).drop("kept")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(documents(spark, sf_dir), labels(spark, sf_dir))


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_documents(documents(spark, sf_dir), width=4, numerator=85, denominator=100)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_repair, op2_quality, op3_embeddings, op4_media, op5_packing, op6_token_counts, op7_recompress, op8_mixing, op9_toxicity, op10_jaccard)}

#: DuckDB SQL for the rows of the queries that SQL can express.
ORACLE_SQL: dict[str, str] = {
    "op3_embeddings": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
    AND len([x FOR x IN embedding IF x <> 0]) > 0
), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93
), reach(a, b) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a
), comp AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM link GROUP BY a)
SELECT c.vec_id, coalesce(n.n_links, 0)::BIGINT AS n_links, c.component_id, c.vec_id = c.component_id AS kept
FROM comp c LEFT JOIN n USING (vec_id)""",
    "op7_recompress": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(ws[i : i + 49], ' ')) AS h FROM w, generate_series(1, len(ws) - 49) g(i)),
least_doc AS (SELECT h, min(doc_id) AS f FROM win GROUP BY h),
gone AS (SELECT DISTINCT b.doc_id, p FROM (SELECT win.doc_id, i FROM win JOIN least_doc USING (h) WHERE f < win.doc_id) b, generate_series(b.i, b.i + 49) g(p)),
word AS (SELECT doc_id, p, ws[p] AS word FROM w, generate_series(1, len(ws)) g(p)),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS kept FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)""",
    "op10_jaccard": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), sh AS (
  SELECT DISTINCT doc_id, md5(array_to_string(ws[i : i + 3], ' ')) AS s FROM w, generate_series(1, greatest(len(ws) - 3, 1)) g(i) WHERE len(ws) > 0
), n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM sh a JOIN sh b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
reach(a, b) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a)
SELECT w.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.b) AS component_id
FROM w JOIN reach r ON r.a = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id GROUP BY w.doc_id""",
}
