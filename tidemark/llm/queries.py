"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cws, langid, licenses, lm, merkle, mixing, nndescent, packing, prefixtrie, repeats, simhash, tokencount, toxicity
from .common import fold, materialize, table

Query = Callable[[SparkSession, str], DataFrame]


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file of the box."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nndescent.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_bloom_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lm.score(table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 7) != 2)
    return out.withColumnRenamed("id", "doc_id")


def op4_sainte_lague_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = fold(F.col("doc_id"), 4) == 2
    told = langid.identify(docs, langid.fit(docs, ~held_out))
    return told.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op6_weighted_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cws.fingerprints(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tokencount.token_counts(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))
    return out.withColumnRenamed("id", "doc_id")


def op8_bounded_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.tiktoken"))
    return out.withColumnRenamed("id", "doc_id")


def op9_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeats(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = fold(F.col("doc_id"), 3) == 1
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"), ~held_out)
    told = toxicity.score(docs, model)
    return told.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    seqs = prefixtrie.sequences(table(spark, sf_dir, "conversations"))
    paths = prefixtrie.spliced(materialize(seqs, "sequences"), 20, fold(F.col("conv_id"), 4).cast("int"), 3)
    return prefixtrie.trie(paths).drop("digest")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.documents_manifest(table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 2) == 0)


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("spans").withColumnRenamed("id", "doc_id")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_simhash_near_dedup,
        op2_embedding_near_dedup,
        op3_bloom_lm_scores,
        op4_sainte_lague_mix,
        op5_language_id,
        op6_weighted_fingerprints,
        op7_token_counts,
        op8_bounded_packing,
        op9_repeated_strings,
        op10_toxicity,
        op11_prefix_trie,
        op12_merkle_manifest,
        op13_license_scan,
    )
}

#: Exact links by SQL; NN-descent finds them all on a table small enough for SQL to compare all pairs.
_LINKS_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
u AS (SELECT * FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND list_sum(list_transform(e, lambda x: x * x)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)
"""

ORACLE_SQL: dict[str, str] = {"op4_sainte_lague_mix": mixing.SQL, "op2_embedding_near_dedup": _LINKS_SQL, "op11_prefix_trie": prefixtrie.SQL, "op12_merkle_manifest": merkle.SQL, "op13_license_scan": licenses.sql()}
