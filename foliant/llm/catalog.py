"""The registered queries of this subpackage and the SQL of those that SQL can
express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import jaccard_join, language_id, media, mixture, pieces, quality, repeats, rp_forest, token_files, token_rollup
from foliant.llm.common import scratch, table, written


#: The target mixture of op1: domains, languages within them, sources within those.
MIX_WEIGHTS = {("web",): 2.0, ("books",): 2.0, ("code",): 1.0, ("web", "en"): 3.0, ("web", "de"): 2.0, ("books", "fr"): 2.0, ("web", "en", "src0"): 1.5}


def with_domain(docs: DataFrame) -> DataFrame:
    """``docs`` with the domain of its source: src0, src3, ... web, then books, then code."""
    no = F.regexp_extract("source", r"(\d+)$", 1).cast("int") % 3
    return docs.withColumn("domain", F.when(no == 0, "web").when(no == 1, "books").otherwise("code"))


def op1_source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_domain(table(spark, sf_dir, "documents"))
    text = F.coalesce("text", F.lit(""))
    slim = written(docs.select("doc_id", "domain", "lang", "source", F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("n_tokens"), F.xxhash64(text).alias("digest")), "mixture")
    return mixture.select(slim, ("domain", "lang", "source"), "n_tokens", 0.9, MIX_WEIGHTS, seed=17, max_epochs=2, ids=("doc_id", "digest"))


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.stored_text(table(spark, sf_dir, "documents"))


def op3_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp_forest.linked(table(spark, sf_dir, "embeddings"))


def op4_long_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digest(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = language_id.classify(docs.select("doc_id", "text"), language_id.learned_from(docs))
    return out.select(out.doc_id.cast("long").alias("doc_id"), language_id.held_out().alias("held_out"), "lang_pred", "score", "margin", "rejected")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_files.encoded(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


def op7_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(table(spark, sf_dir, "documents"))[0]


def op8_piece_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pieces.encoded(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.clustered(table(spark, sf_dir, "documents"), n=3, percent=90)


def op10_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = written(token_rollup.counted(table(spark, sf_dir, "documents")), "counts")
    return token_rollup.replayed(counts, token_rollup.Rollup(spark, scratch(spark, "rollup")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_source_mixture, op2_media_columns, op3_embedding_links, op4_long_repeats, op5_language_id, op6_token_files, op7_weak_quality, op8_piece_lattice, op9_jaccard_join, op10_token_rollup)}


def oracle_sql() -> dict[str, str]:
    return {"op10_token_rollup": token_rollup.ROLLUP_SQL}
