"""From raw documents to token counts of a training mixture, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next one's ``docs``. All but the last return the
columns of ``documents``, and columns of any other name as they came.

Defined results: a null or empty text, or one without a letter, has no language and
goes in the first stage; null ids, languages and sources are kept as they are (a null
id has no group and never goes for a copy); rows equal in id and text stay or go
together, but for the mixture, which may end between them; ids that share a group
through any of their texts leave the rows of the least id; an empty table gives an
empty one in every stage.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import catalog, jaccard_join, language_id, mixture, pieces, repeats
from foliant.llm.common import give_back, table, written

#: Share of all tokens that the mixture takes.
SHARE = 0.95


def from_small_heaps(stage):
    """``stage`` after the executors gave back heap that was grown before it."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        give_back(spark)
        return stage(spark, docs, sf_dir)

    return run


@from_small_heaps
def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the classifier tells; it rejects texts without a
    letter and those between two languages."""
    return language_id.known(docs, language_id.learned_from(docs))


@from_small_heaps
def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents tied by a Jaccard of 0.8 on five-word shingles the one of least id."""
    groups = jaccard_join.clustered(docs, n=5, percent=80)
    extra = written(groups.filter("doc_id <> component_id").select(F.col("doc_id").alias("_extra")).distinct(), "extra")
    return docs.join(extra, docs.doc_id == extra["_extra"], "left_anti").select(*docs.columns)


@from_small_heaps
def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 100 bytes that start earlier elsewhere."""
    return repeats.cut(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


@from_small_heaps
def target_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fill the budgets of their domain, language and source once."""
    quarters = F.ceil(F.octet_length(F.coalesce("text", F.lit(""))) / 4).cast("long").alias("quarters")
    sized = catalog.with_domain(docs.select("doc_id", "text", "lang", "source", quarters, F.struct("*").alias("row")))
    taken = mixture.select(sized, ("domain", "lang", "source"), "quarters", SHARE, catalog.MIX_WEIGHTS, seed=17, max_epochs=1)
    return taken.select("row.*")


@from_small_heaps
def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Counts and checksums of each document's piece ids, and whether they decode to its text."""
    import public_tokenizers

    return pieces.encoded(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("language_id", known_language),
    ("near_duplicates", one_of_each_group),
    ("long_repeats", without_repeats),
    ("mixture", target_mixture),
    ("pieces", piece_ids),
]

#: SQL can't express compression, suffix order or merges; tests hold the result
#: against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
