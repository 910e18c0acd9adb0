"""The ingest store as DataFrame operators: filters, aliases, joins, statistics,
pages, upserts and integrity."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def where_equal(df: DataFrame, **wanted) -> DataFrame:
    """Rows that equal every value given; None and empty text ask for nothing."""
    tests = [F.col(c) == v for c, v in wanted.items() if v not in (None, "")]
    return df.filter(reduce(Column.__and__, tests)) if tests else df


def with_status(df: DataFrame, column: str = "status", default: str = "") -> DataFrame:
    return df.withColumn(column, F.coalesce(F.col(column), F.lit(default)))


def canonical(ids: DataFrame, aliases: DataFrame, key: str = "parse_id") -> DataFrame:
    """``ids`` with ``canonical_id`` by ``aliases`` (alias_id, canonical_id); itself where there is none."""
    a = aliases.select(F.col("alias_id").alias("_a"), F.col("canonical_id").alias("_c"))
    return ids.join(a, F.col(key) == F.col("_a"), "left").withColumn("canonical_id", F.coalesce("_c", key)).drop("_a", "_c")


def deduplicated(docs: DataFrame, keys: Sequence[str], order: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(first of each key, aliases of the rest to it). The first is found by an
    aggregate, so that a key with very many rows isn't sorted in one task."""
    lead = docs.groupBy(*keys).agg(F.min(F.struct(*order)).alias("_lead"))
    both = docs.join(lead, list(keys)).withColumn("_own", F.struct(*order))
    return both.filter("_own = _lead").drop("_own", "_lead"), both.filter("_own <> _lead").select(*keys, *order, *(F.col(f"_lead.{c}").alias(f"canonical_{c}") for c in order))


def upserted(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those of the same keys."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


def page_of(df: DataFrame, order: Sequence[Column], limit: int, offset: int = 0) -> DataFrame:
    """One page; ``order`` must end in a unique key. The limit is at least 1."""
    return df.orderBy(*order).offset(max(0, int(offset))).limit(max(1, int(limit)))


def unknown_refs(refs: DataFrame, known: DataFrame, ref: str, key: str) -> DataFrame:
    """References without a row they name."""
    return refs.filter(F.col(ref).isNotNull()).join(known.select(F.col(key).alias("_k")).distinct(), F.col(ref) == F.col("_k"), "left_anti")


def joined_refs(rows: DataFrame, refs: str, known: DataFrame, key: str, id_col: str) -> DataFrame:
    """(id, found): the known rows that an array names, in its order; unknown names are dropped."""
    named = rows.select(id_col, F.posexplode(refs).alias("_no", "_ref"))
    side = known.withColumnRenamed(key, "_k")
    found = named.join(side, F.col("_ref") == F.col("_k"))
    got = found.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("_no", F.col("_ref").alias(key)))).alias("_f"))
    return rows.select(id_col).join(got, id_col, "left").select(id_col, F.transform(F.coalesce("_f", F.array().cast(got.schema["_f"].dataType)), lambda x: x[key]).alias("found"))


def chain(nodes: DataFrame, id_col: str, parent_col: str, name_col: str) -> DataFrame:
    """(id, path) of each node from the top. Paths double each round: a row that ends at
    a node takes on that node's own path, so few rounds reach any depth. A parent that
    isn't there ends a path; a cycle is an error."""
    now = settled(nodes.select(F.col(id_col).alias("_id"), F.array(F.col(name_col)).alias("path"), F.col(parent_col).alias("_next")))
    most, reached = now.count(), 1
    while now.filter(F.col("_next").isNotNull()).limit(1).count():
        if reached > most:
            raise ValueError("nodes are their own ancestors")
        up = now.select(F.col("_id").alias("_up"), F.col("path").alias("_path"), F.col("_next").alias("_then"))
        now = settled(now.join(up, F.col("_next") == F.col("_up"), "left").select("_id", F.when(F.col("_up").isNotNull(), F.concat("_path", "path")).otherwise(F.col("path")).alias("path"), F.col("_then").alias("_next")))
        reached *= 2
    return now.select(F.col("_id").alias(id_col), "path")


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the folder that the cluster shares
    (``spark.checkpoint.dir``), so that lost executors can't change it."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        at = spark.conf.get("spark.checkpoint.dir", None)
        if not at and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(at or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")
    return df.checkpoint()


def numbered(df: DataFrame, order: Sequence, name: str = "place") -> DataFrame:
    """``df`` with its place from 0 in an order, without one task for all rows: ranges
    are ordered on their own, and begin at the counts of those before."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    kept = settled(ranged).withColumns({"_part": F.shiftright("_id", 33), "_in": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))})
    counts = kept.groupBy("_part").count().withColumn("_base", F.sum("count").over(Window.orderBy("_part")) - F.col("count"))
    return kept.join(F.broadcast(counts.select(F.col("_part").alias("_p"), "_base")), F.col("_part") == F.col("_p")).withColumn(name, F.col("_in") + F.col("_base")).drop("_id", "_part", "_in", "_p", "_base")


def one_to_one(a: DataFrame, b: DataFrame, order_a: Sequence, order_b: Sequence, how: str = "inner") -> DataFrame:
    """Rows of two tables paired by their place in the order."""
    return numbered(a, order_a, "_no").join(numbered(b, order_b, "_no"), "_no", how).drop("_no")


def shares(counts: Mapping[str, Column]) -> list[Column]:
    """Counts of rows that fulfil each condition."""
    return [F.count_if(c).alias(name) for name, c in counts.items()]
