"""Blocks of documents: the ordered units that chunks are packed from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import text as t

VISUAL = ("figure", "table", "equation", "seal", "barcode", "image")


def line_blocks(docs: DataFrame, split: str = r"\n") -> DataFrame:
    """(doc_id, pos, block_type, text, token_count, ...) of each non-empty part.

    A part that starts with # is a title, one with | a table; pos counts from 0
    within a document. Other columns of ``docs`` stay."""
    parts = docs.select("*", F.posexplode(F.split(F.coalesce("text", F.lit("")), split)).alias("_no", "_part"))
    body = F.trim(F.col("_part"))
    kind = F.when(body.startswith("#"), "title").when(F.contains(body, F.lit("|")), "table").otherwise("text")
    kept = parts.filter(body != "").withColumn("block_type", kind)
    from pyspark.sql import Window

    pos = F.row_number().over(Window.partitionBy("doc_id").orderBy("_no")) - 1
    bare = F.when(F.col("block_type") == "title", F.trim(F.regexp_replace(body, "^#+", ""))).otherwise(body)
    return kept.withColumn("pos", pos).withColumn("text", bare).withColumn("token_count", t.token_count(bare)).drop("_no", "_part")


def rendered(kind: Column, text: Column) -> Column:
    """A block's text as it stands in a chunk; visual ones carry their kind."""
    body = F.trim(F.coalesce(text, F.lit("")))
    name = F.initcap(kind)
    return (
        F.when(kind == "title", F.when(body == "", "").otherwise(F.concat(F.lit("# "), body)))
        .when(kind.isin("figure", "table", "equation", "seal", "barcode"), F.when(body == "", F.concat(F.lit("["), name, F.lit("]"))).otherwise(F.concat(F.lit("["), name, F.lit("]\n"), body)))
        .otherwise(body)
    )


def kept(blocks: DataFrame) -> DataFrame:
    """Blocks with text or assets."""
    return blocks.filter((F.trim(F.coalesce("text", F.lit(""))) != "") | (F.size(F.coalesce("asset_refs", F.array().cast("array<string>"))) > 0))


def title_path(titles: Column, depth: int = 3) -> Column:
    """The path of open titles after an ordered array of (level, title): a title
    closes those of its level and below; at most ``depth`` of the last stay."""
    empty = F.array().cast("array<struct<level:int,title:string>>")

    def step(path: Column, x: Column) -> Column:
        open_ = F.filter(path, lambda y: y["level"] < x["level"])
        return F.when(x["level"].isNull(), path).otherwise(F.concat(open_, F.array(F.struct(x["level"].alias("level"), x["title"].alias("title")))))

    names = lambda p: F.transform(p, lambda y: y["title"])
    path = F.aggregate(titles, empty, step)
    return names(F.when(F.size(path) > depth, F.slice(path, -depth, depth)).otherwise(path))


def context(blocks: DataFrame, window: int = 2, key: str = "doc_id") -> DataFrame:
    """``blocks`` with ``before`` and ``after``: positions of up to ``window``
    neighbours on either side that are not visual."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy("pos")
    plain = F.when(~F.col("block_type").isin(*VISUAL), F.col("pos"))
    near = lambda a, z: F.array_sort(F.array_compact(F.collect_list(plain).over(w.rowsBetween(a, z))))
    return blocks.withColumn("before", near(-window, -1)).withColumn("after", near(1, window))


def artifact_order(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """``blocks`` (page, top, left, block_id) with ``ordinal``: reading order by
    page, top, left and id, named block-0001 and so on."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(F.col("page").asc_nulls_first(), F.col("top").asc_nulls_first(), F.col("left").asc_nulls_first(), "block_id")
    return blocks.withColumn("ordinal", F.format_string("block-%04d", F.row_number().over(w)))
