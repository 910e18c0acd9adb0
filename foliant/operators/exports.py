"""Records and texts that leave the store: chunk and ingest records, manifests, asset
summaries, Markdown of blocks, position tags and blocks from engines' results."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import text as t

ASSET = ("asset_id", "asset_type", "download_path", "resolved_url")


def chunk_records(chunks: DataFrame, assets: DataFrame, key: str = "chunk_id") -> DataFrame:
    """``chunks`` with ``assets``: the known ones among their ``asset_refs``, in the
    order of the references; a reference named twice is there twice."""
    refs = chunks.select(key, F.posexplode("asset_refs").alias("_no", "asset_id"))
    own = refs.join(assets.select(*ASSET), "asset_id")
    each = own.groupBy(F.col(key).alias("_key")).agg(F.array_sort(F.collect_list(F.struct("_no", *ASSET))).alias("_assets"))
    empty = F.array().cast("array<struct<asset_id:string,asset_type:string,download_path:string,resolved_url:string>>")
    plain = F.transform("_assets", lambda x: F.struct(*(x[c].cast("string").alias(c) for c in ASSET)))
    return chunks.join(each, chunks[key] == each["_key"], "left").withColumn("assets", F.coalesce(plain, empty)).drop("_key", "_assets")


def ingest_records(records: DataFrame, document: str = "document_id", chunk: str = "chunk_id") -> DataFrame:
    """``records`` with ``record_id`` and the different types and addresses of their
    assets, in order."""
    url = lambda x: F.when(F.coalesce(x["resolved_url"], F.lit("")) != "", x["resolved_url"]).otherwise(F.coalesce(x["download_path"], F.lit("")))
    return records.withColumns(
        {
            "record_id": F.concat_ws(":", document, chunk),
            "asset_types": F.array_distinct(F.transform("assets", lambda x: x["asset_type"])),
            "asset_urls": F.array_distinct(F.filter(F.transform("assets", url), lambda x: x != "")),
        }
    )


def merged(*maps: Column) -> Column:
    """Maps as one; later ones win."""
    return reduce(lambda old, new: F.map_concat(F.map_filter(old, lambda k, _: ~F.array_contains(F.map_keys(new), k)), new), maps)


def manifests(docs: DataFrame, key: str, parts: Mapping[str, DataFrame]) -> DataFrame:
    """``docs`` with the number of rows of each of ``parts`` (blocks, assets, chunks)."""
    for name, rows in parts.items():
        n = rows.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_n"))
        docs = docs.join(n, docs[key] == n["_key"], "left").withColumn(name, F.coalesce("_n", F.lit(0))).drop("_key", "_n")
    return docs


def page_phrase(pages: Column) -> Column:
    """How a summary names pages."""
    own = F.array_sort(F.array_distinct(F.filter(pages, lambda p: p > 0)))
    first, last = F.get(own, 0), F.try_element_at(own, F.lit(-1))
    few = F.concat(F.lit("pages "), F.array_join(F.transform(own, lambda p: p.cast("string")), ", "))
    return F.when(F.coalesce(F.size(own), F.lit(0)) <= 0, "unknown page").when(F.size(own) == 1, F.concat(F.lit("page "), first)).when(F.size(own) <= 3, few).otherwise(F.concat(F.lit("pages "), first, F.lit("-"), last))


def table_shape(text: Column) -> Column:
    """(n_rows, n_columns) of a Markdown table, separators left out; nulls if none."""
    bare = lambda x, what: F.regexp_replace(x, rf"^[{what}]+|[{what}]+$", "")
    lines = F.filter(F.transform(F.split(text, r"\r\n|\r|\n"), lambda x: bare(x, r"\s")), lambda x: F.contains(x, F.lit("|")))
    cells = F.transform(lines, lambda x: F.transform(F.split(bare(x, "|"), r"\|"), lambda c: bare(c, r"\s")))
    rows = F.filter(cells, lambda r: F.exists(r, lambda c: (c != "") & ~F.rlike(c, F.lit("^:?-{2,}:?$"))))
    some = F.size(rows) > 0
    return F.struct(F.when(some, F.size(rows)).alias("n_rows"), F.when(some, F.array_max(F.transform(rows, lambda r: F.size(r)))).alias("n_columns"))


def asset_summary(kind: Column, text: Column, pages: Column, n_rows: Column, n_columns: Column, width: Column, height: Column, most: int = 180) -> Column:
    """One sentence about an asset."""
    excerpt = t.truncated(t.collapsed(F.coalesce(text, F.lit(""))), most)
    label = lambda name: F.when(excerpt != "", F.concat(F.lit(f". {name}: "), excerpt)).otherwise("")
    sides = F.array_join(F.array_compact(F.array(F.concat(n_rows.cast("string"), F.lit(" rows")), F.concat(n_columns.cast("string"), F.lit(" columns")))), " and ")
    table = F.concat(F.lit("Table on "), page_phrase(pages), F.when(sides != "", F.concat(F.lit(" with "), sides)).otherwise(""), label("Text"))
    size = F.coalesce(F.concat(F.lit(", "), width.cast("string"), F.lit("x"), height.cast("string")), F.lit(""))
    other = F.concat(F.initcap(kind), F.lit(" on "), page_phrase(pages), size, F.when(kind == "image", label("OCR text")).otherwise(label("Text")))
    return F.concat(F.when(kind == "table", table).otherwise(other), F.lit("."))


def blocks_markdown(blocks: DataFrame, key: str = "doc_id", order: str = "pos") -> DataFrame:
    """(key, markdown): blocks with text in order; titles get as many # as their level,
    at least one and at most six."""
    marks = F.repeat(F.lit("#"), F.greatest(F.lit(1), F.least(F.lit(6), F.coalesce("level", F.lit(1)))))
    body = F.trim("text")
    line = F.when(F.col("block_type") == "title", F.concat(marks, F.lit(" "), body)).otherwise(body)
    rows = blocks.filter(body != "").groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("line")))).alias("_l"))
    return rows.select(key, F.array_join(F.transform("_l", lambda x: x["line"]), "\n\n").alias("markdown"))


def results_markdown(parts: DataFrame, key: str, order: str, text: str, is_table: Column) -> DataFrame:
    """(key, markdown): texts in order, then a section with the tables, if any."""
    rows = parts.filter(F.trim(text) != "").withColumn("_t", is_table)
    both = rows.groupBy(key).agg(*(F.array_sort(F.collect_list(F.when(F.col("_t") == v, F.struct(F.col(order).alias("o"), F.trim(text).alias("x"))))).alias(n) for n, v in (("a", False), ("b", True))))
    names = lambda c: F.transform(c, lambda x: x["x"])
    head = F.when(F.size("b") > 0, F.array(F.lit("### Tables"))).otherwise(F.array().cast("array<string>"))
    return both.select(key, F.array_join(F.concat(names("a"), head, names("b")), "\n\n").alias("markdown"))


def position_tag(pages: Column, x0: Column, x1: Column, top: Column, bottom: Column) -> Column:
    """Pages and edges as they are marked in a text."""
    return F.concat(F.lit("@@"), F.array_join(F.transform(pages, lambda p: p.cast("string")), "-"), F.format_string("\t%.1f\t%.1f\t%.1f\t%.1f##", x0, x1, top, bottom))


def positions(text: Column) -> Column:
    """The positions that a text is marked with; pages count from 0."""
    tags = F.regexp_extract_all(text, F.lit(r"@@([0-9-]+\t[0-9.\t]+)##"), F.lit(1))

    def one(tag: Column) -> Column:
        p = F.split(tag, "\t")
        edge = lambda i: F.get(p, i).cast("double")
        return F.struct(F.transform(F.split(F.get(p, 0), "-"), lambda x: x.cast("int") - 1).alias("pages"), edge(1).alias("x0"), edge(2).alias("x1"), edge(3).alias("top"), edge(4).alias("bottom"))

    return F.transform(tags, one)


def renumbered(blocks: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """``blocks`` with ``block_id``: block-0000 and so on in their order."""
    from pyspark.sql import Window

    no = F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1
    return blocks.withColumn("block_id", F.format_string("block-%04d", no))


def content_list(pages: DataFrame, json: str = "json", width: float | None = None, height: float | None = None) -> DataFrame:
    """Blocks of a content list in JSON (type, page_idx, bbox in thousandths, bodies and
    captions by type): its columns, ``no``, block_type, text, page and edges."""
    schema = "array<struct<type:string,page_idx:int,bbox:array<double>,text:string,table_body:string,table_caption:array<string>,table_footnote:array<string>,image_caption:array<string>,image_footnote:array<string>,code_body:string,code_caption:array<string>,list_items:array<string>>>"
    rows = pages.select("*", F.posexplode(F.from_json(json, schema)).alias("no", "_x"))
    kind = F.lower(F.trim(F.coalesce("_x.type", F.lit("text"))))
    joined = lambda c, sep="\n": F.array_join(F.coalesce(F.col(f"_x.{c}"), F.array().cast("array<string>")), sep)
    plain = lambda c: F.coalesce(F.col(f"_x.{c}"), F.lit(""))
    body = (
        F.when(kind == "table", F.concat(plain("table_body"), joined("table_caption"), joined("table_footnote")))
        .when(kind == "image", F.concat(joined("image_caption", ""), F.lit("\n"), joined("image_footnote", "")))
        .when(kind == "code", F.concat(plain("code_body"), joined("code_caption")))
        .when(kind == "list", joined("list_items"))
        .otherwise(plain("text"))
    )
    box = F.when(F.size("_x.bbox") == 4, F.col("_x.bbox")).otherwise(F.array(*[F.lit(0.0)] * 4))
    edge = lambda i, side: F.get(box, i) / 1000.0 * side if side else F.get(box, i)
    out = rows.select(*pages.columns, "no", kind.alias("raw_type"), F.regexp_replace(body, r"^\s+|\s+$", "").alias("text"), (F.coalesce("_x.page_idx", F.lit(0)) + 1).alias("page"), edge(0, width).alias("x0"), edge(1, height).alias("top"), edge(2, width).alias("x1"), edge(3, height).alias("bottom"))
    return out.withColumn("block_type", F.when(F.col("raw_type").isin("table", "equation", "list", "code"), F.col("raw_type")).when(F.col("raw_type") == "image", "figure").otherwise("text"))


def layout_results(pages: DataFrame, json: str = "json", zoom: float = 2.0) -> DataFrame:
    """Blocks of a layout engine's result in JSON, a list of pages with blocks whose
    fields have names of either style; edges are divided by ``zoom``."""
    names = "block_label:string,blockLabel:string,block_type:string,blockType:string,block_bbox:array<double>,blockBbox:array<double>,block_content:string,blockContent:string"
    schema = f"array<struct<parsing_res_list:array<struct<{names}>>,parsingResList:array<struct<{names}>>>>"
    each = pages.select("*", F.posexplode(F.from_json(json, schema)).alias("_page", "_p"))
    rows = each.select(*pages.columns, "_page", F.posexplode(F.coalesce("_p.parsing_res_list", "_p.parsingResList")).alias("no", "_b"))
    label = F.lower(F.trim(F.coalesce("_b.block_label", "_b.blockLabel", "_b.block_type", "_b.blockType", F.lit("text"))))
    box = F.coalesce("_b.block_bbox", "_b.blockBbox")
    box = F.when(F.size(box) == 4, box).otherwise(F.array(*[F.lit(0.0)] * 4))
    kind = F.when(label.isin("seal", "stamp"), "seal").when(label == "table", "table").when(label.isin("figure", "image"), "figure").when(F.contains(label, F.lit("title")), "title").when(F.contains(label, F.lit("formula")), "equation").otherwise("text")
    return rows.select(*pages.columns, (F.col("_page") + 1).alias("page"), "no", label.alias("label"), kind.alias("block_type"), F.trim(F.coalesce("_b.block_content", "_b.blockContent", F.lit(""))).alias("text"), *((F.get(box, i) / zoom).alias(n) for i, n in enumerate(("x0", "top", "x1", "bottom"))))


def tables_apart(text: Column) -> Column:
    """(tables, rest): Markdown tables with borders or without and HTML tables in
    order of kind, and the text with a blank line in the place of each."""
    bordered = r"(?:^|\n)(?:\|[^\n]*\|[^\n]*\n)(?:\|[ :|-]+\|[ ]*\n)(?:\|[^\n]*\|[^\n]*(?:\n|$))+"
    bare = r"(?:^|\n)(?:[^\n|]+\|[^\n]*\n)(?:[ ]*[:-]+[-| :]*\n)(?:[^\n|]+\|[^\n]*(?:\n|$))+"
    html = r"(?is)<table[^>]*>.*?</table>"
    found, rest = [], text
    for kind in (bordered, bare, html):
        found.append(F.transform(F.regexp_extract_all(rest, F.lit(kind), F.lit(0)), lambda x: F.regexp_replace(x, r"^\n+|\n+$", "")))
        rest = F.regexp_replace(rest, kind, "\n\n")
    return F.struct(F.concat(*found).alias("tables"), rest.alias("rest"))


def with_sources(text: Column, mapped: Column) -> Column:
    """Markdown with the addresses of its images looked up in a map; others stay."""
    urls = F.array_distinct(F.regexp_extract_all(text, F.lit(r"!\[[^\]]*\]\(([^)\s]+)\)"), F.lit(1)))
    swap = lambda s, u: F.replace(s, F.concat(F.lit("]("), u, F.lit(")")), F.concat(F.lit("]("), F.coalesce(F.try_element_at(mapped, u), u), F.lit(")")))
    return F.aggregate(urls, text, swap)
