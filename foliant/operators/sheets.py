"""Rows of sheets and tables: sentences, HTML and Markdown of chunks, and packing of
blocks and rows into budgets of tokens.

A sheet's row is (sheet, row, cells): its number from 0 and an array of strings; row
0 holds the headers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Control characters that a cell must not hold.
ILLEGAL = r"[\x00-\x08\x0B\x0C\x0E-\x1F]"


def blank(c: Column) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) == ""


def actual_rows(rows: DataFrame) -> DataFrame:
    """(sheet, n_rows): up to the last row with a cell that isn't blank."""
    some = F.exists("cells", lambda c: ~blank(c))
    return rows.groupBy("sheet").agg(F.coalesce(F.max(F.when(some, F.col("row") + 1)), F.lit(0)).alias("n_rows"))


def headed(rows: DataFrame) -> DataFrame:
    """Rows below the headers, with those as ``headers``."""
    top = rows.filter("row = 0").select(F.col("sheet").alias("_s"), F.col("cells").alias("headers"))
    return rows.filter("row > 0").join(top, F.col("sheet") == F.col("_s")).drop("_s")


def sentences(rows: DataFrame) -> DataFrame:
    """(sheet, row, line): a row's filled cells under their headers; the sheet's name
    ends the line unless it holds the word sheet."""
    cell = lambda c, h: F.when(~blank(c), F.when(blank(h), c).otherwise(F.concat(h, F.lit("："), c)))
    line = F.array_join(F.array_compact(F.zip_with("cells", "headers", cell)), "; ")
    name = F.when(F.contains(F.lower("sheet"), F.lit("sheet")), "").otherwise(F.concat(F.lit(" ——"), "sheet"))
    return headed(rows).select("sheet", "row", line.alias("line")).filter("line <> ''").select("sheet", "row", F.concat("line", name).alias("line"))


def escaped(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def html_chunks(rows: DataFrame, chunk_rows: int = 256) -> DataFrame:
    """(sheet, chunk, html): tables of at most ``chunk_rows`` rows, each with the
    sheet's name and headers."""
    tr = lambda cells, tag: F.concat(F.lit("<tr>"), F.array_join(F.transform(cells, lambda c: F.concat(F.lit(f"<{tag}>"), escaped(F.trim(F.coalesce(c, F.lit("")))), F.lit(f"</{tag}>"))), ""), F.lit("</tr>"))
    own = headed(rows).groupBy("sheet", F.floor((F.col("row") - 1) / chunk_rows).alias("chunk"), "headers").agg(F.array_sort(F.collect_list(F.struct("row", tr(F.col("cells"), "td").alias("tr")))).alias("r"))
    body = F.array_join(F.transform("r", lambda x: x["tr"]), "")
    return own.select("sheet", "chunk", F.concat(F.lit("<table><caption>"), "sheet", F.lit("</caption>"), tr(F.col("headers"), "th"), body, F.lit("</table>\n")).alias("html"))


def markdown(rows: DataFrame) -> DataFrame:
    """(sheet, markdown): cells cleaned of control characters, blank ones empty."""
    clean = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), ILLEGAL, " "))
    line = F.concat(F.lit("| "), F.array_join(F.transform("cells", clean), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.transform("cells", lambda _: F.lit("---")), " | "), F.lit(" |"))
    two = F.when(F.col("row") == 0, F.concat(line, F.lit("\n"), rule)).otherwise(line)
    own = rows.groupBy("sheet").agg(F.array_sort(F.collect_list(F.struct("row", two.alias("l")))).alias("r"))
    return own.select("sheet", F.array_join(F.transform("r", lambda x: x["l"]), "\n").alias("markdown"))


def in_chunks(blocks: DataFrame, key: str = "doc_id", order: str = "pos", tokens: str = "token_count", most: int = 512) -> DataFrame:
    """``blocks`` with ``chunk`` and ``pieces``: a block joins the chunk at hand while
    that keeps within ``most`` tokens. One with more is cut into pieces of ``most``,
    each a chunk of its own, and what follows begins anew."""
    step = "struct<used:bigint,chunk:bigint,open:boolean,out:array<struct<o:bigint,chunk:bigint,pieces:bigint>>>"
    start = F.struct(F.lit(0), F.lit(-1), F.lit(False), F.array()).cast(step)

    def put(s: Column, x: Column) -> Column:
        n, pieces = x["n"], F.ceil(x["n"] / most)
        over = n > most
        joins = ~over & s["open"] & (s["used"] + n <= most)
        chunk = F.when(joins, s["chunk"]).otherwise(s["chunk"] + 1)
        row = F.struct(x["o"].alias("o"), chunk.alias("chunk"), F.when(over, pieces).otherwise(1).cast("long").alias("pieces"))
        used = F.when(over, 0).when(joins, s["used"] + n).otherwise(n)
        return F.struct(used.cast("long").alias("used"), F.when(over, chunk + pieces - 1).otherwise(chunk).cast("long").alias("chunk"), (~over).alias("open"), F.concat(s["out"], F.array(row)).alias("out"))

    rows = F.array_sort(F.collect_list(F.struct(F.col(order).cast("long").alias("o"), F.col(tokens).cast("long").alias("n"))))
    out = blocks.groupBy(key).agg(F.aggregate(rows, start, put, lambda s: s["out"]).alias("_r"))
    return out.select(key, F.inline("_r")).withColumnRenamed("o", order)


def in_parts(rows: DataFrame, key: str, order: str, tokens: str, most: int = 512) -> DataFrame:
    """(key, order, part) of a table's rows: a row that would exceed ``most`` tokens
    begins a new part, even the first one."""
    start = F.struct(F.lit(0), F.lit(0), F.array()).cast("struct<used:bigint,part:bigint,out:array<struct<o:bigint,part:bigint>>>")

    def put(s: Column, x: Column) -> Column:
        new = s["used"] + x["n"] > most
        part = s["part"] + F.when(new, 1).otherwise(0)
        return F.struct(F.when(new, x["n"]).otherwise(s["used"] + x["n"]).cast("long").alias("used"), part.cast("long").alias("part"), F.concat(s["out"], F.array(F.struct(x["o"].alias("o"), part.cast("long").alias("part")))).alias("out"))

    own = F.array_sort(F.collect_list(F.struct(F.col(order).cast("long").alias("o"), F.col(tokens).cast("long").alias("n"))))
    return rows.groupBy(key).agg(F.aggregate(own, start, put, lambda s: s["out"]).alias("_r")).select(key, F.inline("_r")).withColumnRenamed("o", order)


def table_asset(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Delimited rows as one table asset, one block and one chunk a file: (key,
    markdown, n_rows, n_columns, asset_id, block_id, chunk_id)."""
    line = F.concat(F.lit("| "), F.array_join(F.transform("cells", lambda c: F.trim(F.coalesce(c, F.lit("")))), " | "), F.lit(" |"))
    own = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l")))).alias("r"), F.count("*").alias("n_rows"), F.max(F.size("cells")).alias("n_columns"))
    text = F.array_join(F.transform("r", lambda x: x["l"]), "\n")
    out = own.select(key, text.alias("markdown"), "n_rows", "n_columns")
    return out.withColumns({"asset_id": F.concat(F.lit("table-"), F.substring(F.sha2("markdown", 256), 1, 16)), "block_id": F.lit("block-0000"), "chunk_id": F.concat(F.lit("chunk-0000-"), F.substring(F.sha2("markdown", 256), 1, 8))})


def xlsx_rows(files: DataFrame) -> DataFrame:
    """(path, sheet, row, cells) of workbooks (path, content), a file at a time."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from foliant.sources.formats import xlsx

        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                found = [(path, sheet, i, cells) for sheet, rows in xlsx(bytes(content)).items() for i, cells in enumerate(rows)]
                yield pd.DataFrame(found, columns=["path", "sheet", "row", "cells"])

    return files.select("path", "content").mapInPandas(read, "path string, sheet string, row long, cells array<string>")
