"""Merges, assignments and clean-up of boxes on pages, in the order of a document.

Boxes have ``page, x0, x1, top, bottom, text`` and an id ``box_id`` that breaks ties.
Steps whose state runs from box to box are folds over a page's ordered array; a page
is bounded, a document or a table isn't."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Signs with which a line goes on, begins as a continuation, or ends.
GOES_ON, BEGINS_ON, ENDS, HARD_ENDS = ",;:'\"，、‘“；：-", "。；？！?”）),，、：", "。？！?", "。？！!?；;."
LATIN_RUN = r"[ a-zA-Z0-9,/;:'!@#$%&*\"?<>._-]{30,}"


def language_hint(pages: DataFrame, document: str, text: str = "text") -> DataFrame:
    """(document, is_english): whether most pages hold a run of 30 latin signs."""
    hit = F.coalesce(F.rlike(text, F.lit(LATIN_RUN)), F.lit(False))
    return pages.groupBy(document).agg((F.count_if(hit) > F.count("*") / 2).alias("is_english"))


def folded(boxes: DataFrame, fields: str, step, key: str = "page", order: tuple[str, ...] = ("top", "x0", "box_id")) -> DataFrame:
    """A page's boxes folded in order to fewer; ``step(last, box)`` gives (whether they
    join, the joined box), both as structs of ``fields``."""
    names = [f.split(":")[0] for f in fields.split(",")]
    rows = F.array_sort(F.collect_list(F.struct(*order, F.struct(*(F.col(n) for n in names)).cast(f"struct<{fields}>").alias("_b"))))

    def put(out: Column, x: Column) -> Column:
        last, own = F.try_element_at(out, F.lit(-1)), x["_b"]
        joins, one = step(last, own)
        joined = F.struct(*(one.get(n, last[n]).alias(n) for n in names)).cast(f"struct<{fields}>")
        joins = F.coalesce(joins, F.lit(False)) & (F.size(out) > 0)
        return F.when(joins, F.concat(F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(out, F.array(own)))

    made = boxes.groupBy(key).agg(F.aggregate(rows, F.array().cast(f"array<struct<{fields}>>"), put).alias("_r"))
    return made.select(key, F.inline("_r"))


def merged_lines(boxes: DataFrame, mean_height: Column) -> DataFrame:
    """Neighbours in reading order of one page, column and layout whose middles are
    nearer than a third of the page's mean height become one box; tables, figures and
    equations stay apart. Boxes have col_id, layoutno, layout_type."""
    rows = boxes.withColumn("mean_height", mean_height).withColumn("n", F.lit(1))
    fields = "box_id:bigint,x0:double,x1:double,top:double,bottom:double,text:string,col_id:int,layoutno:string,layout_type:string,mean_height:double,n:int"

    def step(a: Column, b: Column):
        far = F.abs((b["top"] + b["bottom"] - a["top"] - a["bottom"]) / 2)
        joins = a["col_id"].eqNullSafe(b["col_id"]) & (a["layoutno"] == b["layoutno"]) & ~F.coalesce(a["layout_type"], F.lit("")).isin("table", "figure", "equation") & (far < a["mean_height"] / 3)
        return joins, {"x1": b["x1"], "top": (a["top"] + b["top"]) / 2, "bottom": (a["bottom"] + b["bottom"]) / 2, "text": F.concat(a["text"], b["text"]), "n": a["n"] + 1}

    return folded(rows, fields, step)


def merged_paragraphs(boxes: DataFrame, mean_height: Column, english: Column) -> DataFrame:
    """Boxes of a page below each other become one where layout, distance (1.5 mean
    heights), overlap (0.3 of the narrower) and signs allow: a line that ends a
    sentence goes on only where signs say so. Blank boxes go."""
    rows = boxes.filter(F.trim("text") != "").withColumns({"mean_height": mean_height, "english": english, "n": F.lit(1)})
    fields = "box_id:bigint,x0:double,x1:double,top:double,bottom:double,text:string,layoutno:string,mean_height:double,english:boolean,n:int"
    has = lambda signs, c: F.instr(F.lit(signs), c) > 0

    def step(a: Column, b: Column):
        up, down = F.trim(a["text"]), F.trim(b["text"])
        last, before, first = F.right(up, F.lit(1)), F.substring(up, -2, 1), F.left(down, F.lit(1))
        over = F.greatest(F.lit(0.0), F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]))
        near = (b["top"] - a["bottom"] <= a["mean_height"] * 1.5) & (over / F.greatest(F.lit(1.0), F.least(a["x1"] - a["x0"], b["x1"] - b["x0"])) >= 0.3)
        goes_on = has(GOES_ON, last) | ((F.length(up) > 1) & has(GOES_ON.replace("-", ""), before)) | has(BEGINS_ON, first)
        ends = has(ENDS, last) | (a["english"] & last.isin(".", "!", "?"))
        joins = a["layoutno"].eqNullSafe(b["layoutno"]) & near & (~ends | goes_on)
        return joins, {"text": F.concat(F.rtrim(a["text"]), F.lit(" "), F.ltrim(b["text"])), "bottom": b["bottom"], "x0": F.least(a["x0"], b["x0"]), "x1": F.greatest(a["x1"], b["x1"]), "n": a["n"] + 1}

    return folded(rows, fields, step)


def continues(up: str, down: str, page_height: Column, mean_height: Column, mean_width: Column, page_width: Column, heading: Column) -> Column:
    """Whether the first box of a page continues the last one of the page before, in
    the same column: text on both, no hard ending, no heading, both at the page's
    edge (3 heights or 8 %), 0.55 of the narrower in common, left edges aligned."""
    u, d = (lambda c: F.col(f"{up}{c}")), (lambda c: F.col(f"{down}{c}"))
    plain = lambda c: F.coalesce(F.lower(F.trim(c)), F.lit("")).isin("", "text", "paragraph", "content", "unknown")
    last = F.right(F.trim(u("text")), F.lit(1))
    band = F.greatest(mean_height * 3.0, page_height * 0.08)
    over = F.greatest(F.lit(0.0), F.least(u("x1"), d("x1")) - F.greatest(u("x0"), d("x0"))) / F.greatest(F.lit(1.0), F.least(u("x1") - u("x0"), d("x1") - d("x0")))
    aligned = F.abs(u("x0") - d("x0")) <= F.greatest(mean_width * 4.0, page_width * 0.08)
    rules = (F.trim(u("text")) != "") & (F.trim(d("text")) != "") & plain(u("layout_type")) & plain(d("layout_type")) & (F.instr(F.lit(HARD_ENDS), last) == 0) & ~heading & u("col_id").eqNullSafe(d("col_id"))
    return F.coalesce(rules & (page_height - u("bottom") <= band) & (d("top") <= band) & (over >= 0.55) & aligned, F.lit(False))


def cross_page(boxes: DataFrame, document: str, page_height: float, mean_height: float, mean_width: float, page_width: float, heading: Column | None = None) -> DataFrame:
    """(document, up_id, down_id): the last box of a page and column and the first of the
    next page that continues it."""
    cols = ("box_id", "x0", "x1", "top", "bottom", "text", "layout_type", "col_id")
    keys = [F.col(document), F.col("page"), F.col("col_id")]
    first = boxes.groupBy(*keys).agg(F.min_by(F.struct(*cols), F.struct("top", "x0", "box_id")).alias("b"))
    last = boxes.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.struct("bottom", "x0", "box_id")).alias("b"))
    up = last.select(F.col(document).alias("_d"), (F.col("page") + 1).alias("_p"), F.col("col_id").alias("_c"), *(F.col(f"b.{c}").alias(f"up_{c}") for c in cols))
    down = first.select(document, "page", *(F.col(f"b.{c}").alias(f"down_{c}") for c in cols))
    both = down.join(up, (F.col(document) == F.col("_d")) & (F.col("page") == F.col("_p")) & F.col("down_col_id").eqNullSafe(F.col("_c")))
    rule = continues("up_", "down_", *(F.lit(float(v)) for v in (page_height, mean_height, mean_width, page_width)), F.lit(False) if heading is None else heading)
    return both.filter(rule).select(document, F.col("up_box_id").alias("up_id"), F.col("down_box_id").alias("down_id"))


def table_chains(tables: DataFrame, document: str, gap: float = 23.0) -> DataFrame:
    """``tables`` (page, top, bottom, x0, x1, mean_height, head, page_height) with
    ``chain``: a table continues the one before it on the page before where the
    distance over the page's end is within ``gap`` mean heights, widths agree to a
    tenth, four fifths of the narrower are in common, and first lines share a word."""
    w = Window.partitionBy(document).orderBy("page", "top", "box_id")
    before = lambda c: F.lag(c).over(w)
    far = F.col("top") + before("page_height") - before("bottom")
    wide, was = F.col("x1") - F.col("x0"), before("x1") - before("x0")
    over = F.least(F.col("x1"), before("x1")) - F.greatest(F.col("x0"), before("x0"))
    fits = (F.abs(wide - was) <= 0.1 * F.greatest(wide, was)) & (over >= 0.8 * F.least(wide, was))
    goes_on = (F.col("page") == before("page") + 1) & (far <= gap * F.col("mean_height")) & fits & F.arrays_overlap("head", before("head"))
    new = F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)
    return tables.withColumn("_new", new).withColumn("chain", F.sum("_new").over(w)).drop("_new")


def chars_inside(chars: DataFrame, boxes: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """Characters within a box of their page, edges let out by ``tolerance``."""
    b = boxes.select(F.col("page").alias("_p"), F.col("box_id").alias("in_box"), *(F.col(c).alias(f"_{c}") for c in ("x0", "x1", "top", "bottom")))
    held = (F.col("x0") >= F.col("_x0") - tolerance) & (F.col("x1") <= F.col("_x1") + tolerance) & (F.col("top") >= F.col("_top") - tolerance) & (F.col("bottom") <= F.col("_bottom") + tolerance)
    return chars.join(b, (F.col("page") == F.col("_p")) & held).select(*chars.columns, "in_box")


def lined_text(chars: DataFrame, lines: DataFrame, least: float = 0.7, named: Column | None = None) -> DataFrame:
    """(line_id, text): each character in the line of its page that holds most of it,
    if their heights are alike (``least``); of equal lines the first. Lines that are
    numbered page by page are told apart by ``named`` (of char_id and line_id)."""
    c = chars.select(F.col("page").alias("_p"), *(F.col(x).alias(f"c_{x}") for x in ("x0", "x1", "top", "bottom")), F.col("box_id").alias("char_id"), F.col("text").alias("char"))
    both = c.join(lines.select("page", "line_id", "x0", "x1", "top", "bottom"), F.col("_p") == F.col("page"))
    w = F.least("c_x1", "x1") - F.greatest("c_x0", "x0")
    h = F.least("c_bottom", "bottom") - F.greatest("c_top", "top")
    own = both.withColumn("_a", F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))).filter("_a > 0")
    a, b = F.col("c_bottom") - F.col("c_top"), F.col("bottom") - F.col("top")
    best = own.groupBy("char_id").agg(F.max_by(F.struct("line_id", "c_x0", "char", (F.least(a, b) / F.greatest(a, b)).alias("alike")), F.struct("_a", -F.col("line_id"))).alias("m")).filter(F.col("m.alike") >= least)
    held = best.select("char_id", "m.line_id", "m.c_x0", "m.char").withColumn("line_id", F.col("line_id") if named is None else named)
    return held.groupBy("line_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_x0", "char_id", "char"))), lambda x: x["char"]), "").alias("text"))


def table_tags(boxes: DataFrame, parts: DataFrame, least: float = 0.3) -> DataFrame:
    """``boxes`` with the number of the row, header, column and span that hold most of
    each (parts: page, kind, no and edges), null where none holds ``least``."""
    p = parts.select(F.col("page").alias("_p"), "kind", "no", *(F.col(c).alias(f"_{c}") for c in ("x0", "x1", "top", "bottom")))
    both = boxes.join(p, F.col("page") == F.col("_p"))
    w = F.greatest(F.least("x1", "_x1") - F.greatest("x0", "_x0"), F.lit(0.0))
    h = F.greatest(F.least("bottom", "_bottom") - F.greatest("top", "_top"), F.lit(0.0))
    share = w * h / F.greatest((F.col("x1") - F.col("x0")) * (F.col("bottom") - F.col("top")), F.lit(1e-9))
    own = both.withColumn("_s", share).filter(F.col("_s") >= least)
    tags = own.groupBy("box_id").agg(*(F.max_by(F.when(F.col("kind") == k, F.col("no")), F.when(F.col("kind") == k, F.struct("_s", -F.col("no")))).alias(k) for k in ("row", "header", "column", "span")))
    return boxes.join(tags, "box_id", "left")


def inserted(boxes: DataFrame, assets: DataFrame) -> DataFrame:
    """(page, box_id, asset_id, place): assets set beside the box of their page with
    the least distance between rectangles, behind it if it ends above the asset."""
    a = assets.select(F.col("page").alias("_p"), "asset_id", *(F.col(c).alias(f"_{c}") for c in ("x0", "x1", "top", "bottom")))
    w = Window.partitionBy("page").orderBy("top", "x0", "box_id")
    rows = boxes.select("page", "box_id", "x0", "x1", "top", "bottom", (F.row_number().over(w) * 2).alias("_at"))
    dx = F.greatest(F.col("_x0") - F.col("x1"), F.col("x0") - F.col("_x1"), F.lit(0.0))
    dy = F.greatest(F.col("_top") - F.col("bottom"), F.col("top") - F.col("_bottom"), F.lit(0.0))
    behind = F.when(F.col("bottom") < F.col("_top"), 1).otherwise(-1)
    near = a.join(rows, F.col("_p") == F.col("page")).groupBy("page", "asset_id").agg(F.min_by(F.col("_at") + behind, F.struct(dx * dx + dy * dy, "_at")).alias("_at"))
    all_ = rows.select("page", "box_id", F.lit(None).cast("long").alias("asset_id"), "_at").unionByName(near.select("page", F.lit(None).cast("long").alias("box_id"), "asset_id", "_at"))
    return all_.withColumn("place", F.row_number().over(Window.partitionBy("page").orderBy("_at", "asset_id"))).drop("_at")


def iou(a: Column, b: Column) -> Column:
    w = F.greatest(F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]), F.lit(0.0))
    h = F.greatest(F.least(a["bottom"], b["bottom"]) - F.greatest(a["top"], b["top"]), F.lit(0.0))
    area = lambda r: (r["x1"] - r["x0"]) * (r["bottom"] - r["top"])
    both = w * h
    return F.when(both > 0, both / (area(a) + area(b) - both)).otherwise(0.0)


def distinct_codes(found: DataFrame, least: float = 0.8) -> DataFrame:
    """Detections (page, kind, text, no and edges) of which no earlier one kept has the
    same kind and text at the same place: equal edges, or an overlap of ``least``."""
    keys = ["page", "kind", "text"]
    box = F.struct("no", *(F.col(c).cast("double").alias(c) for c in ("x0", "x1", "top", "bottom")))

    def put(out: Column, x: Column) -> Column:
        same = lambda o: (F.struct(*(F.round(o[c]) for c in ("x0", "x1", "top", "bottom"))) == F.struct(*(F.round(x[c]) for c in ("x0", "x1", "top", "bottom")))) | (iou(o, x) >= least)
        return F.when(F.exists(out, same), out).otherwise(F.concat(out, F.array(x)))

    rows = found.filter(F.trim("text") != "").groupBy(*keys).agg(F.array_sort(F.collect_list(box)).alias("r"))
    empty = F.array().cast("array<struct<no:bigint,x0:double,x1:double,top:double,bottom:double>>")
    return rows.select(*keys, F.inline(F.aggregate(F.transform("r", lambda x: x.cast("struct<no:bigint,x0:double,x1:double,top:double,bottom:double>")), empty, put)))


def retained(old: DataFrame, new: DataFrame, pages: DataFrame) -> DataFrame:
    """Boxes of ``old`` on the retained ``pages`` and of ``new`` on all others."""
    return old.join(pages, "page", "left_semi").unionByName(new.join(pages, "page", "left_anti"))


def seeded(boxes: DataFrame, seeds: DataFrame, pages: DataFrame, height: float = 10.0, width: float = 8.0) -> DataFrame:
    """(page, n, mean_height, mean_width) of ``pages`` after boxes of pages without any
    come from ``seeds``; a median that is missing or 0 has the default."""
    rows = boxes.unionByName(seeds.join(boxes.select("page").distinct(), "page", "left_anti"))
    m = rows.groupBy(F.col("page").alias("_p")).agg(F.count("*").alias("n"), F.median(F.col("bottom") - F.col("top")).alias("h"), F.median(F.col("x1") - F.col("x0")).alias("w"))
    filled = lambda c, d: F.coalesce(F.when(F.col(c) != 0, F.col(c)), F.lit(d))
    return pages.join(m, F.col("page") == F.col("_p"), "left").select("page", F.coalesce("n", F.lit(0)).alias("n"), filled("h", height).alias("mean_height"), filled("w", width).alias("mean_width"))


def routed_blocks(boxes: DataFrame, routes: DataFrame) -> DataFrame:
    """Boxes with text as blocks of kind text, with the route of their page."""
    r = routes.select(F.col("page").alias("_p"), "route")
    kept = boxes.filter(F.trim(F.coalesce("text", F.lit(""))) != "")
    return kept.join(r, F.col("page") == F.col("_p"), "left").select("page", "box_id", F.lit("text").alias("block_type"), F.trim("text").alias("text"), F.coalesce("route", F.lit("unknown")).alias("route"))


def chapter_blocks(parts: DataFrame) -> DataFrame:
    """Blocks of a book's chapters: the page is the chapter plus one, tables name an
    asset; empty ones go (chapter, kind, text)."""
    body = F.trim(F.coalesce("text", F.lit("")))
    ref = F.when(F.col("kind") == "table", F.concat(F.lit("table-"), F.substring(F.sha2(body, 256), 1, 16)))
    kind = F.when(F.col("kind").isin("title", "table", "list"), F.col("kind")).otherwise("text")
    return parts.filter(body != "").withColumns({"page": F.col("chapter") + 1, "block_type": kind, "text": body, "asset_ref": ref})


def image_blocks(boxes: DataFrame, codes: DataFrame, image_id: str = "image-0") -> DataFrame:
    """Blocks of a picture: lines read on it, all of which refer to the picture, then
    its codes, which refer to themselves. Visual kinds are text here."""
    kind = F.lower(F.trim(F.coalesce("layout_type", F.lit(""))))
    lines = boxes.filter(F.trim("text") != "").select("page", F.lit(0).alias("_k"), F.col("box_id").alias("source_id"), F.when(kind.isin("title", "list", "reference", "unknown"), kind).otherwise("text").alias("block_type"), F.trim("text").alias("text"), F.lit(image_id).alias("asset_ref"))
    own = codes.filter((F.trim("text") != "") & F.col("x0").isNotNull()).select("page", F.lit(1).alias("_k"), F.col("no").alias("source_id"), F.lit("barcode").alias("block_type"), F.trim("text").alias("text"), F.concat(F.lit("barcode-"), "no").alias("asset_ref"))
    no = F.row_number().over(Window.partitionBy("page").orderBy("_k", "source_id")) - 1
    return lines.unionByName(own).withColumn("block_id", F.format_string("block-%04d", no)).drop("_k")
