"""Boxes on pages: spatial joins, reading order, merges, columns and tables.

A box has ``page, x0, x1, top, bottom`` (points, top-down) and ``text``. Joins
are on the page, so no step compares boxes of different pages."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cmp_to_key

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def area(p: str = "") -> Column:
    return F.greatest(F.col(f"{p}x1") - F.col(f"{p}x0"), F.lit(0.0)) * F.greatest(F.col(f"{p}bottom") - F.col(f"{p}top"), F.lit(0.0))


def common(p: str, q: str) -> Column:
    """Area that two boxes of a joined row share."""
    w = F.least(F.col(f"{p}x1"), F.col(f"{q}x1")) - F.greatest(F.col(f"{p}x0"), F.col(f"{q}x0"))
    h = F.least(F.col(f"{p}bottom"), F.col(f"{q}bottom")) - F.greatest(F.col(f"{p}top"), F.col(f"{q}top"))
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def share(p: str, q: str) -> Column:
    """Of box p, the share that lies in box q."""
    return F.when(area(p) > 0, common(p, q) / area(p)).otherwise(0.0)


def prefixed(df: DataFrame, p: str) -> DataFrame:
    return df.withColumnsRenamed({c: f"{p}{c}" for c in df.columns})


def best_layout(boxes: DataFrame, layouts: DataFrame, least: float = 0.4, last_wins: bool = True) -> DataFrame:
    """(box_id, layout_id, inside) of the layout that holds most of each box; of
    equals the one that the box fills most, then the last (or the first) id."""
    b, y = prefixed(boxes, "b_"), prefixed(layouts, "l_")
    both = b.join(y, F.col("b_page") == F.col("l_page")).withColumn("inside", share("b_", "l_")).withColumn("filled", share("l_", "b_")).filter(F.col("inside") >= least)
    tie = F.col("l_layout_id") if last_wins else -F.col("l_layout_id")
    return both.groupBy(F.col("b_box_id").alias("box_id")).agg(F.max_by(F.struct(F.col("l_layout_id").alias("layout_id"), "inside"), F.struct("inside", "filled", tie)).alias("m")).select("box_id", "m.layout_id", "m.inside")


def nearest(captions: DataFrame, assets: DataFrame, most_gap: Column) -> DataFrame:
    """(box_id, layout_id) of the asset nearest to each caption: x overlap of at
    least 0.15 of the narrower, vertical gap within ``most_gap``."""
    c, a = prefixed(captions, "b_"), prefixed(assets, "l_")
    both = c.join(a, F.col("b_page") == F.col("l_page"))
    over = (F.least("b_x1", "l_x1") - F.greatest("b_x0", "l_x0")) / F.least(F.col("b_x1") - F.col("b_x0"), F.col("l_x1") - F.col("l_x0"))
    gap = F.greatest(F.col("l_top") - F.col("b_bottom"), F.col("b_top") - F.col("l_bottom"), F.lit(0.0))
    near = both.withColumn("gap", gap).filter((over >= 0.15) & (F.col("gap") <= most_gap))
    return near.groupBy(F.col("b_box_id").alias("box_id")).agg(F.min_by("l_layout_id", F.struct("gap", "l_layout_id")).alias("layout_id"))


def uncovered(boxes: DataFrame, regions: DataFrame, least: float = 0.5) -> DataFrame:
    """Boxes without a region that holds ``least`` of them."""
    held = best_layout(boxes, regions, least).select("box_id")
    return boxes.join(held, "box_id", "left_anti")


def reading_order(boxes: DataFrame, columns: bool = False) -> DataFrame:
    """``boxes`` with their place on the page: by (column,) top and left."""
    order = (["col_id"] if columns else []) + ["top", "x0", "box_id"]
    return boxes.withColumn("place", F.row_number().over(Window.partitionBy("page").orderBy(*order)))


def page_offsets(pages: DataFrame, height: str = "height", doc: str = "doc") -> DataFrame:
    """``pages`` with the summed height of the pages before."""
    w = Window.partitionBy(doc).orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    return pages.withColumn("offset", F.coalesce(F.sum(height).over(w), F.lit(0.0)))


def distinct_words(boxes: DataFrame) -> DataFrame:
    """One of the boxes with equal text and coordinates to two places: the least id."""
    keys = [F.round(c, 2) for c in ("x0", "x1", "top", "bottom")]
    return boxes.groupBy("page", "text", *keys).agg(F.min_by(F.struct(*boxes.columns), "box_id").alias("_b")).select("_b.*")


def margin(boxes: DataFrame, page_height: Column, mean_height: Column) -> Column:
    """Whether a box lies within the margin band of its page."""
    band = F.greatest(mean_height * 2, page_height * 0.06)
    return ((F.col("top") <= band) | (F.col("bottom") >= page_height - band)) & (F.length("text") >= 3)


def without_repeated(boxes: DataFrame, is_margin: Column, least_pages: int = 2, doc: str = "doc") -> DataFrame:
    """``boxes`` without margin texts that stand on several pages."""
    key = F.lower(F.regexp_replace("text", r"[\s\-–—]+", ""))
    rows = boxes.withColumn("_key", key).withColumn("_m", is_margin)
    often = rows.filter("_m").select(doc, "_key", "page").distinct().groupBy(doc, "_key").count().filter(F.col("count") >= least_pages).select(doc, "_key", F.lit(True).alias("_often"))
    return rows.join(often, [doc, "_key"], "left").filter(~(F.col("_m") & F.coalesce("_often", F.lit(False)))).drop("_key", "_m", "_often")


def islands(df: DataFrame, keys: list[str], order: list[str], joins: Column) -> DataFrame:
    """``df`` with ``island``: a row for which ``joins`` (over the row and its lag)
    holds continues the one before it."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_new", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)).withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def page_route(features: DataFrame) -> DataFrame:
    """Page features with ``route`` (clean, mixed or scanned) and ``scope``."""
    text = (F.col("chars") >= 80) & (F.col("font_share") >= 0.8)
    large = F.col("max_image_share") >= 0.85
    route = F.when(text & ~large & (F.col("image_share") < 0.3), "clean").when(~text & (large | (F.col("chars") < 20)), "scanned").otherwise("mixed")
    out = features.withColumn("route", route)
    return out.withColumn("scope", F.when(F.col("route") == "clean", "native_only").when(F.col("route") == "scanned", "full_page").otherwise("complex_only"))


def iou(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Shares of the union for (x0, top, x1, bottom) of boxes, one and many or pair by pair."""
    w = np.minimum(a[..., 2], b[..., 2]) - np.maximum(a[..., 0], b[..., 0])
    h = np.minimum(a[..., 3], b[..., 3]) - np.maximum(a[..., 1], b[..., 1])
    both = np.clip(w, 0, None) * np.clip(h, 0, None)
    size = lambda x: (x[..., 2] - x[..., 0]) * (x[..., 3] - x[..., 1])
    return both / np.maximum(size(a) + size(b) - both, 1e-9)


def _whole(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(rows, starts of their groups) from rows sorted by ``keys``, many whole groups at
    a time. Nulls are equal, and so are numbers that are none."""
    held: list[pa.RecordBatch] = []
    for last, batch in _last_told(batches):
        before = [held[-1].slice(held[-1].num_rows - 1)] if held else []
        if batch.num_rows or not held:
            held.append(batch)
        if not last and len(_starts(pa.Table.from_batches([*before, batch]), keys)) < 2:
            continue
        rows = pa.Table.from_batches(held).combine_chunks()
        starts = _starts(rows, keys)
        if not last:
            held = rows.slice(int(starts[-1])).to_batches()
            rows, starts = rows.slice(0, int(starts[-1])), starts[:-1]
        if len(starts):
            yield rows, starts


def _starts(rows: pa.Table, keys: list[str]) -> np.ndarray:
    """Where the groups of rows with equal ``keys`` start."""
    new = np.arange(rows.num_rows) == 0
    for k in keys:
        c = rows.column(k).combine_chunks()
        a, b = c[:-1], c[1:]
        other = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b)))
        if pa.types.is_floating(c.type):
            other = pc.and_not(other, pc.fill_null(pc.and_(pc.is_nan(a), pc.is_nan(b)), False))
        new[1:] |= other.to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def _by_groups(boxes: DataFrame, keys: list[str], one: Callable[[pa.Table, np.ndarray], pa.Table], out: StructType) -> DataFrame:
    """``one`` over the groups of ``boxes`` as ``_whole`` gives them: dealt by a hash and
    streamed in order, many to a task; a group is held as a whole."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in _whole(batches, keys):
            yield from one(rows, starts).to_batches(max_chunksize=100_000)

    # A stated number, as small inputs would otherwise be put into one task.
    n = int(boxes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return boxes.repartition(n, *keys).sortWithinPartitions(*keys).mapInArrow(each, out)


def _column(rows: pa.Table, name: str) -> np.ndarray:
    """A column as numbers, nulls as NaN."""
    return rows.column(name).to_numpy()


def _ordered(rows: pa.Table, group: np.ndarray, keys: list[pa.ChunkedArray]) -> np.ndarray:
    """The order of ``rows`` by group and ``keys``, nulls last; equal ones by their edges."""
    edges = [rows.column(c) for c in ("x0", "top", "x1", "bottom") if c in rows.column_names]

    def plain(c: pa.ChunkedArray) -> np.ndarray:
        if pa.types.is_floating(c.type) or (pa.types.is_integer(c.type) and not c.null_count):
            return c.to_numpy()
        return pc.rank(c.combine_chunks(), "ascending", null_placement="at_end", tiebreaker="dense").to_numpy()

    return np.lexsort([plain(c) for c in reversed([*keys, *edges])] + [group])


def suppressed(boxes: DataFrame, most: float = 0.45, keys: tuple[str, ...] = ("page", "kind")) -> DataFrame:
    """Non-maximum suppression: by falling score, without those that overlap a kept one.
    Each round takes the first live box of every group and drops what overlaps it."""

    def kept(rows: pa.Table, starts: np.ndarray) -> pa.Table:
        group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, rows.num_rows)))
        order = _ordered(rows, group, [pc.negate(rows.column("score").cast(pa.float64())), rows.column("box_id")])
        xy = np.stack([_column(rows, c).astype(float) for c in ("x0", "top", "x1", "bottom")], 1)[order]
        group = group[order]
        live, out = np.arange(len(order)), []
        while len(live):
            first = np.flatnonzero(np.diff(group[live], prepend=-1))
            out.append(live[first])
            rest = np.ones(len(live), bool)
            rest[first] = False
            lead = np.repeat(live[first], np.diff(np.append(first, len(live))))[rest]
            live = live[rest]
            live = live[iou(xy[lead], xy[live]) <= most]
        return rows.take(order[np.sort(np.concatenate(out))])

    return _by_groups(boxes, list(keys), kept, boxes.schema)


def by_rows(boxes: DataFrame, threshold: float) -> DataFrame:
    """``boxes`` with ``place``: by top, but by left among those whose tops differ by
    less than ``threshold``. That comparison isn't transitive, so the rows of a
    page are sorted by it as it is, from the order of ids."""

    def placed(rows: pa.Table, starts: np.ndarray) -> pa.Table:
        ends = np.append(starts[1:], rows.num_rows)
        first = _ordered(rows, np.repeat(np.arange(len(starts)), ends - starts), [rows.column("box_id")])
        t, x = (_column(rows, c)[first].tolist() for c in ("top", "x0"))

        def compared(i: int, j: int) -> int:
            a, b = (x[i], x[j]) if abs(t[i] - t[j]) < threshold else (t[i], t[j])
            return (a > b) - (a < b)

        key, order = cmp_to_key(compared), []
        for a, z in zip(starts.tolist(), ends.tolist(), strict=True):
            order += sorted(range(a, z), key=key) if z - a > 1 else (a,)
        place = np.arange(1, rows.num_rows + 1) - np.repeat(starts, ends - starts)
        return rows.take(first[np.array(order, np.int64)]).append_column("place", pa.array(place, pa.int32()))

    return _by_groups(boxes, ["page"], placed, boxes.select("*", F.lit(1).alias("place")).schema)


def _best_cuts(x: np.ndarray, w: np.ndarray, most: int) -> list[np.ndarray]:
    """For 1, 2 ... ``most`` clusters of sorted values with weights the cluster of each
    value in the division with the least squares."""
    n, sums = len(x), [np.concatenate([[0.0], np.cumsum(v)]) for v in (w, w * x, w * x * x)]
    m, s, q = (v[None, :] - v[:, None] for v in sums)
    cost = np.where(m > 0, q - s * s / np.where(m > 0, m, 1), np.inf)
    best, back, out = cost[0], [], [np.zeros(n, int)]
    for k in range(2, min(most, n) + 1):
        total = best[:, None] + cost
        back.append(total.argmin(0))
        best = total.min(0)
        own, end = np.empty(n, int), n
        for c in range(k - 1, 0, -1):
            start = int(back[c - 1][end])
            own[start:end] = c
            end = start
        own[:end] = 0
        out.append(own)
    return out


def _silhouette(x: np.ndarray, w: np.ndarray, own: np.ndarray) -> float:
    """The mean silhouette of values with weights; a cluster of one counts 0."""
    each = (own[:, None] == np.arange(own.max() + 1)) * w[:, None]
    n = each.sum(0)
    far = np.abs(x[:, None] - x[None, :]) @ each
    rows = np.arange(len(x))
    a = far[rows, own] / np.maximum(n[own] - 1, 1)
    mean = far / n
    mean[rows, own] = np.inf
    b = mean.min(1)
    s = np.where(n[own] > 1, (b - a) / np.maximum(np.maximum(a, b), 1e-12), 0.0)
    return float((s * w).sum() / w.sum())


def columns_of(x0: np.ndarray, x1: np.ndarray, most: int = 4, indent: float = 0.12) -> np.ndarray:
    """The column of each box of a page. Left edges nearer to the leftmost than
    ``indent`` of the page's width count as it when the number of columns is chosen
    by the best silhouette; the edges themselves are then divided into as many."""
    low = x0.min()
    snapped = np.where(np.abs(x0 - low) < (x1.max() - low) * indent, low, x0)
    value, weight = np.unique(snapped, return_counts=True)
    best, k = 0.0, 1
    if len(value) > 1:
        for own in _best_cuts(value, weight, min(most, len(x0)))[1:]:
            if own.max() + 1 < len(x0) and (score := _silhouette(value, weight, own)) > best + 1e-12:
                best, k = score, int(own.max()) + 1
    value, place, weight = np.unique(x0, return_inverse=True, return_counts=True)
    return _best_cuts(value, weight, k)[min(k, len(value)) - 1][place]


def columned(boxes: DataFrame, most: int = 4, indent: float = 0.12) -> DataFrame:
    """``boxes`` with ``col_id``, from ``columns_of`` each page. Pages are dealt by a
    hash and streamed in order, many to a task; a page is held as a whole."""

    def pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for last, batch in _last_told(batches):
            held.append(batch)
            page = batch["page"].to_numpy()
            if not last and (not len(page) or page[0] == page[-1]):
                continue
            rows = pd.concat(held, ignore_index=True)
            page = rows["page"].to_numpy()
            cut = np.flatnonzero(page[1:] != page[:-1]) + 1
            upto = len(rows) if last else int(cut[-1])
            held = [rows.iloc[upto:]]
            starts = [0, *cut[cut < upto].tolist()]
            x0, x1 = (rows[c].to_numpy(float) for c in ("x0", "x1"))
            own = [columns_of(x0[a:z], x1[a:z], most, indent) for a, z in zip(starts, [*starts[1:], upto], strict=True)] if upto else []
            yield rows.iloc[:upto].assign(col_id=np.concatenate(own).astype(np.int32) if own else np.zeros(0, np.int32))

    # A stated number, as small inputs would otherwise be put into one task.
    n = int(boxes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = boxes.repartition(n, "page").sortWithinPartitions("page")
    return dealt.mapInPandas(pages, boxes.select("*", F.lit(0).alias("col_id")).schema)


def _last_told(items: Iterator) -> Iterator[tuple[bool, object]]:
    """(whether it is the last, item)."""
    none = object()
    before = none
    for x in items:
        if before is not none:
            yield False, before
        before = x
    if before is not none:
        yield True, before


def lines(words: DataFrame) -> DataFrame:
    """(page, line, text, n_words): words in the order of top and left edge joined to
    lines. A word goes to the last line if its middle is within max(2, 0.35 times the
    line's greatest height) of that of the line's first word, else it opens one;
    blank words are left out."""
    kept = words.withColumn("text", F.trim("text")).filter("text <> ''")
    rows = kept.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("top", "x0", "box_id", "bottom", "text"))).alias("words"))
    line = "array<struct<mid:double,height:double,text:string,n_words:int>>"

    def step(out: Column, w: Column) -> Column:
        mid, height, last = (w["top"] + w["bottom"]) / 2, w["bottom"] - w["top"], F.try_element_at(out, F.lit(-1))
        near = F.coalesce(F.abs(mid - last["mid"]) <= F.greatest(F.lit(2.0), last["height"] * 0.35), F.lit(False))
        more = F.struct(last["mid"].alias("mid"), F.greatest(last["height"], height).alias("height"), F.concat_ws(" ", last["text"], w["text"]).alias("text"), (last["n_words"] + 1).alias("n_words"))
        new = F.struct(mid.alias("mid"), height.alias("height"), w["text"].alias("text"), F.lit(1).alias("n_words"))
        return F.when(near, F.concat(F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))), F.array(more))).otherwise(F.concat(out, F.array(new)))

    made = rows.select("page", F.posexplode(F.aggregate("words", F.array().cast(line), step)).alias("line", "l"))
    return made.select("page", "line", "l.text", "l.n_words")


def grid(cells: Iterator[dict], tall: float = 0.5) -> list[list[str]]:
    """Boxes of one table as rows of texts: rows by middles, columns by the left
    edges that the rows share."""
    boxes = sorted(cells, key=lambda c: ((c["top"] + c["bottom"]) / 2, c["x0"]))
    rows: list[list[dict]] = []
    for c in boxes:
        mid, h = (c["top"] + c["bottom"]) / 2, c["bottom"] - c["top"]
        if rows and abs(mid - np.mean([(q["top"] + q["bottom"]) / 2 for q in rows[-1]])) <= tall * h:
            rows[-1].append(c)
        else:
            rows.append([c])
    edges: list[float] = []
    for x in sorted(c["x0"] for c in boxes):
        if not edges or x - edges[-1] > 10:
            edges.append(x)
    out = [["" for _ in edges] for _ in rows]
    for i, row in enumerate(rows):
        for c in sorted(row, key=lambda q: q["x0"]):
            j = max(k for k, e in enumerate(edges) if e <= c["x0"] + 1e-9)
            out[i][j] = f"{out[i][j]} {c['text']}".strip()
    return out


def grid_html(rows: list[list[str]], headers: int = 1) -> str:
    """A grid as an HTML table; empty cells to the right widen the one before."""
    import html

    out = []
    for i, row in enumerate(rows):
        tag, cells, j = "th" if i < headers else "td", [], 0
        while j < len(row):
            wide = 1
            while i < headers and j + wide < len(row) and row[j] and not row[j + wide]:
                wide += 1
            span = f" colspan={wide}" if wide > 1 else ""
            cells.append(f"<{tag}{span}>{html.escape(row[j])}</{tag}>")
            j += wide
        out.append("<tr>" + "".join(cells) + "</tr>")
    return "<table>" + "".join(out) + "</table>"


def grid_sentences(rows: list[list[str]], headers: int = 1) -> list[str]:
    """A grid as lines of ``header：value`` pairs."""
    names = [" ".join(dict.fromkeys(r[j] for r in rows[:headers] if r[j])) for j in range(len(rows[0]))] if rows else []
    return ["; ".join(f"{n}：{v}" if n else v for n, v in zip(names, row, strict=True) if v) for row in rows[headers:]]
