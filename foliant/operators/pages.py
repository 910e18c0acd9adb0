"""Features of pages, modes, orientation, and profiles of persons, as aggregates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def text_layer(pages: DataFrame, document: str, chars: str, least_chars: int = 80, least_share: float = 0.5) -> DataFrame:
    """(document, chars, per_page, text_share, layer): a document has a text layer if
    its pages hold enough characters on average and enough of them do themselves."""
    n = F.greatest(F.count("*"), F.lit(1))
    out = pages.groupBy(document).agg(F.sum(chars).alias("chars"), (F.sum(chars) / n).alias("per_page"), (F.count_if(F.col(chars) >= least_chars) / n).alias("text_share"))
    return out.withColumn("layer", F.when((F.col("per_page") >= least_chars) & (F.col("text_share") >= least_share), "text").otherwise("image"))


def image_features(images: DataFrame, page_area: float, large: float = 0.1) -> DataFrame:
    """(page, image_share, max_image_share, has_large) of pages' pictures; shares of the
    page are cut at 1."""
    share = (F.col("x1") - F.col("x0")) * (F.col("bottom") - F.col("top"))
    out = images.groupBy("page").agg(F.sum(share).alias("_s"), F.max(share).alias("_m"))
    return out.select("page", F.least(F.col("_s") / page_area, F.lit(1.0)).alias("image_share"), F.least(F.col("_m") / page_area, F.lit(1.0)).alias("max_image_share"), (F.col("_m") / page_area >= large).alias("has_large"))


def first_mode(rows: DataFrame, keys: Sequence[str], kind: str, order: str) -> DataFrame:
    """The commonest ``kind`` of each key; of equals the one seen first."""
    each = rows.groupBy(*keys, kind).agg(F.count("*").alias("_n"), F.min(order).alias("_f"))
    return each.groupBy(*keys).agg(F.max_by(kind, F.struct("_n", -F.col("_f"))).alias("kind"))


def totals_by_day(rows: DataFrame, at: str, sizes: Sequence[str]) -> DataFrame:
    """(day, n, and the sum of each of ``sizes``)."""
    return rows.groupBy(F.to_date(at).alias("day")).agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in sizes))


def tightest(boxes: DataFrame, columns: DataFrame) -> DataFrame:
    """(box_id, column_id): of the columns in a box's own layout the one whose left edge,
    right edge or middle is nearest; of equals the first."""
    c = columns.select(F.col("page").alias("_p"), F.col("layoutno").alias("_l"), "column_id", F.col("x0").alias("_x0"), F.col("x1").alias("_x1"))
    both = boxes.join(c, (F.col("page") == F.col("_p")) & F.col("layoutno").eqNullSafe(F.col("_l")))
    far = F.least(F.abs(F.col("x0") - F.col("_x0")), F.abs(F.col("x1") - F.col("_x1")), F.abs(F.col("x0") + F.col("x1") - F.col("_x0") - F.col("_x1")) / 2)
    return both.groupBy("box_id").agg(F.min_by("column_id", F.struct(far, "column_id")).alias("column_id"))


def nearest_region(captions: DataFrame, regions: DataFrame) -> DataFrame:
    """(box_id, region_id): the region of a caption's page whose middle is nearest."""
    mid = lambda a, z: (F.col(a) + F.col(z)) / 2
    r = regions.select(F.col("page").alias("_p"), "region_id", mid("x0", "x1").alias("_x"), mid("top", "bottom").alias("_y"))
    far = (mid("x0", "x1") - F.col("_x")) ** 2 + (mid("top", "bottom") - F.col("_y")) ** 2
    return captions.join(r, F.col("page") == F.col("_p")).groupBy("box_id").agg(F.min_by("region_id", F.struct(far, "region_id")).alias("region_id"))


def page_neighbours(blocks: DataFrame, key: str, window: int = 1) -> DataFrame:
    """(key, pos, near_pos): visual blocks within ``window`` places that share a page with
    a block that isn't visual, or where the page of either isn't known."""
    visual = blocks.filter("visual").select(F.col(key).alias("_k"), F.col("pos").alias("near_pos"), F.col("pages").alias("_pages"))
    near = (F.col("pos") != F.col("near_pos")) & (F.abs(F.col("pos") - F.col("near_pos")) <= window)
    shared = (F.size("pages") == 0) | (F.size("_pages") == 0) | F.arrays_overlap("pages", "_pages")
    return blocks.filter("NOT visual").join(visual, (F.col(key) == F.col("_k")) & near & shared).select(key, "pos", "near_pos")


def keep_latest(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """Rows beyond the ``n`` first of each key in an order; those are what goes."""
    from pyspark.sql import Window

    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_rn") > n).drop("_rn")


def best_orientation(reads: DataFrame, keys: Sequence[str], angle: str, confidence: str, margin: float = 0.2, upright: int = 0) -> DataFrame:
    """(keys, angle, score): the angle of the greatest mean confidence, weighed up by
    the number of lines (to 50) by a tenth; upright unless another one's score is
    greater by ``margin``. Of equals the least angle."""
    score = F.avg(confidence) * (1 + 0.1 * F.least(F.count("*"), F.lit(50)) / 50.0)
    each = reads.groupBy(*keys, angle).agg(F.round(score, 9).alias("_s"))
    best = each.groupBy(*keys).agg(F.max_by(F.struct(F.col(angle).alias("angle"), F.col("_s").alias("score")), F.struct("_s", -F.col(angle))).alias("b"), F.max(F.when(F.col(angle) == upright, F.col("_s"))).alias("_u"))
    turned = F.col("_u").isNull() | (F.col("b.score") - F.col("_u") > margin)
    return best.select(*keys, F.when(turned, F.col("b.angle")).otherwise(upright).alias("angle"), F.when(turned, F.col("b.score")).otherwise(F.col("_u")).alias("score"))


def work_facts(jobs: DataFrame, person: str, as_of: Column) -> DataFrame:
    """(person, n_jobs, mean_days, most_scale, first_at, highest) of a person's jobs
    (start, end or null: still on, scale, degree_rank, degree); reversed spans count 0."""
    days = F.greatest(F.datediff(F.coalesce("end", as_of), "start"), F.lit(0))
    return jobs.groupBy(person).agg(F.count("*").alias("n_jobs"), F.avg(days).alias("mean_days"), F.max("scale").alias("most_scale"), F.min("start").alias("first_at"), F.max_by("degree", F.struct("degree_rank", "degree")).alias("highest"))


def completeness(fields: Mapping[str, Column], needed: Sequence[str], penalty: float = 0.5) -> Column:
    """The share of fields that are filled (not null, not blank); it is weighed down by
    ``penalty`` if a needed one isn't."""
    filled = {n: F.coalesce(F.trim(c.cast("string")) != "", F.lit(False)) for n, c in fields.items()}
    share = sum((c.cast("int") for c in list(filled.values())[1:]), next(iter(filled.values())).cast("int")) / len(filled)
    all_there = F.forall(F.array(*(filled[n] for n in needed)), lambda x: x)
    return share * F.when(all_there, 1.0).otherwise(penalty)


def readiness(gates: DataFrame) -> DataFrame:
    """(ready, n, failed) of gates (name, needed, passed): all that are needed pass."""
    needed = gates.filter("needed")
    return needed.agg(F.coalesce(F.bool_and("passed"), F.lit(False)).alias("ready"), F.count("*").alias("n"), F.array_sort(F.collect_list(F.when(~F.col("passed"), F.col("name")))).alias("failed"))


def input_verdict(name: Column, size: Column, known: Sequence[str], most: int = 100 << 20) -> Column:
    """Why a file isn't taken, or ok: no name, no type, unknown type, empty, too large."""
    ext = F.lower(F.element_at(F.split(name, r"\."), -1))
    return (
        F.when(F.coalesce(F.trim(name), F.lit("")) == "", "no_name").when(~F.contains(name, F.lit(".")) | (ext == ""), "no_type").when(~ext.isin(*known), "unknown_type")
        .when(F.coalesce(size, F.lit(0)) <= 0, "empty").when(size > most, "too_large").otherwise("ok")
    )


#: Versions that exported records must carry.
VERSIONS = {"chunk": "chunk-export.v1", "ingest": "ingest-export.v1", "context": "asset-context.v1", "summary": "asset-summary.v1"}
CONTEXT_LISTS = ("direct_block_refs", "context_block_refs", "direct_chunk_refs", "context_chunk_refs", "chunk_refs")


def quality_report(parses: DataFrame, versions: Mapping[str, str] = VERSIONS) -> DataFrame:
    """(parse_id, label, problem) of every rule that a parse breaks.

    A parse has manifest (parse_id, chunk_count; null: missing), block_ids, chunk_ids
    and asset_ids as arrays, and arrays of structs: assets (asset_id, context), chunks
    (chunk_id, text, block_refs, asset_refs, strategy), chunk_records (chunk_id, text,
    schema_version, strategy, assets) and ingest_records (record_id, text,
    schema_version, chunk_schema_version), null where the file is missing. A context
    has its schema version, five lists of references, texts, and the summary with its
    version, source and facts."""
    empty = F.array().cast("array<struct<label:string,problem:string>>")
    hit = lambda label, problem, bad: F.when(F.coalesce(bad, F.lit(True)), F.struct(label.cast("string").alias("label"), F.lit(problem).alias("problem")))
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    some = lambda c: F.coalesce(F.col(c), F.array().cast(parses.schema[c].dataType))
    unknown = lambda refs, known: F.exists(F.coalesce(refs, F.array().cast("array<string>")), lambda r: (r != "") & ~F.array_contains(F.col(known), r))

    def context(label: Column, c: Column) -> list[Column]:
        out = [hit(label, "context version", c["schema_version"] != versions["context"])]
        out += [hit(label, f"{k} missing", c[k].isNull()) for k in CONTEXT_LISTS]
        out += [hit(label, f"unknown {k}", unknown(c[k], "block_ids" if "block" in k else "chunk_ids")) for k in CONTEXT_LISTS]
        return [*out, hit(label, "context_texts missing", c["context_texts"].isNull()), hit(label, "summary version", c["summary_version"] != versions["summary"]), hit(label, "summary source", c["summary_source"] != "local_rules"), hit(label, "summary empty", blank(c["summary"])), hit(label, "summary facts missing", c["summary_facts"].isNull())]

    def each(column: str, rules) -> Column:
        return F.coalesce(F.flatten(F.transform(some(column), lambda x: F.array(*rules(x)))), empty)

    no = F.col("parse_id")
    top = [
        hit(no, "manifest missing", F.col("manifest").isNull()), hit(no, "manifest parse_id", ~blank(F.coalesce(F.col("manifest.parse_id"), F.lit(""))) & (F.col("manifest.parse_id") != no)),
        hit(no, "manifest chunk_count", F.coalesce(F.col("manifest.chunk_count") != F.size("chunks"), F.lit(False))), hit(no, "chunk records missing", F.col("chunk_records").isNull()), hit(no, "ingest records missing", F.col("ingest_records").isNull()),
        hit(no, "chunk records count", F.coalesce((F.size("chunk_records") > 0) & (F.size("chunk_records") != F.size("chunks")), F.lit(False))), hit(no, "ingest records count", F.coalesce((F.size("ingest_records") > 0) & (F.size("ingest_records") != F.size("chunks")), F.lit(False))),
    ]
    of_chunk = lambda x: [hit(x["chunk_id"], "empty chunk", blank(x["text"])), hit(x["chunk_id"], "unknown block_refs", unknown(x["block_refs"], "block_ids")), hit(x["chunk_id"], "unknown asset_refs", unknown(x["asset_refs"], "asset_ids")), hit(x["chunk_id"], "strategy missing", blank(x["strategy"]))]
    of_record = lambda x: [hit(x["chunk_id"], "empty record", blank(x["text"])), hit(x["chunk_id"], "record version", x["schema_version"] != versions["chunk"]), hit(x["chunk_id"], "record strategy missing", blank(x["strategy"]))]
    of_ingest = lambda x: [hit(x["record_id"], "empty ingest", blank(x["text"])), hit(x["record_id"], "ingest version", x["schema_version"] != versions["ingest"]), hit(x["record_id"], "ingest chunk version", x["chunk_schema_version"] != versions["chunk"])]
    within = F.coalesce(F.flatten(F.transform(some("chunk_records"), lambda r: F.flatten(F.transform(F.coalesce(r["assets"], F.array().cast(parses.schema["assets"].dataType)), lambda a: F.array(*context(F.concat_ws(":", r["chunk_id"], a["asset_id"]), a["context"])))))), empty)
    found = F.concat(F.array(*top), each("assets", lambda a: context(a["asset_id"], a["context"])), each("chunks", of_chunk), each("chunk_records", of_record), within, each("ingest_records", of_ingest))
    return parses.select("parse_id", F.inline(F.array_compact(found)))
