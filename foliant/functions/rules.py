"""Rules over short texts as Column ladders: headings, captions, error codes, file
types, dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of numbered headings and bullets with their rank, in the
# order in which they are tried.
BULLETS = (
    (r"^第[零一二三四五六七八九十百]+章", 1),
    (r"^第[零一二三四五六七八九十百]+[条节]", 2),
    (r"^[零一二三四五六七八九十百]+[、 　]", 3),
    (r"^[\(（][零一二三四五六七八九十百]+[）\)]", 4),
    (r"^[0-9]+(、|\.[　 ]|\.[^0-9])", 5),
    (r"^[0-9]+\.[0-9]+(、|[. 　]|[^0-9])", 6),
    (r"^[0-9]+\.[0-9]+\.[0-9]+(、|[ 　]|[^0-9])", 7),
    (r"^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+(、|[ 　]|[^0-9])", 8),
    (r"^.{0,48}[：:?？]$", 9),
    (r"^[0-9]+）", 10),
    (r"^[\(（][0-9]+[）\)]", 11),
    (r"^[零一二三四五六七八九十百]+是", 12),
    (r"^[⚫•➢✓]", 12),
)
NUMBERS_ONLY = r"^[0-9 ().,%+/-]+$"
CAPTION = r"^[图表]+[ 0-9:：]{2,}"
CAPITAL_HEADING = r"^[A-Z][A-Za-z0-9 ,/&()：:.-]{2,}$"
# Messages that name an error code as a whole, and by their start.
ERROR_WHOLE = {
    "unauthorized": "UNAUTHORIZED", "no file part": "NO_FILE_PART", "no selected file": "NO_SELECTED_FILE", "empty image file": "EMPTY_IMAGE_FILE",
    "invalid image file or format not supported": "INVALID_IMAGE_FILE", "models not initialized": "MODELS_NOT_INITIALIZED", "async parse is disabled": "ASYNC_PARSE_DISABLED",
    "rate limit exceeded": "RATE_LIMIT_EXCEEDED", "usage quota exceeded": "USAGE_QUOTA_EXCEEDED", "server busy": "SERVER_BUSY", "tenant_id override is not allowed": "TENANT_OVERRIDE_FORBIDDEN",
    "json body must be an object": "JSON_BODY_REQUIRED", "invalid artifact id": "INVALID_ARTIFACT_ID", "artifact not found": "ARTIFACT_NOT_FOUND", "asset not found": "ASSET_NOT_FOUND", "task not found": "TASK_NOT_FOUND",
}
ERROR_START = {"unsupported file extension:": "UNSUPPORTED_FILE_EXTENSION", "unsupported file type:": "UNSUPPORTED_FILE_TYPE", "parser dependency missing:": "PARSER_DEPENDENCY_MISSING", "failed to save upload:": "UPLOAD_SAVE_FAILED"}
ERROR_STATUS = {401: "UNAUTHORIZED", 403: "FORBIDDEN", 404: "NOT_FOUND", 409: "CONFLICT", 501: "NOT_IMPLEMENTED", 503: "SERVICE_UNAVAILABLE"}


def bullet_rank(c: Column) -> Column:
    """The rank of a heading or bullet; 0 for numbers alone; null for plain text."""
    out = F.when(F.length(c) <= 2, F.lit(None).cast("int")).when(c.rlike(NUMBERS_ONLY), 0)
    for pattern, rank in BULLETS:
        out = out.when(c.rlike(pattern), rank)
    return out


def is_caption(text: Column, layout: Column) -> Column:
    return F.trim(text).rlike(CAPTION) | F.contains(F.coalesce(layout, F.lit("")), F.lit("caption"))


def starts_section(text: Column, layout: Column) -> Column:
    """Whether a box opens a section, so that nothing merges across it."""
    t = F.trim(F.coalesce(text, F.lit("")))
    kind = F.lower(F.coalesce(layout, F.lit("")))
    named = kind.rlike("title|caption|header|footer") | kind.isin("table", "figure", "equation", "seal")
    return named | (F.coalesce(bullet_rank(t), F.lit(0)) > 0) | ((F.length(t) <= 80) & t.rlike(CAPITAL_HEADING) & ~t.rlike(r"[.。!?！？]$"))


def is_doubled(c: Column) -> Column:
    """Whether every character stands twice, as overlaid print gives."""
    pairs = F.sequence(F.lit(1), F.length(c) - 1, F.lit(2))
    return F.when((F.length(c) < 4) | (F.length(c) % 2 == 1), False).otherwise(F.forall(pairs, lambda i: F.substring(c, i, F.lit(1)) == F.substring(c, i + 1, F.lit(1))))


def error_code(message: Column, status: Column) -> Column:
    m = F.lower(F.trim(F.coalesce(message, F.lit(""))))
    out = F
    for text, code in ERROR_WHOLE.items():
        out = out.when(m == text, code)
    for text, code in ERROR_START.items():
        out = out.when(m.startswith(text), code)
    out = out.when(F.contains(m, F.lit("not supported by the active backend")), "NOT_IMPLEMENTED").when(m.startswith("invalid ") | F.contains(m, F.lit(" invalid ")), "INVALID_PAYLOAD")
    for number, code in ERROR_STATUS.items():
        out = out.when(status == number, code)
    return out.when(status >= 500, "INTERNAL_ERROR").otherwise("BAD_REQUEST")


def file_extension(c: Column) -> Column:
    """The last extension in lower case; null without one."""
    ext = F.lower(F.element_at(F.split(c, r"\."), -1))
    return F.when(F.contains(c, F.lit(".")) & (ext != ""), ext)


def repaired_date(c: Column) -> Column:
    """(year, month, day) of a loose date; impossible months and days become 1."""
    part = lambda i: F.try_to_number(F.nullif(F.regexp_extract(c, r"(\d{4})\D*(\d{1,2})?\D*(\d{1,2})?", i), F.lit("")), F.lit("9999")).cast("int")
    fit = lambda x, most: F.when(x.between(1, most), x).otherwise(1)
    return F.when(part(1).isNotNull(), F.struct(part(1).alias("year"), fit(part(2), 12).alias("month"), fit(part(3), 31).alias("day")))
