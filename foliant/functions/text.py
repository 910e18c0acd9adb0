"""Text scalars as pure Column functions: they stay in code generation and move
no rows. Patterns are free of look-around, so that other engines read them alike."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The token pattern of the document model.
TOKEN = r"[A-Za-z]+(?:[-_][A-Za-z0-9]+)*|\d+(?:[.,]\d+)*|[\x{4e00}-\x{9fff}]+|[^\s]"
# Position tags of page boxes.
POSITION_TAG = r"@@[0-9-]+\t[0-9.\t]+##"
# Full-width signs and their ASCII counterparts stand 0xFEE0 apart.
FULL_WIDTH = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
HALF_WIDTH = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " "
# Types of table cells by the first pattern that fits.
CELL_TYPES = (
    ("Dt", r"^(20|19)[0-9]{2}[年/-][0-9]{1,2}[月/-][0-9]{1,2}日*$"),
    ("Dt", r"^(20|19)[0-9]{2}年$"),
    ("Dt", r"^(20|19)[0-9]{2}[年-][0-9]{1,2}月*$"),
    ("Dt", r"^[0-9]{1,2}[月-][0-9]{1,2}日*$"),
    ("Dt", r"^第*[一二三四1-4]季度$"),
    ("Dt", r"^(20|19)[0-9]{2}年*[一二三四1-4]季度$"),
    ("Dt", r"^(20|19)[0-9]{2}[ABCDE]$"),
    ("Nu", r"^[0-9.,+%/ -]+$"),
    ("Ca", r"^[0-9A-Z/\._~-]+$"),
    ("En", r"^[A-Z]*[a-z' -]+$"),
    ("NE", r"^[0-9.,+-]+[0-9A-Za-z/$￥%<>（）()' -]+$"),
    ("Sg", r"^.{1}$"),
)


def collapsed(c: Column) -> Column:
    """One blank for each run of white space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"[\s\x0B]+", " "))


def half_width(c: Column) -> Column:
    return F.translate(c, FULL_WIDTH, HALF_WIDTH)


def tokens(c: Column) -> Column:
    """Words with inner hyphens, numbers, runs of ideographs, single other signs."""
    return F.regexp_extract_all(half_width(F.coalesce(c, F.lit(""))), F.lit(TOKEN), 0)


def token_count(c: Column) -> Column:
    return F.regexp_count(half_width(F.coalesce(c, F.lit(""))), F.lit(TOKEN))


def token_tag(t: Column) -> Column:
    """m for numbers, n for ideographs, eng for letters, x for the rest."""
    return (
        F.when(t == "", "")
        .when(t.rlike(r"^[\p{Nd}.,%]+$"), "m")
        .when(t.rlike(r"^[\x{4e00}-\x{9fff}]+$"), "n")
        .when(t.rlike(r"^[\p{L}_-]+$"), "eng")
        .otherwise("x")
    )


def fine_tokens(c: Column) -> Column:
    """Tokens, runs of ideographs cut into single ones."""
    return F.flatten(F.transform(tokens(c), lambda t: F.when(t.rlike(r"^[\x{4e00}-\x{9fff}]{2,}$"), F.split(t, "")).otherwise(F.array(t))))


def truncated(c: Column, most: int) -> Column:
    """White space collapsed; beyond ``most`` characters cut at a word and closed by dots."""
    flat = collapsed(F.coalesce(c, F.lit("")))
    head = F.substring(flat, 1, most)
    word = F.regexp_replace(F.regexp_replace(head, r" [^ ]*$", ""), r"[ ,.;:，。；：]+$", "")
    return F.when(F.length(flat) <= most, flat).otherwise(F.concat(F.rtrim(F.when(word == "", head).otherwise(word)), F.lit("...")))


def slug(c: Column, default: str = "document") -> Column:
    out = F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), r"[^0-9A-Za-z._-]+", "-"), r"^[-.]+|[-.]+$", "")
    return F.when(out == "", default).otherwise(out)


def slug_unicode(c: Column, default: str = "document") -> Column:
    """As ``slug``, but each sign that is no letter or digit of any script becomes a dash."""
    out = F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}._-]", "-"), r"^[-.]+|[-.]+$", "")
    return F.when(out == "", default).otherwise(out)


def without_position_tags(c: Column) -> Column:
    return F.regexp_replace(c, POSITION_TAG, "")


def without_images(c: Column) -> Column:
    """Markdown images and HTML img tags removed."""
    return F.regexp_replace(F.regexp_replace(c, r"!\[[^\]]*\]\([^)]*\)", ""), r"(?i)<img[^>]*>", "")


def without_html(c: Column) -> Column:
    return F.regexp_replace(c, r"<[^>]+>", "")


def without_spaces_at_signs(c: Column) -> Column:
    """Blanks that stand beside signs or ideographs instead of between words."""
    once = F.regexp_replace(c, r"([^a-zA-Z0-9.,)>]) +([^\s])", "$1$2")
    return F.regexp_replace(once, r"([^\s]) +([^a-zA-Z0-9.,(<])", "$1$2")


def without_fence(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"^\s*```[A-Za-z0-9_-]*\s*\n", ""), r"\n```\s*$", "")


def redacted(c: Column) -> Column:
    """URLs, hosts after a marker and absolute paths made unreadable."""
    url = F.regexp_replace(c, r"""(?i)\b(?:https?|redis|postgres(?:ql)?|s3)://[^\s"'<>]+""", "<redacted>")
    host = F.regexp_replace(url, r"""(?i)(host=['"]?)([^'",\s)]+)(['"]?)""", "$1<redacted>$3")
    return F.regexp_replace(host, r"/(?:[A-Za-z0-9._-]+/)+[A-Za-z0-9._-]+", "<redacted>")


def formula(c: Column) -> Column:
    """A formula without its delimiters and white space."""
    bare = F.regexp_replace(F.trim(c), r"^\$\$|\$\$$|^\\\[|\\\]$|^\\\(|\\\)$|^\$|\$$", "")
    return F.regexp_replace(bare, r"\s+", "")


def edit_share(a: Column, b: Column) -> Column:
    """Edit distance by the longer text; 0 for two empty ones."""
    most = F.greatest(F.length(a), F.length(b))
    return F.when(most == 0, 0.0).otherwise(F.levenshtein(a, b) / most)


def error_rate(seen: Column, true: Column) -> Column:
    """Edit distance by the length of the true text (at least 1)."""
    return F.levenshtein(seen, true) / F.greatest(F.length(true), F.lit(1))


def cell_type(c: Column) -> Column:
    t = F.trim(c)
    words = F.size(F.filter(tokens(t), lambda x: F.length(x) > 1))
    out = F
    for name, pattern in CELL_TYPES:
        out = out.when(t.rlike(pattern), name)
    return out.when((words > 3) & (words < 12), "Tx").when(words >= 12, "Lx").otherwise("Ot")


def title_level(c: Column) -> Column:
    """1 to 6: of leading # signs, else of a dotted number, else 1."""
    t = F.trim(c)
    marks = F.length(F.regexp_extract(t, r"^(#+)", 1))
    number = F.regexp_extract(t, r"^(\d+(?:\.\d+)*)", 1)
    dots = F.length(number) - F.length(F.regexp_replace(number, r"\.", ""))
    return F.least(F.when(marks > 0, marks).when(number != "", dots + 1).otherwise(1), F.lit(6))


def is_true(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c)).isin("1", "true", "yes", "on"), F.lit(False))


def listed(c: Column) -> Column:
    """The trimmed parts of a comma-separated list without empty ones."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def humanised(size: Column) -> Column:
    """A number of bytes in the largest unit that keeps it at 1 or more."""
    out = F
    for unit, power in (("TB", 4), ("GB", 3), ("MB", 2), ("KB", 1)):
        out = out.when(size >= 1024**power, F.concat(F.round(size / 1024**power, 2).cast("decimal(20,2)").cast("string"), F.lit(f" {unit}")))
    return out.otherwise(F.concat(size.cast("long").cast("string"), F.lit(" B")))


# Seconds of the windows and bytes of the units that specs name.
WINDOWS = {"s": 1, "sec": 1, "second": 1, "min": 60, "minute": 60, "h": 3600, "hour": 3600, "day": 86400}
UNITS = {"b": 1, "kb": 1000, "mb": 1000_000, "gb": 1000_000_000}


def rate_spec(c: Column) -> Column:
    """(amount, seconds) of specs like ``3/min`` and ``1.5mb/day``; null if malformed."""
    t = F.lower(F.regexp_replace(c, r"\s+", ""))
    pattern = r"^(\d+(?:\.\d+)?)(b|kb|mb|gb)?/(" + "|".join(WINDOWS) + ")$"
    part = lambda i: F.regexp_extract(t, pattern, i)
    look = lambda table, key: F.create_map(*(F.lit(x) for kv in table.items() for x in kv))[key]
    unit = F.when(part(2) == "", 1).otherwise(look(UNITS, part(2)))
    amount = (part(1).cast("double") * unit).cast("long")
    return F.when(t.rlike(pattern), F.struct(amount.alias("amount"), look(WINDOWS, part(3)).alias("seconds")))


def is_identifier(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^[A-Za-z_][A-Za-z0-9_]*$"), F.lit(False))


def html_cells(c: Column) -> Column:
    """The trimmed texts of all table cells."""
    return F.transform(F.regexp_extract_all(c, F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), 1), lambda x: F.trim(without_html(x)))


def bucket_of(c: Column, n: int) -> Column:
    """A stable bucket of n by SHA-1."""
    return F.pmod(F.conv(F.substring(F.sha1(c), 1, 8), 16, 10).cast("long"), F.lit(n))
