"""Language identification by compression.

``fit`` builds one raw-content zstandard dictionary per language from a bounded
sample of labelled texts; ``classify`` compresses each whole text (its lower-case words) against all
dictionaries, in blocks so that a dictionary stays in reach throughout a long
text, and takes the language with the smallest total. Ties go to the first name
in alphabetical order. A narrow margin sets ``rejected``.

Bounds of the fit (parameters): at most ``sample_rows`` different texts and ``dict_bytes``
bytes a language, texts of ``sample_range`` bytes first, in the order of a hash
of the text. Prediction reads every byte of every text.

Defined results: a text that is null, empty or holds no letter is ``und`` with
score 0 and is rejected; labels or texts that are null are not learned from;
equal texts get equal answers; without any labelled text every prediction is
``und``; other columns pass through and clashing names are overwritten.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

UNKNOWN = "und"
#: Runs of anything but letters.
BETWEEN = re.compile(r"[\W\d_]+")
BLOCK = 16 << 10
LEVEL = 3
#: Ranges of the hash in which the sample is looked for, as a power of two.
RANGE_BITS = 4
FIELDS = ("lang_pred", "score", "margin", "rejected")
PREDICTION = "lang_pred string, score double, margin double, rejected boolean"


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", sample_rows: int = 400, dict_bytes: int = 256 << 10, sample_range: tuple[int, int] = (400, 4000)) -> dict[str, bytes]:
    """One dictionary per language; at most ``dict_bytes`` of each reach the driver's result."""
    size = F.octet_length("_text")
    picked = (
        labelled.select(F.col(text).cast("string").alias("_text"), F.col(lang).cast("string").alias("_lang"))
        .filter(F.col("_text").isNotNull() & F.col("_lang").isNotNull() & (size <= dict_bytes))
        .withColumns({"_far": ~size.between(*sample_range), "_hash": F.xxhash64("_text")})
    )
    # Copies count once: the first hashes of a language, then the texts that have them.
    # Ranges of the hash come first, so that no task holds a language: the second
    # window sees at most RANGES * sample_rows rows of each.
    hashes = picked.select("_lang", "_far", "_hash", F.shiftrightunsigned("_hash", 64 - RANGE_BITS).alias("_range")).distinct()
    for keys in (["_lang", "_range"], ["_lang"]):
        first = Window.partitionBy(*keys).orderBy("_far", "_hash")
        hashes = hashes.withColumn("_rn", F.row_number().over(first)).filter(F.col("_rn") <= sample_rows).drop("_rn")
    hashes = hashes.drop("_range")
    texts = picked.join(F.broadcast(hashes), ["_lang", "_far", "_hash"], "left_semi").distinct()
    last = Window.partitionBy("_lang").orderBy("_far", "_hash", "_text")
    rows = texts.withColumn("_rn", F.row_number().over(last)).filter(F.col("_rn") <= sample_rows).select("_lang", "_rn", "_text").collect()
    out: dict[str, list[bytes]] = {}
    room: dict[str, int] = {}
    for r in sorted(rows, key=lambda r: (r["_lang"], r["_rn"])):
        data = letters(r["_text"])
        if len(data) <= room.setdefault(r["_lang"], dict_bytes):
            room[r["_lang"]] -= len(data) + 1
            out.setdefault(r["_lang"], []).append(data)
    return {k: b"\n".join(v) for k, v in sorted(out.items())}


def letters(text: str) -> bytes:
    """Lower-case words of ``text``; signs, digits and layout tell no language."""
    return BETWEEN.sub(" ", text.lower()).encode()


class Model:
    _kept: dict[int, Model] = {}

    def __init__(self, dicts: dict[str, bytes]):
        import regex
        import zstandard as z

        self.letter = regex.compile(r"\p{L}")
        self.langs, self.enc = list(dicts), []
        for data in dicts.values():
            d = z.ZstdCompressionDict(data, dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.enc.append(z.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_dict_id=False))

    @classmethod
    def of(cls, dicts: dict[str, bytes]) -> Model:
        key = hash(tuple(dicts.items()))
        if key not in cls._kept:
            cls._kept[key] = cls(dicts)
        return cls._kept[key]

    def predict(self, text: str | None, least: float) -> tuple[str, float, float, bool]:
        if not text or not self.enc or not self.letter.search(text):
            return UNKNOWN, 0.0, 0.0, True
        data = letters(text)
        blocks = [data[at : at + BLOCK] for at in range(0, len(data), BLOCK)]
        sizes = [sum(len(e.compress(b)) for b in blocks) for e in self.enc]
        best, second = sorted(range(len(sizes)), key=lambda i: sizes[i])[:2] if len(sizes) > 1 else (0, 0)
        gap = sizes[second] - sizes[best]
        margin = gap / sizes[second]
        return self.langs[best], 1.0 - 0.5 ** min(gap, 60), margin, len(sizes) > 1 and margin < least


def classify(df: DataFrame, dicts: dict[str, bytes], text: str = "text", least_margin: float = 0.005) -> DataFrame:
    """``df`` with ``lang_pred``, ``score`` (0 to 1, from the gap in bytes),
    ``margin`` (the gap's share of the runner-up) and ``rejected``."""

    @F.pandas_udf(PREDICTION)
    def predicted(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = Model.of(dicts)
        for part in parts:
            yield pd.DataFrame([m.predict(x if isinstance(x, str) else None, least_margin) for x in part], columns=["lang_pred", "score", "margin", "rejected"])

    told = F.struct("*"), predicted(F.col(text).cast("string"))
    kept = [c for c in df.columns if c not in FIELDS]
    rows = df.select(told[0].alias("row"), told[1].alias("told"))
    return rows.select(*(F.col("row")[c].alias(c) for c in kept), *(F.col("told")[c].alias(c) for c in FIELDS))


def known(df: DataFrame, dicts: dict[str, bytes], text: str = "text", least_margin: float = 0.005) -> DataFrame:
    """The rows of ``df`` that aren't rejected, with its own columns, whatever their names."""
    row = classify(df.select(F.struct("*").alias("row"), F.col(text).cast("string").alias("text")), dicts, "text", least_margin)
    return row.filter(~F.col("rejected")).select("row.*")


def held_out(doc_id: str = "doc_id"):
    """Whether a document is kept from learning: crc32 of its id as text, mod 5, is 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learned_from(docs: DataFrame, **bounds) -> dict[str, bytes]:
    return fit(docs.filter(~held_out() & F.col("doc_id").isNotNull()), **bounds)
