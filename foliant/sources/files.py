"""Folders of files as a table of blocks."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.sources import formats

BLOCKS = "path string, document_id string, file_type string, pos int, block_type string, text string, level int, page int, meta string, error string"
MOST_BYTES = 100 << 20
KNOWN = {"block_type", "text", "level", "page"}


def blocks(spark: SparkSession, path: str, parsers: dict[str, Callable] | None = None, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Blocks of all files below ``path``, a task for each batch of files.

    A file of unknown type, too large, or that its parser refuses is one row with
    ``error``; ``document_id`` is the SHA-256 of its bytes (null if they weren't read). ``parsers`` adds or
    replaces formats, such as those that need a library."""
    known = formats.PARSERS | (parsers or {})
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    # The filter on the length reaches the scan, so that large files aren't read.
    small = files.filter(F.col("length") <= most_bytes).select("path", "content", F.sha2("content", 256).alias("document_id"), F.lit(False).alias("large"))
    large = files.filter(F.col("length") > most_bytes).select("path", F.lit(None).cast("binary").alias("content"), F.lit(None).cast("string").alias("document_id"), F.lit(True).alias("large"))
    slim = small.unionByName(large)

    def parsed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in BLOCKS.split(", ")]
        for part in parts:
            out = []
            for r in part.itertuples():
                name = r.path.rpartition("/")[2]
                kind = name.rpartition(".")[2].lower()
                head = (r.path, r.document_id, kind)
                try:
                    if r.large:
                        raise ValueError("too large")
                    if kind not in known:
                        raise ValueError("unsupported file type")
                    for pos, b in enumerate(known[kind](bytes(r.content), name)):
                        more = {k: v for k, v in b.items() if k not in KNOWN}
                        out.append((*head, pos, b["block_type"], b["text"], b.get("level"), b.get("page"), json.dumps(more, ensure_ascii=False) if more else None, None))
                except Exception as e:  # a broken file must not end the scan
                    out.append((*head, None, None, None, None, None, None, f"{type(e).__name__}: {e}"[:300]))
            yield pd.DataFrame(out, columns=names).astype({"pos": "Int32", "level": "Int32", "page": "Int32"})

    return slim.mapInPandas(parsed, BLOCKS)


def event_log(spark: SparkSession, path: str, schema) -> DataFrame:
    """JSON lines of events without the lines that don't parse."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def write_exports(chunks: DataFrame, path: str, by: str | None = None) -> None:
    """Chunks as JSON lines, a folder for each value of ``by``."""
    w = chunks.write.mode("append")
    (w.partitionBy(by) if by else w).json(path)
