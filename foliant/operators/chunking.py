"""Packing blocks into chunks of bounded tokens.

``packed`` is a fold in the engine for chunks without overlap: it numbers the
chunk of each block. ``chunks`` has the full semantics (overlap, strategies,
title paths, context assets, texts and ids) and runs a document at a time in
Arrow batches, since each cut depends on the one before.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.operators.blocks import VISUAL

LEAST_TOKENS = 64
STRATEGIES = {"default": "default_v1", "asset_aware": "asset_aware_v1", "page_aware": "page_aware_v1"}


def limits(most: int, overlap: int = 0) -> tuple[int, int]:
    most = max(LEAST_TOKENS, int(most or 800))
    return most, max(0, min(int(overlap or 0), most // 2))


def packed(blocks: DataFrame, most: int = 800, key: str = "doc_id") -> DataFrame:
    """(key, pos, token_count, chunk) of ``blocks``: greedy, without overlap."""
    most, _ = limits(most)
    ordered = blocks.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "token_count"))).alias("b"))
    kind = "struct<used:int,chunk:int,out:array<int>>"
    start = F.struct(F.lit(0).alias("used"), F.lit(0).alias("chunk"), F.array().cast("array<int>").alias("out")).cast(kind)

    def step(s, x):
        n = x["token_count"].cast("int")
        new = (F.size(s["out"]) > 0) & ((s["used"] + n > most) | (s["used"] >= most))
        chunk = s["chunk"] + F.when(new, 1).otherwise(0)
        return F.struct(F.when(new, n).otherwise(s["used"] + n).cast("int").alias("used"), chunk.cast("int").alias("chunk"), F.concat(s["out"], F.array(chunk.cast("int"))).alias("out"))

    no = F.aggregate("b", start, step, lambda s: s["out"])
    return ordered.select(key, F.explode(F.arrays_zip(F.col("b").alias("b"), no.alias("no"))).alias("x")).select(key, "x.b.pos", "x.b.token_count", F.col("x.no").alias("chunk"))


def cuts(tokens: list[int], most: int, overlap: int = 0, alone: list[bool] | None = None, pages: list[set] | None = None) -> Iterator[tuple[int, int]]:
    """(first, end) of each chunk over blocks of ``tokens``. ``alone`` blocks make
    chunks of their own; a change to unshared ``pages`` ends a chunk."""
    at, n = 0, len(tokens)
    while at < n:
        end, used = at, 0
        while end < n:
            if end > at:
                turned = pages is not None and pages[end - 1] and pages[end] and not pages[end - 1] & pages[end]
                if (alone and alone[end]) or turned or used + tokens[end] > most:
                    break
            used += tokens[end]
            end += 1
            if (alone and alone[end - 1]) or used >= most:
                break
        yield at, end
        if end >= n:
            return
        back, carried = end, 0
        while overlap and back > at and carried < overlap:
            back -= 1
            carried += tokens[back]
        at = max(at + 1, back) if overlap else end


CHUNK = "chunk_no int, chunk_id string, text string, token_count int, pages array<int>, block_refs array<string>, asset_refs array<string>, direct_refs array<string>, context_refs array<string>, title_path array<string>, strategy string"


def chunks(blocks: DataFrame, most: int = 800, overlap: int = 0, strategy: str = "default", window: int = 2, depth: int = 3, key: str = "doc_id") -> DataFrame:
    """Chunks of each document of ``blocks`` (key, pos, block_id, block_type, text,
    rendered, token_count, pages, asset_refs, level, summary)."""
    most, overlap = limits(most, overlap)
    strategy = strategy if strategy in STRATEGIES else "default"

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        rows = [r for r in pdf.to_dict("records") if r["rendered"]]
        visual = [r["block_type"] in VISUAL for r in rows]
        pages = [set(r["pages"]) for r in rows]
        paths, open_ = [], []
        for r in rows:
            if r["block_type"] == "title":
                open_ = [x for x in open_ if x[0] < r["level"]] + [(r["level"], r["text"].strip())]
            paths.append([x[1] for x in open_][-depth:])
        # Visual neighbours on the same page lend their assets to plain blocks.
        beside = [[] for _ in rows]
        said = {}
        for i, r in enumerate(rows):
            if visual[i]:
                said.update({a: r["summary"] for a in r["asset_refs"] if r["summary"]})
                for j in range(max(0, i - window), min(len(rows), i + window + 1)):
                    if not visual[j] and (not pages[i] or not pages[j] or pages[i] & pages[j]):
                        beside[j] += list(r["asset_refs"])
        out = []
        for a, z in cuts([int(r["token_count"]) for r in rows], most, overlap, visual if strategy == "asset_aware" else None, pages if strategy == "page_aware" else None):
            own = rows[a:z]
            path = next((p for p in reversed(paths[a:z]) if p), [])
            direct = list(dict.fromkeys(x for r in own for x in r["asset_refs"]))
            near = [x for x in dict.fromkeys(x for i in range(a, z) for x in beside[i]) if x not in direct]
            parts = [r["rendered"] for r in own]
            if path and not (own[0]["block_type"] == "title" and own[0]["text"].strip() == path[-1]):
                parts.insert(0, "Section: " + " > ".join(path))
            if told := list(dict.fromkeys(said[x] for x in near if x in said)):
                parts.append("Related assets: " + " | ".join(told))
            text = "\n\n".join(parts)
            name = f"chunk-{len(out):04d}-{hashlib.sha256(text.encode()).hexdigest()[:12]}"
            out.append((rows[0][key], len(out), name, text, sum(int(r["token_count"]) for r in own), sorted(set().union(*pages[a:z])), [r["block_id"] for r in own], list(dict.fromkeys(direct + near)), direct, near, path, STRATEGIES[strategy]))
        return pd.DataFrame(out, columns=[key, *(x.split()[0] for x in CHUNK.split(", "))])

    kind = blocks.schema[key].dataType.simpleString()
    return blocks.groupBy(key).applyInPandas(one, f"{key} {kind}, {CHUNK}")


def text_parts(text: str, most: int = 128, delimiters: str = "\n!?;。；！？", count=len) -> list[str]:
    """Plain text cut at delimiters; parts join until their count passes ``most``.
    Delimiters of several signs stand between back quotes."""
    import re

    long = [x for x in re.findall(r"`([^`]+)`", delimiters) if x]
    short = re.sub(r"`[^`]+`", "", delimiters)
    pattern = "|".join(map(re.escape, sorted({*long, *short}, key=len, reverse=True)))
    out, used = [""], 0
    for part in re.split(pattern, text) if pattern else [text]:
        n = count(part)
        if used > most:
            out.append(part)
            used = n
        else:
            out[-1] += part
            used += n
    return out
