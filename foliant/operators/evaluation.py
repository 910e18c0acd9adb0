"""Evaluation metrics and gates over rows of samples."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def multiset_scores(seen: DataFrame, true: DataFrame, sample: str, item: str) -> DataFrame:
    """(sample, precision, recall, f1) of items counted with repeats. Items are
    counted before the join, so it moves one row for each kind."""
    a = seen.groupBy(sample, item).agg(F.count("*").alias("_a"))
    b = true.groupBy(sample, item).agg(F.count("*").alias("_b"))
    both = a.join(b, [sample, item], "full")
    n = both.groupBy(sample).agg(F.sum(F.least(F.coalesce("_a", F.lit(0)), F.coalesce("_b", F.lit(0)))).alias("hit"), F.coalesce(F.sum("_a"), F.lit(0)).alias("seen"), F.coalesce(F.sum("_b"), F.lit(0)).alias("true"))
    p = F.when(F.col("seen") > 0, F.col("hit") / F.col("seen")).otherwise(0.0)
    r = F.when(F.col("true") > 0, F.col("hit") / F.col("true")).otherwise(0.0)
    return n.withColumn("precision", p).withColumn("recall", r).withColumn("f1", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0))


def word_distance(a: Sequence, b: Sequence) -> int:
    """Edit distance of two sequences."""
    names: dict = {}
    a, b = (np.array([names.setdefault(x, len(names)) for x in s], np.int64) for s in (a, b))
    at = np.arange(len(b) + 1)
    row = at.copy()
    for i, x in enumerate(a, 1):
        new = np.concatenate([[i], np.minimum(row[1:] + 1, row[:-1] + (b != x))])
        # Insertions: the least of all to the left, one more for each step.
        row = np.minimum.accumulate(new - at) + at
    return int(row[-1])


@F.pandas_udf(DoubleType())
def word_error_rate(seen: pd.Series, true: pd.Series) -> pd.Series:
    """Word edits by the number of true words (at least 1)."""
    return pd.Series([word_distance((x or "").split(), (y or "").split()) / max(1, len((y or "").split())) for x, y in zip(seen, true, strict=True)])


def summary(metrics: DataFrame, names: Sequence[str]) -> DataFrame:
    """Means over the samples that have each metric, and how many have it."""
    return metrics.agg(F.count("*").alias("samples"), *(F.avg(n).alias(f"mean_{n}") for n in names), *(F.count(n).alias(f"n_{n}") for n in names))


def gates(base: DataFrame, new: DataFrame, sample: str, better: Mapping[str, str], tolerance: float = 1e-6) -> DataFrame:
    """(metric, baseline, candidate, passed): the candidate's mean must be no worse;
    ``better`` says for each metric whether ``less`` or ``more`` is."""
    names = list(better)
    flat = lambda df, x: df.select(sample, F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias(x)) for n in names))).alias("m")).select(sample, "m.*")
    both = flat(base, "a").join(flat(new, "b"), [sample, "metric"], "full")
    mean = both.groupBy("metric").agg(F.avg("a").alias("baseline"), F.avg("b").alias("candidate"), F.count_if(F.col("a").isNull() | F.col("b").isNull()).alias("unpaired"))
    less = F.col("metric").isin([n for n, w in better.items() if w == "less"])
    ok = F.when(less, F.col("candidate") <= F.col("baseline") + tolerance).otherwise(F.col("candidate") >= F.col("baseline") - tolerance)
    return mean.withColumn("passed", F.coalesce(ok & (F.col("unpaired") == 0), F.lit(False)))


def problems(df: DataFrame, key: str, rules: Mapping[str, Column]) -> DataFrame:
    """(key, problem) for each rule a row breaks."""
    told = F.array_compact(F.array(*(F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for name, bad in rules.items())))
    return df.select(key, F.explode(told).alias("problem"))


def covered(expected: DataFrame, seen: DataFrame, sample: str, text: str) -> DataFrame:
    """Expected texts that lie in a seen text of the same sample."""
    s = seen.select(F.col(sample).alias("_s"), F.col(text).alias("_t"))
    return expected.join(s, (F.col(sample) == F.col("_s")) & F.contains(F.col("_t"), F.col(text)), "left_semi")


def tree_distance(a: tuple, b: tuple) -> int:
    """Edit distance of ordered trees (label, children), after Zhang and Shasha (1989)."""

    def flat(t):
        labels, left, keys = [], [], {}

        def visit(node):
            first = None
            for child in node[1]:
                at = visit(child)
                first = at if first is None else first
            labels.append(node[0])
            left.append(len(labels) - 1 if first is None else first)
            keys[left[-1]] = len(labels) - 1
            return left[-1]

        visit(t)
        return labels, left, sorted(keys.values())

    la, fa, ka = flat(a)
    lb, fb, kb = flat(b)
    tree = [[0] * len(lb) for _ in la]
    for i in ka:
        for j in kb:
            x, y = fa[i], fb[j]
            d = [[0] * (j - y + 2) for _ in range(i - x + 2)]
            for p in range(1, i - x + 2):
                d[p][0] = p
            for q in range(1, j - y + 2):
                d[0][q] = q
            for p in range(1, i - x + 2):
                for q in range(1, j - y + 2):
                    m, n = x + p - 1, y + q - 1
                    step = min(d[p - 1][q] + 1, d[p][q - 1] + 1)
                    if fa[m] == x and fb[n] == y:
                        d[p][q] = min(step, d[p - 1][q - 1] + (la[m] != lb[n]))
                        tree[m][n] = d[p][q]
                    else:
                        d[p][q] = min(step, d[fa[m] - x][fb[n] - y] + tree[m][n])
    return tree[-1][-1]


def table_tree(html: str) -> tuple:
    """The rows and cells of a table as a tree."""
    import re

    rows = re.findall(r"(?is)<tr[^>]*>(.*?)</tr>", html or "")
    cell = lambda r: [(("td", re.sub(r"<[^>]+>", "", c).strip()), []) for c in re.findall(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>", r)]
    return ("table", [("tr", cell(r)) for r in rows])


@F.pandas_udf(DoubleType())
def table_similarity(seen: pd.Series, true: pd.Series) -> pd.Series:
    """1 less the share of nodes that edits touch."""

    def one(x, y):
        a, b = table_tree(x), table_tree(y)
        n = lambda t: 1 + sum(map(n, t[1]))
        return 1.0 - tree_distance(a, b) / max(n(a), n(b))

    return pd.Series([one(x, y) for x, y in zip(seen, true, strict=True)])


def field_hits(fields: DataFrame, blocks: DataFrame, sample: str) -> DataFrame:
    """Fields (value, pages) whose value stands in a block (text, pages) of their sample
    that shares a page, or where the pages of either aren't known."""
    flat = lambda c: F.lower(F.regexp_replace(F.trim(c), r"\s+", " "))
    wanted = fields.filter(F.trim(F.coalesce("value", F.lit(""))) != "")
    b = blocks.filter(F.trim(F.coalesce("text", F.lit(""))) != "").select(F.col(sample).alias("_s"), flat(F.col("text")).alias("_text"), F.col("pages").alias("_pages"))
    shared = (F.size("pages") == 0) | (F.size("_pages") == 0) | F.arrays_overlap("pages", "_pages")
    return wanted.join(b, (F.col(sample) == F.col("_s")) & F.contains(F.col("_text"), flat(F.col("value"))) & shared, "left_semi")


def matched_blocks(expected: DataFrame, seen: DataFrame, sample: str) -> DataFrame:
    """(sample, n_expected, n_seen, n_matched): in order, each expected block (no, kind,
    text) takes the first block seen that is free, of its kind, and has the text or is
    part of it."""
    row = lambda n: F.array_sort(F.collect_list(F.struct("no", "kind", "text"))).alias(n)
    both = expected.groupBy(sample).agg(row("_e")).join(seen.groupBy(sample).agg(row("_s")), sample, "full")
    empty = F.array().cast("array<struct<no:bigint,kind:string,text:string>>")
    e, s = (F.transform(F.coalesce(c, empty), lambda x: x.cast("struct<no:bigint,kind:string,text:string>")) for c in ("_e", "_s"))

    def take(free: Column, x: Column) -> Column:
        fits = F.filter(free, lambda y: (y["kind"] == x["kind"]) & (F.contains(y["text"], x["text"]) | F.contains(x["text"], y["text"])))
        return F.when(F.size(fits) > 0, F.filter(free, lambda y: y["no"] != F.get(fits, 0)["no"])).otherwise(free)

    out = both.select(sample, F.size(e).alias("n_expected"), F.size(s).alias("n_seen"), F.aggregate(e, s, take).alias("free"))
    return out.select(sample, "n_expected", "n_seen", (F.col("n_seen") - F.size("free")).alias("n_matched"))


def dataset_report(samples: DataFrame, metrics: Sequence[str], metric_tables: Sequence[DataFrame], sample: str) -> tuple[DataFrame, DataFrame]:
    """(per sample, summary) of metric tables joined by sample; missing ones are null."""
    out = samples.select(sample).distinct()
    for m in metric_tables:
        out = out.join(m, sample, "left")
    return out, summary(out, metrics)
