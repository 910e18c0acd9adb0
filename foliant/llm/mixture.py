"""Mixing sources to target weights.

``budgets`` hands a total of tokens down a tree of domains, languages and
sources. At each node the children share by weight; a child that can't use its
share (all its tokens, ``max_epochs`` times) keeps what it can and the rest goes
to its siblings by their weights, and only what a whole subtree can't use comes
back to the level above. ``select`` then takes from each leaf whole epochs and
the longest prefix of the next epoch's order that stays within the budget; the
order of an epoch is that of a hash of seed, epoch, id and text.

A leaf may hold a third of all rows, so no task orders a leaf: a prefix is
found by sums over 1024 ranges of the hash, then over 1024 ranges of the range
in which the budget ends, and only the rows of that small range are put in
order. Leaf totals alone come to the driver, at most ``max_leaves`` of them.

Defined results: null levels form leaves of their own, looked up as None; leaves
the tree of weights doesn't name get ``default_weight``; a null or negative
token count counts as 0, and such rows go with the rows before them in order;
an empty table or a zero total selects nothing; rows equal in id and text are
ordered as one and selected or left together only if the budget allows both;
all columns of ``docs`` pass through (one named ``epoch`` is replaced; names that
begin with an underscore are kept for the operator).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from fractions import Fraction
from math import floor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Path = tuple[str | None, ...]
RANGES = 1024
BITS = 10


def shared_out(total: Fraction, weights: Sequence[Fraction], caps: Sequence[Fraction]) -> list[Fraction]:
    """``total`` dealt by weight, none over its cap, shortages among the others."""
    out, open_ = [Fraction(0)] * len(caps), [i for i in range(len(caps)) if weights[i] > 0 and caps[i] > 0]
    left = min(total, sum((caps[i] for i in open_), Fraction(0)))
    while open_ and left > 0:
        rate = left / sum(weights[i] for i in open_)
        short = [i for i in open_ if caps[i] <= rate * weights[i]]
        for i in short or open_:
            out[i] = caps[i] if short else rate * weights[i]
        left = left - sum(out[i] for i in short) if short else Fraction(0)
        open_ = [i for i in open_ if i not in short]
    return out


def budgets(total: int, have: Mapping[Path, int], weights: Mapping[Path, float], max_epochs: int = 1, default_weight: float = 1.0) -> dict[Path, int]:
    """Tokens for each leaf. ``have``: tokens of each leaf; ``weights``: of any
    node, by its path from the top, among its siblings."""

    def deal(prefix: Path, amount: Fraction, leaves: list[Path]) -> dict[Path, Fraction]:
        if len(leaves) == 1 and leaves[0] == prefix:
            return {prefix: amount}
        kids: dict[Path, list[Path]] = {}
        for leaf in sorted(leaves, key=lambda p: tuple((x is not None, x or "") for x in p)):
            kids.setdefault(leaf[: len(prefix) + 1], []).append(leaf)
        caps = [Fraction(sum(have[x] for x in below) * max_epochs) for below in kids.values()]
        shares = shared_out(amount, [Fraction(weights.get(k, default_weight)).limit_denominator(10**6) for k in kids], caps)
        return {p: x for (k, below), s in zip(kids.items(), shares, strict=True) for p, x in deal(k, s, below).items()}

    leaves = [p for p, n in have.items() if n > 0]
    return {p: floor(x) for p, x in deal((), Fraction(total), leaves).items()} if leaves else {}


def _order(seed: int, epoch: Column, ids: Sequence[str]) -> Column:
    """A whole 62-bit number for each row and epoch."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), epoch, *(F.col(c) for c in ids)), 2)


def _first_over(rows: DataFrame, keys: Sequence[str], at: str, limit: str) -> DataFrame:
    """For each leaf the first range in which the running sum passes the limit,
    with the sum before it; leaves that never do are left out."""
    sums = rows.groupBy(*keys, limit, at).agg(F.sum("_tokens").alias("_n"))
    w = Window.partitionBy(*keys).orderBy(at)
    run = sums.withColumn("_upto", F.sum("_n").over(w)).filter(F.col("_upto") > F.col(limit))
    return run.groupBy(*keys).agg(F.min_by(F.struct(F.col(at).alias("at"), (F.col("_upto") - F.col("_n")).alias("before")), at).alias("_cut"))


def select(docs: DataFrame, levels: Sequence[str], tokens: str, total: int | float, weights: Mapping[Path, float], seed: int = 0, max_epochs: int = 1, ids: Sequence[str] = ("doc_id", "text"), default_weight: float = 1.0, max_leaves: int = 100_000) -> DataFrame:
    """``docs`` with a column ``epoch``: a row for each time a document is taken.

    ``total`` is a number of tokens, or as a float a share of all there are.
    """
    spark = docs.sparkSession
    keys = [f"_level{i}" for i in range(len(levels))]
    n = F.greatest(F.coalesce(F.col(tokens).cast("long"), F.lit(0)), F.lit(0))
    rows = docs.select("*", *(F.col(c).cast("string").alias(k) for c, k in zip(levels, keys, strict=True)), n.alias("_tokens"))
    found = rows.groupBy(*keys).agg(F.sum("_tokens").alias("n")).limit(max_leaves + 1).collect()
    if len(found) > max_leaves:
        raise ValueError(f"more than {max_leaves} leaves")
    have = {tuple(r[k] for k in keys): r["n"] for r in found}
    amount = int(total) if isinstance(total, int) else floor(Fraction(total).limit_denominator(10**6) * sum(have.values()))
    plan = [(*p, b // have[p], b % have[p]) for p, b in budgets(amount, have, weights, max_epochs, default_weight).items() if b]
    leaves = spark.createDataFrame(plan, ", ".join([*(f"{k} string" for k in keys), "_whole long", "_rest long"]))
    near = F.broadcast if len(plan) <= 10_000 else (lambda x: x)

    def beside(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
        b = b.withColumnsRenamed({k: f"{k}r" for k in keys})
        return a.join(near(b), [a[k].eqNullSafe(b[f"{k}r"]) for k in keys], how).drop(*(f"{k}r" for k in keys))

    dealt = beside(rows, leaves, "inner").withColumn("_h", _order(seed, F.col("_whole"), ids))
    coarse, fine = F.shiftright("_h", 62 - BITS), F.shiftright("_h", 62 - 2 * BITS) % RANGES
    slim = dealt.select(*keys, "_rest", "_tokens", "_h", *ids).withColumns({"_a": coarse, "_b": fine})
    first = _first_over(slim, keys, "_a", "_rest").select(*keys, F.col("_cut.at").alias("_a0"), F.col("_cut.before").alias("_before"))
    inside = beside(slim, first, "inner").filter("_a = _a0").withColumn("_rest1", F.col("_rest") - F.col("_before"))
    second = _first_over(inside, keys, "_b", "_rest1").select(*keys, F.col("_cut.at").alias("_b0"), F.col("_cut.before").alias("_before1"))
    last = beside(inside, second, "inner").filter("_b = _b0").withColumn("_rest2", F.col("_rest1") - F.col("_before1"))
    # Rows of the last range, in order: (hash, ids); equal rows are told apart by their number.
    w = Window.partitionBy(*keys).orderBy("_h", *ids)
    ordered = last.withColumn("_upto", F.sum("_tokens").over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("_upto <= _rest2")
    taken = ordered.groupBy(*keys, "_h", *ids).agg(F.count("*").alias("_copies"))
    cuts = first.join(second.select(*(F.col(k).alias(f"{k}r") for k in keys), "_b0"), [F.col(k).eqNullSafe(F.col(f"{k}r")) for k in keys], "left").drop(*(f"{k}r" for k in keys))
    marked = beside(dealt, cuts, "left").withColumn("_place", F.when(F.col("_a0").isNull() | (coarse < F.col("_a0")), 1).when((coarse == F.col("_a0")) & (fine < F.col("_b0")), 1).when((coarse == F.col("_a0")) & (fine == F.col("_b0")), 0).otherwise(-1))
    edge = marked.filter("_place = 0")
    numbered = edge.withColumn("_no", F.row_number().over(Window.partitionBy(*keys, "_h", *ids).orderBy(F.lit(1))))
    right = taken.withColumnsRenamed({k: f"{k}r" for k in [*keys, "_h", *ids]})
    match = [numbered[k].eqNullSafe(right[f"{k}r"]) for k in [*keys, "_h", *ids]]
    edged = numbered.join(right, match, "left").withColumn("_place", F.when(F.col("_no") <= F.col("_copies"), 1).otherwise(-1)).select(*marked.columns)
    placed = marked.filter("_place <> 0").unionByName(edged)
    times = F.col("_whole").cast("int") + F.when(F.col("_place") == 1, 1).otherwise(0)
    out = placed.withColumn("_times", times).filter("_times > 0")
    return out.select(*(c for c in docs.columns if c != "epoch"), F.explode(F.sequence(F.lit(0), F.col("_times") - 1)).alias("epoch"))
