"""Embedding near-duplicates by random-projection trees that part no link.

Unit vectors whose cosine is ``least`` or more differ by at most
sqrt(2 - 2 * least) on any axis. ``fit`` splits a bounded sample recursively: a node
projects onto the difference of two random members, and what lies within half that
length of the cut goes to both sides. So both ends of a link share a leaf, whatever
the sample was. Of the cuts tried the one with least pairs to compare is taken, a
node that none makes cheaper stays whole, and of ``trees`` trees the cheapest is
used. All vectors are routed down it. A leaf is dealt by a hash into blocks of
about ``block_rows`` rows, and each pair of blocks is a task that compares all rows
of one with all of the other. Cosines that single precision leaves in doubt are
computed again in double precision. No link is missed and none is made up.

A pair in several leaves counts in one: a row's mask has a bit for each right turn
of its path at which the row also went left, and a pair with a common bit belongs
to a leaf further left. Pairs are not stored: a task gives each of its rows the
number of its links and one edge to its local component.

What a tree can't split costs the square of its rows: vectors spread evenly over
many dimensions are all compared with each other.

Vectors with equal components are one class beforehand, so a vector that a third
of all rows share costs one row. The sample (``sample_rows``, in the order of a
hash) is all that reaches the driver; every row is routed and compared.

Defined results: a vector that is null, empty, zero or holds null or non-finite
components links with nothing and is its own component; vectors of different
length never link; null ids get no component and count as links of others;
repeated rows count each other; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import finished, trimmed, trimmed_stream, written
from foliant.llm.graph import components


#: Rows of one side that are compared at a time.
STEP = 512
#: Most bytes of a block's vectors.
BLOCK_BYTES = 16 << 20


@dataclass
class Node:
    axis: np.ndarray
    cut: float
    left: Node | int
    right: Node | int


def half_band(least: float) -> float:
    """Half of the most by which the ends of a link differ on an axis."""
    return float(np.sqrt(max(0.0, 2 - 2 * least))) / 2 + 1e-9


def split(x: np.ndarray, rng: np.random.Generator, band: float) -> tuple[np.ndarray, float] | None:
    """(axis, cut) of the random cut with least pairs to compare; None if none gets on."""
    best, found = 0.8 * len(x) ** 2, None
    for _ in range(8):
        i, j = rng.choice(len(x), 2, replace=False)
        axis = x[i] - x[j]
        if not (length := np.linalg.norm(axis)) > 0:
            continue
        p = np.sort(x @ (axis / length))
        for cut in np.quantile(p, np.arange(1, 16) / 16):
            left, right = np.searchsorted(p, cut + band, "right"), len(p) - np.searchsorted(p, cut - band)
            if (work := float(left) ** 2 + float(right) ** 2) <= best:
                best, found = work, (axis / length, float(cut))
    return found


def grow(x: np.ndarray, rng: np.random.Generator, leaf: int, band: float, sizes: list[int], depth: int = 60) -> Node | int:
    """A tree over ``x``; its leaves are numbered in the order of ``sizes``, their rows."""
    if len(x) <= leaf or not depth or (s := split(x, rng, band)) is None:
        sizes.append(len(x))
        return len(sizes) - 1
    axis, cut = s
    p = x @ axis
    left = grow(x[p <= cut + band], rng, leaf, band, sizes, depth - 1)
    return Node(axis, cut, left, grow(x[p >= cut - band], rng, leaf, band, sizes, depth - 1))


def route(t: Node | int, x: np.ndarray, idx: np.ndarray, band: float, mask: np.ndarray, bit: int = 0) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(leaf, rows, masks of rows) for every leaf that gets rows."""
    if not len(idx):
        return
    if not isinstance(t, Node):
        yield t, idx, mask
        return
    p = x[idx] @ t.axis
    low, high = p <= t.cut + band, p >= t.cut - band
    yield from route(t.left, x, idx[low], band, mask[low], bit)
    yield from route(t.right, x, idx[high], band, mask[high] | low[high].astype(np.int64) << bit, bit + 1)


def fit(sample: np.ndarray, least: float, trees: int = 10, leaf: int = 48, seed: int = 7) -> tuple[Node | int, list[int]]:
    """The tree with least pairs to compare, and the sample's rows in its leaves."""
    grown = []
    for k in range(trees):
        sizes: list[int] = []
        grown.append((grow(sample, np.random.default_rng((seed, k)), leaf, half_band(least), sizes), sizes))
    return min(grown, key=lambda g: sum(n * n for n in g[1]))


def blocks_of(seen: int, sampled: int, total: int, rows: int) -> int:
    """Blocks of a leaf with ``seen`` of ``sampled`` rows, so that they rarely exceed ``rows``."""
    most = seen if sampled >= total else total * min(1.0, (seen + 3 * seen**0.5 + 9) / sampled)
    return max(1, -int(-most // rows))


@dataclass
class Block:
    ids: np.ndarray
    copies: np.ndarray
    mask: np.ndarray
    raw: np.ndarray

    def __post_init__(self):
        self.norm = np.linalg.norm(self.raw, axis=1)
        self.unit = (self.raw / self.norm[:, None]).astype(np.float32)


def _weigh(link: np.ndarray, copies: np.ndarray) -> np.ndarray:
    """Copies that each row of ``link`` points at."""
    many = copies > 1
    more = link[:, many].astype(np.float64) @ (copies[many] - 1.0)
    return np.count_nonzero(link, axis=1) + more.astype(np.int64)


def links_between(a: Block, b: Block, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, links, id of a row of the same component) of the rows of two blocks, or
    of one that is passed twice, that have links there."""
    same = a is b
    ids = a.ids if same else np.concatenate([a.ids, b.ids])
    off = 0 if same else len(a.ids)
    n, up = np.zeros(len(ids), np.int64), np.arange(len(ids))
    doubt = a.raw.shape[1] * 1.2e-7 + 1e-6
    masked = bool(a.mask.any() and b.mask.any())

    def top(k: int) -> int:
        while up[k] != k:
            k = int(up[k])
        return k

    for at in range(0, len(a.ids), STEP):
        to = at if same else 0
        cos = a.unit[at : at + STEP] @ b.unit[to:].T
        link = cos >= least - doubt
        if same:
            link &= ~np.tri(*link.shape, dtype=bool)
        rows = np.flatnonzero(link.any(1))
        if not len(rows):
            continue
        link, cos = link[rows], cos[rows]
        i, j = np.nonzero(link & (cos < least + doubt))
        for k in range(0, len(i), 1 << 14):
            p, q = i[k : k + (1 << 14)], j[k : k + (1 << 14)]
            x, y = rows[p] + at, q + to
            link[p, q] = np.einsum("ij,ij->i", a.raw[x], b.raw[y]) / (a.norm[x] * b.norm[y]) >= least
        if masked:
            link &= (a.mask[at + rows][:, None] & b.mask[to:][None, :]) == 0
        n[at + rows] += _weigh(link, b.copies[to:])
        n[off + to :] += _weigh(link.T, a.copies[at + rows])
        for r, own in zip((at + rows).tolist(), link, strict=True):
            near = np.flatnonzero(own) + off + to
            if not len(near):
                continue
            least_up, over = top(r), up[near]
            if (over != least_up).any():
                tops = [least_up, *(top(k) for k in np.unique(over).tolist())]
                least_up = min(tops)
                up[tops] = least_up
                up[near] = least_up
                up[r] = least_up
    while (up[up] != up).any():
        up = up[up]
    some = n > 0
    return ids[some], n[some], ids[up[some]]


def unit(rows: list) -> np.ndarray:
    """Unit vectors of rows of one length."""
    x = np.asarray(rows, np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def valid(vector: str = "vector"):
    """Whether a vector can link: finite components, not all of them zero."""
    v = F.col(vector)
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.coalesce(v.isNotNull() & finite & F.exists(v, lambda c: c != 0), F.lit(False))


def near(reps: DataFrame, least: float, trees: int, few: int, sample_rows: int, block_rows: int) -> DataFrame:
    """(node, n, root): links of the rows of ``reps`` (rep, copies, vector) with a
    cosine of ``least`` or more, each in one of a node's rows, and edges to ``root``
    that make the same components."""
    total = reps.count()
    sample = reps.select("vector").orderBy(F.xxhash64("vector"), "vector").limit(sample_rows).collect()
    by_length: dict[int, list] = {}
    for r in sample:
        by_length.setdefault(len(r["vector"]), []).append(r["vector"])
    exact32 = reps.schema["vector"].dataType.elementType.simpleString() == "float"
    kind = np.float32 if exact32 else np.float64
    leaf = max(2, few * len(sample) // max(1, total))
    size = lambda n: max(1, min(block_rows, BLOCK_BYTES // (n * np.dtype(kind).itemsize)))
    fitted = {n: fit(unit(v), least, trees, leaf=max(48, leaf) if total > len(sample) else leaf) for n, v in by_length.items()}
    forest = reps.sparkSession.sparkContext.broadcast({n: (t, [blocks_of(k, len(sample), total, size(n)) for k in sizes]) for n, (t, sizes) in fitted.items()})
    band, sampled = half_band(least), len(sample)

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, copies = (b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
            vectors = b.column(2)
            length = np.diff(vectors.offsets.to_numpy())
            out: dict[str, list] = {"dim": [], "leaf": [], "one": [], "two": [], "block": [], "ids": [], "copies": [], "masks": [], "rows": []}
            for n in np.unique(length):
                at = np.flatnonzero(length == n)
                flat = vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)
                raw = flat.reshape(-1, n).astype(kind)
                tree, blocks = forest.value.get(int(n)) or (0, [blocks_of(0, sampled, total, size(int(n)))])
                for leaf, idx, mask in route(tree, unit(raw), np.arange(len(raw)), band, np.zeros(len(raw), np.int64)):
                    k = blocks[leaf]
                    to = (((ids[at[idx]].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) % np.uint64(k)).astype(np.int64)
                    for own in np.unique(to).tolist():
                        some = to == own
                        rows = idx[some]
                        data = (own, ids[at[rows]].tobytes(), copies[at[rows]].tobytes(), mask[some].tobytes(), raw[rows].tobytes())
                        for other in range(k):
                            for name, v in zip(out, (int(n), leaf, min(own, other), max(own, other), *data), strict=True):
                                out[name].append(v)
            kinds = [pa.int32()] * 5 + [pa.binary()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], names=list(out))

    def compared(t: pa.Table) -> pa.Table:
        dim, one, two = (t.column(c)[0].as_py() for c in ("dim", "one", "two"))
        own = t.column("block").to_numpy()

        def block(k: int) -> Block:
            some = t.filter(pa.array(own == k))
            ids, copies, mask = (np.frombuffer(b"".join(some.column(c).to_pylist()), np.int64) for c in ("ids", "copies", "masks"))
            return Block(ids, copies, mask, np.frombuffer(b"".join(some.column("rows").to_pylist()), kind).reshape(-1, dim).astype(np.float64))

        a = block(one)
        found = links_between(a, a if one == two else block(two), least)
        return pa.table([pa.array(c, pa.int64()) for c in found], names=["node", "n", "root"])

    dealt = reps.select("rep", "copies", "vector").mapInArrow(trimmed_stream(routed), "dim int, leaf int, one int, two int, block int, ids binary, copies binary, masks binary, rows binary")
    return dealt.groupBy("dim", "leaf", "one", "two").applyInArrow(trimmed(compared), "node long, n long, root long")


@finished("vector-groups")
def linked(df: DataFrame, least: float = 0.95, trees: int = 10, few: int = 400, sample_rows: int = 8192, block_rows: int = 8192, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector")).withColumn("ok", valid())
    rows = written(rows, "vectors")
    named = rows.filter("ok").groupBy("vector").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"))
    # Classes are numbered by their least id; those of null ids alone by a hash, below all ids.
    reps = written(named.withColumn("rep", F.coalesce("first", -F.abs(F.xxhash64("vector")) - 1)), "vector_classes")
    found = written(near(reps, least, trees, few, sample_rows, block_rows), "vector_links")
    others = found.groupBy(F.col("node").alias("a")).agg(F.sum("n").alias("others"))
    comp = components(found, "node", "root", what="vector_components")
    facts = reps.join(others, reps.rep == others.a, "left").join(comp, reps.rep == comp.node, "left").select(F.col("vector").alias("_v"), (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n"), F.coalesce("component", "rep").alias("component"))
    out = rows.filter("ok").join(facts, F.col("vector") == F.col("_v")).select("vec_id", "n", "component")
    out = out.unionByName(rows.filter("NOT ok").select("vec_id", F.lit(0).cast("long").alias("n"), F.col("vec_id").alias("component")))
    own = F.when(F.col("vec_id").isNotNull(), F.col("component"))
    return out.select("vec_id", F.col("n").cast("long").alias("n_links"), own.alias("component_id"), (F.col("vec_id") == own).alias("kept"))
