"""N-gram Jaccard join by blocked products of the document by n-gram incidence.

Each document is a sparse row over the n-grams (64-bit hashes of its word
shingles). Documents with equal rows become one class. The columns are cut into
K blocks of the hash range, K from the size of a row. Rows that link at p
percent differ in at most d = a * (100 - p) / p entries, a the smaller size; up
to d = 62 there are d + 2 blocks, so two of them are equal in both rows. Longer
rows have d / 1.6 blocks: as hashes deal the differences evenly, a pair just at
the threshold misses all its blocks with a chance below 1e-6 (with d + 2 blocks of
four entries many are empty or alike by chance). Rows equal in a block are brought together and pairs are discarded by bounds that follow from
sizes alone: two rows differ in at least as many entries as their parity
sketches have distance, and may in (a + b) * (100 - p) / (100 + p). The rest are
multiplied in blocks of one row by many, overlap counts are accumulated, and a
pair is kept by its count.

The first round multiplies every member of a group by one leader of the group,
the second all pairs that the bounds allow and whose ends the first didn't
connect, so components lose no link while near copies never make all pairs.

Defined results: a document without words has size 0 and links with nothing
(component: itself); fewer words than ``n`` are one n-gram; null ids get a size
and a null component; repeated rows are kept; all texts of an id make links, so an
id with different texts ties their components and has one in all its rows; other
columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import finished, trimmed, trimmed_stream, written
from foliant.llm.graph import components
from foliant.llm.token_files import slices

U = np.uint64
CHUNK = 2000
#: Groups of a row, least first, by which a pair is told to have met before.
MET = 32
#: Text that is hashed at a time, in bytes.
SLICE = 3 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def differing(a: int, percent: int) -> int:
    """Most entries in which a row of size a and a larger one can differ and link."""
    return a * (100 - percent) // percent


@lru_cache
def bounds(percent: int) -> list[int]:
    """Least sizes of the size classes: partners lie in the same or the next.
    Smaller rows link only if they are equal."""
    out = [-(-percent // (100 - percent))]
    while out[-1] < 1 << 40:
        out.append(out[-1] * 100 // percent + 1)
    return out


def class_of(n: int, percent: int) -> int:
    return bisect_right(bounds(percent), n) - 1


def blocks_of(c: int, percent: int) -> int:
    d = differing(bounds(percent)[c + 1] - 1, percent)
    return max(min(d + 2, 64), d * 10 // 16)


def classes(n: int, percent: int) -> list[int]:
    """Classes under which a row of size n meets its possible partners."""
    c = class_of(n, percent)
    if c < 0:
        return []
    return [c] if c == 0 or percent * n > 100 * (bounds(percent)[c] - 1) else [c - 1, c]


def rows_of(texts: pa.Array, n: int = 3) -> list[np.ndarray]:
    """The sorted n-gram hashes of each text."""
    words = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(texts, "")), r"[ \t\n\v\f\r]+")
    coded = words.flatten().dictionary_encode()
    names = coded.dictionary.to_pylist()
    hashes = np.array([xxhash.xxh64_intdigest(w.encode()) for w in names], U) if names else np.zeros(0, U)
    code = coded.indices.to_numpy(zero_copy_only=False)
    full = np.array([w != "" for w in names], bool)[code] if names else np.zeros(0, bool)
    offsets = words.offsets.to_numpy()
    ends = np.concatenate([[0], np.cumsum(full)])[offsets - offsets[0]]
    h = hashes[code[full]]
    grams = h
    for k in range(1, n):
        grams = mix(grams[: max(0, len(h) - k)] * U(0x9E3779B97F4A7C15) + h[k:])
    out = []
    for a, z in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        if z - a >= n:
            out.append(np.unique(grams[a : z - n + 1]))
        elif z > a:
            one = mix(U(z - a) + h[a:z][:1])
            for x in h[a + 1 : z]:
                one = mix(one * U(0x9E3779B97F4A7C15) + x)
            out.append(one)
        else:
            out.append(np.zeros(0, U))
    return out


def signatures(row: np.ndarray, c: int, percent: int) -> np.ndarray:
    """A number for each block of the row under class c. Blocks without entries
    are left out where the row has at most one such."""
    k = blocks_of(c, percent)
    part = ((row >> U(32)) * U(k)) >> U(32)
    n = np.bincount(part.astype(np.int64), minlength=k)
    upto = np.concatenate([[0], np.cumsum(n)])
    total = np.concatenate([np.zeros(1, U), np.cumsum(mix(row), dtype=U)])
    sigs = mix((total[upto[1:]] - total[upto[:-1]]) + mix(np.arange(k, dtype=U) + U(c << 32)))
    return sigs[n > 0] if (n == 0).sum() <= 1 else sigs


def sketch(row: np.ndarray, c: int, percent: int) -> bytes:
    """Parities of the row's entries by a second hash, 8 bits a block."""
    bits = -(-blocks_of(c, percent) // 8) * 64
    at = (((row * U(0xD6E8FEB86659FD93)) >> U(32)) * U(bits)) >> U(32)
    return np.packbits(np.bincount(at.astype(np.int64), minlength=bits) & 1).tobytes()


def may_link(distance, a, b, percent: int):
    return distance * (100 + percent) <= (100 - percent) * (a + b)


ROWS = "doc_id long, n long, own int, digest binary, sigs array<binary>, sketches array<binary>"


def _describe(batches: Iterator[pa.RecordBatch], n: int, percent: int) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("own", pa.int32()), ("digest", pa.binary()), ("sigs", pa.list_(pa.binary())), ("sketches", pa.list_(pa.binary()))])
    for b in batches:
        ids, at = b.column(0), 0
        for texts in slices(b.column(1), SLICE):
            rows = rows_of(texts, n)
            meets = [classes(len(r), percent) for r in rows]
            yield pa.RecordBatch.from_arrays(
                [
                    ids.slice(at, len(texts)).cast(pa.int64()),
                    pa.array([len(r) for r in rows], pa.int64()),
                    pa.array([class_of(len(r), percent) for r in rows], pa.int32()),
                    pa.array([xxhash.xxh3_128_digest(r.tobytes()) for r in rows], pa.binary()),
                    pa.array([[signatures(r, c, percent).tobytes() for c in cs] for r, cs in zip(rows, meets, strict=True)], pa.list_(pa.binary())),
                    pa.array([[sketch(r, c, percent) for c in cs] for r, cs in zip(rows, meets, strict=True)], pa.list_(pa.binary())),
                ],
                schema=schema,
            )
            at += len(texts)


def _dealt(batches: Iterator[pa.RecordBatch], buckets: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Block signatures of many rows, packed by bucket."""
    for b in batches:
        sig, doc, cls = [np.zeros(0, U)], [np.zeros(0, np.int64)], [np.zeros(0, np.int16)]
        for d, n, sigs in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            for c, s in zip(classes(n, percent), sigs, strict=True):
                own = np.frombuffer(s, U)
                sig.append(own)
                doc.append(np.full(len(own), d))
                cls.append(np.full(len(own), c, np.int16))
        sig, doc, cls = np.concatenate(sig), np.concatenate(doc), np.concatenate(cls)
        to = (sig % U(buckets)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        to = to[order]
        cut = np.flatnonzero(np.diff(to, prepend=-1))
        split = lambda x: pa.array([y.tobytes() for y in np.split(x[order], cut[1:])] if len(cut) else [], pa.binary())  # noqa: E731, B023
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(to[cut], pa.int32()), "sig": split(sig), "doc": split(doc), "cls": split(cls)})


def _grouped(t: pa.Table) -> pa.Table:
    """Groups of rows that are equal in a block, one of those with the same members."""
    sig, docs, classes_ = (np.frombuffer(b"".join(t.column(c).to_pylist()), d) for c, d in (("sig", U), ("doc", np.int64), ("cls", np.int16)))
    order = np.argsort(sig, kind="stable")
    sig, docs, classes_ = sig[order], docs[order], classes_[order]
    start = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]])) if len(sig) else np.zeros(0, np.int64)
    size = np.diff(np.append(start, len(sig)))
    big = size > 1
    seen, gid, cls, doc, chunk = set(), [], [], [], []
    for a, n in zip(start[big].tolist(), size[big].tolist(), strict=True):
        members = np.unique(docs[a : a + n])
        if len(members) < 2:
            continue
        c = int(classes_[a])
        name = xxhash.xxh64_intdigest(members.tobytes(), c) - (1 << 63)
        if name not in seen:
            seen.add(name)
            doc.append(members)
            gid.append(np.full(len(members), name))
            cls.append(np.full(len(members), c))
            # the leader of a long group is in each of its chunks
            chunk.append(np.arange(len(members)) // CHUNK)
    cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return pa.table({"gid": pa.array(cat(gid), pa.int64()), "cls": pa.array(cat(cls), pa.int32()), "chunk": pa.array(cat(chunk), pa.int64()), "doc": pa.array(cat(doc), pa.int64())})


def _sketches(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, n, sketch matrix) of a group, by doc."""
    order = np.argsort(t.column("doc").to_numpy(), kind="stable")
    m = np.frombuffer(b"".join(t.column("sketch").to_pylist()), U).reshape(t.num_rows, -1)
    return t.column("doc").to_numpy()[order], t.column("n").to_numpy()[order], m[order]


def _pairs(a: list, b: list) -> pa.Table:
    cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return pa.table({"a": pa.array(cat(a), pa.int64()), "b": pa.array(cat(b), pa.int64())})


def _led(t: pa.Table, percent: int) -> pa.Table:
    """Each member beside the first leader that the bounds allow; one without is
    a leader from then on."""
    doc, n, m = _sketches(t)
    free, a, b = np.arange(len(doc)), [], []
    while len(free) > 1:
        lead, rest = free[0], free[1:]
        near = may_link(np.bitwise_count(m[rest] ^ m[lead]).sum(1, dtype=np.int64), n[rest], n[lead], percent)
        a.append(np.full(int(near.sum()), doc[lead]))
        b.append(doc[rest[near]])
        free = rest[~near]
    return _pairs(a, b)


def _apart(t: pa.Table, percent: int) -> pa.Table:
    """Pairs that the bounds allow between different components of a group: some of
    its rows outside the main component (``side``) by some of all its rows. Two that
    are both outside meet twice and count where the greater one isn't ``side``. Near
    rows share many groups and are compared in each of them, so a pair that has met in
    a lesser one (of ``gids``) isn't given again: the least that both are in gives it."""
    (x, xn, xm), (y, yn, ym) = (_sketches(t.filter(pa.array(t.column("side").to_numpy(zero_copy_only=False) == s))) for s in (True, False))
    own = dict(zip(t.column("doc").to_pylist(), t.column("component").to_pylist(), strict=True))
    outside = dict(zip(t.column("doc").to_pylist(), t.column("minor").to_pylist(), strict=True))
    xc, yc = (np.array([own[i] for i in d.tolist()], np.int64) for d in (x, y))
    minor = np.array([outside[i] for i in y.tolist()], bool)
    gid = t.column("gid")[0].as_py() if len(x) else 0
    lesser = {d: {g for g in gs if g < gid} for d, gs in zip(t.column("doc").to_pylist(), t.column("gids").to_pylist(), strict=True)}
    a, b = [], []
    for i in range(len(x)):
        other = np.flatnonzero((yc != xc[i]) & (~minor | (y > x[i])))
        near = other[may_link(np.bitwise_count(ym[other] ^ xm[i]).sum(1, dtype=np.int64), yn[other], xn[i], percent)]
        mine = lesser[int(x[i])]
        new = np.array([j for j in y[near].tolist() if mine.isdisjoint(lesser[j])], np.int64)
        a.append(np.full(len(new), x[i]))
        b.append(new)
    return _pairs(a, b)


def _multiplied(t: pa.Table, percent: int) -> pa.Table:
    """One row by the rows of its block: overlaps, and the pairs they keep."""
    lead = t.column("lead").to_numpy(zero_copy_only=False)
    doc, rows = t.column("doc").to_numpy(), t.column("row").to_pylist()
    (at,) = np.flatnonzero(lead)[:1]
    mine = np.frombuffer(rows[at], U)
    a, b = [], []
    others = np.flatnonzero(~lead)
    for some in np.array_split(others, max(1, len(others) // 256)):
        parts = [np.frombuffer(rows[i], U) for i in some]
        size = np.array([len(p) for p in parts])
        flat = np.concatenate(parts)
        place = np.minimum(np.searchsorted(mine, flat), len(mine) - 1)
        both = np.add.reduceat((mine[place] == flat).astype(np.int64), np.concatenate([[0], np.cumsum(size)[:-1]]))
        link = 100 * both >= percent * (size + len(mine) - both)
        a.append(np.full(int(link.sum()), doc[at]))
        b.append(doc[some[link]])
    return _pairs(a, b)


PAIR = "a long, b long"


def linked(pairs: DataFrame, docs: DataFrame, n: int, percent: int, reps: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes whose overlap makes a link."""
    pairs = written(pairs.distinct(), "pairs")
    nodes = pairs.select(F.col("a").alias("doc")).union(pairs.select("b")).distinct()
    nodes = written(nodes.join(reps, nodes.doc == reps["class"]).select("doc", "rep", "digest"), "nodes")
    some = docs.join(nodes, docs.doc_id == nodes.rep, "left_semi").select("doc_id", "text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for texts in slices(b.column(1), SLICE):
                sets = [r.tobytes() for r in rows_of(texts, n)]
                yield pa.RecordBatch.from_pydict({"rep": b.column(0).slice(at, len(texts)).cast(pa.int64()), "digest": pa.array([xxhash.xxh3_128_digest(x) for x in sets], pa.binary()), "row": pa.array(sets, pa.binary())})
                at += len(texts)

    sets = some.mapInArrow(trimmed_stream(rows), "rep long, digest binary, row binary")
    sets = written(sets.join(nodes, ["rep", "digest"]).select("doc", "row"), "rows")
    part = F.pmod(F.xxhash64("b"), F.greatest(F.lit(1), F.ceil(F.col("k") / CHUNK))).cast("long")
    sized = pairs.join(pairs.groupBy("a").agg(F.count("*").alias("k")), "a").select("a", "b", part.alias("part"))
    heads = sized.select("a", "part").distinct()
    block = (
        sized.join(sets, sized.b == sets.doc).select("a", "part", "doc", "row", F.lit(False).alias("lead"))
        .unionByName(heads.join(sets, heads.a == sets.doc).select("a", "part", "doc", "row", F.lit(True).alias("lead")))
    )
    return block.groupBy("a", "part").applyInArrow(lambda t: _multiplied(t, percent), PAIR)


@finished("jaccard-groups")
def clustered(docs: DataFrame, n: int = 3, percent: int = 90, buckets: int | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = written(docs.mapInArrow(trimmed_stream(lambda b: _describe(b, n, percent)), ROWS), "incidence")
    if buckets is None:
        buckets = max(32, rows.count() // 3000)
    named = rows.filter("n > 0 AND doc_id IS NOT NULL")
    # Classes get numbers, as an id may carry texts of several; from here to the names
    # of components ``doc`` is the number of a class.
    reps = written(named.groupBy("digest").agg(F.min("doc_id").alias("rep")).withColumn("class", F.monotonically_increasing_id()), "classes")
    least = bounds(percent)[0]
    distinct = named.filter(F.col("n") >= least).withColumnRenamed("doc_id", "rep").join(reps, ["rep", "digest"]).withColumnRenamed("class", "doc")
    entries = distinct.select("doc", "n", "sigs").mapInArrow(trimmed_stream(lambda b: _dealt(b, buckets, percent)), "bucket int, sig binary, doc binary, cls binary")
    groups = entries.groupBy("bucket").applyInArrow(trimmed(lambda t: _grouped(t)), "gid long, cls int, chunk long, doc long")
    groups = written(groups.dropDuplicates(["gid", "doc"]), "groups")
    info = distinct.select("doc", "n", "own", "sketches").join(groups.select("doc").distinct(), "doc", "left_semi").dropDuplicates(["doc"])
    # A row's last sketch is that of its own class, the first may be of the one below.
    place = F.when(F.col("cls") == F.col("own"), F.size("sketches")).otherwise(1)
    members = written(groups.join(info, "doc").select("gid", "chunk", "doc", "n", F.element_at("sketches", place).alias("sketch")), "members")
    # The leader of a long group is in each of its chunks.
    heads = members.filter("chunk = 0").groupBy("gid").agg(F.min_by(F.struct("doc", "n", "sketch"), "doc").alias("h"))
    others = members.filter("chunk > 0").select("gid", "chunk").distinct()
    led = members.unionByName(others.join(heads, "gid").select("gid", "chunk", "h.doc", "h.n", "h.sketch"))
    first = linked(led.groupBy("gid", "chunk").applyInArrow(trimmed(lambda t: _led(t, percent)), PAIR), docs, n, percent, reps)
    comp = written(components(first), "components")
    label = members.join(comp, members.doc == comp.node, "left").select("gid", "chunk", "doc", "n", "sketch", F.coalesce("component", "doc").alias("component"))
    # What is outside a group's main component, by all of the group, chunk by chunk.
    counts = label.groupBy("gid", "component").agg(F.count("*").alias("k"))
    main = counts.groupBy("gid").agg(F.max_by("component", F.struct("k", -F.col("component"))).alias("main"), F.count("*").alias("kinds")).filter("kinds > 1")
    main = written(main, "mains")
    gids = F.slice(F.array_sort(F.collect_list("gid")), 1, MET).alias("gids")
    met = members.select("gid", "doc").join(main, "gid", "left_semi").groupBy("doc").agg(gids)
    label = written(label.join(met, "doc").join(main, "gid").withColumn("minor", F.col("component") != F.col("main")).drop("main", "kinds"), "apart")
    chunks = label.select("gid", F.col("chunk").alias("by")).distinct()
    sides = label.filter("minor").select("gid", F.col("chunk").alias("from")).distinct()
    left = label.filter("minor").join(chunks, "gid").select("gid", F.col("chunk").alias("from"), "by", "doc", "n", "sketch", "component", "minor", "gids", F.lit(True).alias("side"))
    right = label.join(sides, "gid").select("gid", "from", F.col("chunk").alias("by"), "doc", "n", "sketch", "component", "minor", "gids", F.lit(False).alias("side"))
    apart = left.unionByName(right).groupBy("gid", "from", "by").applyInArrow(trimmed(lambda t: _apart(t, percent)), PAIR)
    second = linked(apart, docs, n, percent, reps)
    carried = written(named.select("doc_id", "digest").join(reps, "digest").select("doc_id", "class", "rep").distinct(), "carried")
    ids = carried.groupBy("doc_id").agg(F.min("class").alias("class"), F.min("rep").alias("rep"), F.count("*").alias("k"))
    several = ids.filter("k > 1").select(F.col("doc_id").alias("_id"), F.col("class").alias("_least"))
    tied = carried.join(several, F.col("doc_id") == F.col("_id")).filter("class <> _least").select("_least", "class")
    # The components stand for the links of the first round.
    comp = written(components(second.union(comp.select("node", "component")).union(tied)), "components")
    names = comp.join(reps, comp.node == reps["class"]).groupBy("component").agg(F.min("rep").alias("name"))
    comp = comp.join(names, "component").select("node", "name")
    of_id = ids.join(comp, ids["class"] == comp.node, "left").select(F.col("doc_id").alias("_id"), F.coalesce("name", "rep").alias("name"))
    out = rows.select("doc_id", "n").join(of_id, F.col("doc_id") == F.col("_id"), "left")
    named_by = F.when(F.col("doc_id").isNotNull(), F.coalesce("name", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), named_by.alias("component_id"))
