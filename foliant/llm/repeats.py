"""Suffix-array dedup of long repeats by run-length indexes.

Bytes covered by a string of ``WINDOW`` bytes that also starts earlier (in a
smaller document, or earlier in the same one) are removed; all strings are judged
on the input. Texts are dealt by content, so that no index is larger than a task:

1. Each window of 100 bytes has an anchor, the least hash among its 32-byte
   substrings; equal windows have equal anchors at equal places. Neighbouring
   windows with one anchor form a phrase. Anchor hashes are counted.
2. Only phrases whose anchor occurs twice can hold a repeat. Their bytes go to
   the anchor's bucket; of phrases equal within a task the first alone.
3. A bucket builds the Burrows-Wheeler transform of its distinct phrases, keeps
   it as runs with the suffix positions at run ends, and streams the matching
   statistics in text order: at a sampled position the match with the suffix
   before it in order is measured, at the next one it is one shorter until the
   next sample. Matches of 100 bytes or more tie suffixes to classes; all but the
   first of a class are marked. An index holds ``INDEX_BYTES`` and whole anchors, as
   equal windows have equal anchors; an anchor of more is parted by the anchor's
   place in its windows and by the bytes around it that all windows of a part hold.
4. Marks return to the documents, are joined to runs of bytes and cut out.

A very common passage is one phrase per task; no step makes pairs of documents.

Defined results: a null or empty text has no bytes; a null ``doc_id`` is smaller
than all others; rows equal in id and text are one document, both get its result;
of unequal texts under one id the one of smaller digest is earlier; other columns
pass through ``cut`` and are ignored by ``digest``. Cutting works on bytes: where
a cut runs through a character, ``cut`` drops what is left of the character.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from foliant.llm.common import finished, trimmed, trimmed_stream
from foliant.llm.token_files import slices

WINDOW = 100
GRAM = 32
SPAN = WINDOW - GRAM + 1
CHUNK = 1 << 16
#: Text for each part of the documents and for each bucket of phrases.
PART_BYTES = 6 << 20
BUCKET_BYTES = 3 << 20
#: Text that one index holds.
INDEX_BYTES = 1 << 20
PLACE = np.uint64((1 << 20) - 1)
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
NULL_ID = -(1 << 63)
U = np.uint64
HIT = np.dtype([("doc", "<i8"), ("h", "<u8")])
META = np.dtype([("h", "<u8"), ("doc", "<i8"), ("dig", "<u8"), ("a", "<i4"), ("n", "<u2"), ("o", "<u2")])
MARK = np.dtype([("doc", "<i8"), ("dig", "<u8"), ("s", "<i4"), ("e", "<i4")])


def _words8(x: np.ndarray, n: int) -> np.ndarray:
    """The 8 bytes from each of the first n places of ``x`` (n + 7 bytes at least)."""
    out = np.empty(n + 8, U)
    data = x.tobytes()
    data += bytes(16)
    for i in range(8):
        part = np.frombuffer(data, U, (n + 7 - i) // 8, i)
        out[i : i + 8 * len(part) : 8] = part
    return out[:n]


def _grams(v: np.ndarray) -> np.ndarray:
    """Hashes of the 32 bytes from each place, from the 8-byte words there."""
    n = len(v) - 24
    h = v[:n] * U(0x9E3779B97F4A7C15)
    h ^= h >> U(32)
    h += v[8 : n + 8] * U(0xC2B2AE3D27D4EB4F)
    h ^= h >> U(29)
    h *= U(0xBF58476D1CE4E5B9)
    h += v[16 : n + 16] * U(0x165667B19E3779F9)
    h ^= h >> U(31)
    h += v[24 : n + 24] * U(0xD6E8FEB86659FD93)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(32)
    return h


def _least(x: np.ndarray, w: int) -> np.ndarray:
    """The minimum of each w neighbours."""
    size = 1
    while size * 2 <= w:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (w - size)], x[w - size :]) if size < w else x


def phrases(buf: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, windows, anchor's place, anchor's hash) of all phrases of
    the documents that end at ``ends`` in ``buf``."""
    total = len(buf)
    cross = (ends[:, None] - np.arange(1, WINDOW)).ravel()
    bad = np.zeros(total, bool)
    bad[cross[cross >= 0]] = True
    out: list[tuple] = []
    for c in range(0, total - WINDOW + 1, CHUNK):
        n = min(CHUNK, total - WINDOW + 1 - c)
        h = _grams(_words8(buf[c : c + n + WINDOW - 1], n + WINDOW - 8))[: n + SPAN - 1]
        m = _least((h & ~PLACE) | np.arange(len(h), dtype=U), SPAN)
        m[bad[c : c + n]] = NONE
        at = np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1]]))
        size = np.diff(np.append(at, n))
        real = m[at] != NONE
        at, size = at[real], size[real]
        place = (m[at] & PLACE).astype(np.int64)
        out.append((at + c, size, place + c, h[place]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _joined(values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(values), np.uint8), np.cumsum([len(v) for v in values])


def _by(target: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, list[list[bytes]]]:
    """Rows of each target together: the targets, and bytes of each column."""
    order = np.argsort(target, kind="stable")
    t = target[order]
    cut = np.flatnonzero(np.diff(t, prepend=-1))
    return t[cut], [[x.tobytes() for x in np.split(c[order], cut[1:])] if len(cut) else [] for c in columns]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.int64).view(U) * U(0x9E3779B97F4A7C15)
    return x ^ (x >> U(32))


def _unpack(t: pa.Table, column: str, kind: np.dtype) -> np.ndarray:
    return np.frombuffer(b"".join(x for x in t.column(column).to_pylist() if x), kind)


def _count_anchors(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """(bucket, hits, known): the first document of each anchor in a slice to the
    anchor's bucket; anchors seen twice here are known to repeat."""
    for b in batches:
        at = 0
        for texts in slices(b.column(1)):
            docs = pc.fill_null(b.column(0).slice(at, len(texts)).cast(pa.int64()), NULL_ID).to_numpy(zero_copy_only=False)
            at += len(texts)
            buf, ends = _joined([x.encode() for x in pc.fill_null(texts, "").to_pylist()])
            a, _, _, h = phrases(buf, ends)
            hits = np.empty(len(h), HIT)
            hits["doc"], hits["h"] = docs[np.searchsorted(ends, a, "right")], h
            order = np.argsort(h, kind="stable")
            hits = hits[order]
            same = hits["h"][1:] == hits["h"][:-1]
            first = np.concatenate([[True], ~same])[: len(hits)]
            twice = np.concatenate([same, [False]])[: len(hits)]
            known = hits[~first]
            # One row for each anchor goes on, and a second where it repeats here.
            lead = np.concatenate([hits[first], hits[first & twice]])
            to, (rows,) = _by((lead["h"] % U(buckets)).astype(np.int64), lead)
            yield pa.RecordBatch.from_pydict({"bucket": pa.array(to, pa.int32()), "hits": pa.array(rows, pa.binary()), "known": pa.array([None] * len(to), pa.binary())})
            to, (rows,) = _by((_mixed(known["doc"]) % U(buckets)).astype(np.int64), known)
            yield pa.RecordBatch.from_pydict({"bucket": pa.array(to, pa.int32()), "hits": pa.array([None] * len(to), pa.binary()), "known": pa.array(rows, pa.binary())})


def _repeating(t: pa.Table, parts: int) -> pa.Table:
    hits, known = _unpack(t, "hits", HIT), _unpack(t, "known", HIT)
    hits = hits[np.argsort(hits["h"], kind="stable")]
    same = hits["h"][1:] == hits["h"][:-1]
    more = np.zeros(len(hits), bool)
    more[1:] |= same
    more[:-1] |= same
    out = np.concatenate([np.unique(hits[more]), known])
    to, (rows,) = _by((_mixed(out["doc"]) % U(parts)).astype(np.int64), out)
    return pa.table({"part": pa.array(to, pa.int32()), "hits": pa.array(rows, pa.binary())})


def _first_of_each(key: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, repeats) by position of equal keys; the same place twice is no repeat."""
    order = np.lexsort((meta["a"], meta["dig"], meta["doc"], key))
    k, m = key[order], meta[order]
    new = np.concatenate([[True], k[1:] != k[:-1]])[: len(k)]
    start = np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))
    lead = m[start]
    again = (m["doc"] != lead["doc"]) | (m["dig"] != lead["dig"]) | (m["a"] != lead["a"])
    return order[new], order[again]


def _marks(meta: np.ndarray) -> np.ndarray:
    """All bytes of whole phrases."""
    out = np.empty(len(meta), MARK)
    out["doc"], out["dig"], out["s"] = meta["doc"], meta["dig"], meta["a"]
    out["e"] = meta["a"] + meta["n"].astype(np.int64) + WINDOW - 1
    return out


def _send(docs: pa.Table, hits: pa.Table, buckets: int) -> pa.Table:
    """(bucket, meta, bytes, marks): the phrases of one part of the documents
    whose anchors repeat. Equal ones but the first are marked here."""
    un = zstandard.ZstdDecompressor().decompress
    values = [un(x) for x in docs.column("packed").to_pylist()]
    ids = docs.column("doc").to_numpy()
    dig = docs.column("dig").to_numpy().view(U)
    known = np.unique(_unpack(hits, "hits", HIT))
    out: dict[str, list] = {"bucket": [], "meta": [], "bytes": [], "marks": []}
    at = 0
    while at < len(values):
        to, size = at, 0
        while to < len(values) and (to == at or size < 8 << 20):
            size += len(values[to])
            to += 1
        buf, ends = _joined(values[at:to])
        a, n, p, h = phrases(buf, ends)
        own = np.searchsorted(ends, a, "right")
        row = np.empty(len(a), HIT)
        row["doc"], row["h"] = ids[at + own], h
        place = np.minimum(np.searchsorted(known, row), max(0, len(known) - 1))
        keep = known[place] == row if len(known) else np.zeros(len(a), bool)
        a, n, p, h, own = a[keep], n[keep], p[keep], h[keep], own[keep]
        meta = np.empty(len(a), META)
        start = np.concatenate([[0], ends])[own]
        meta["h"], meta["doc"], meta["dig"], meta["a"], meta["n"], meta["o"] = h, ids[at + own], dig[at + own], a - start, n, p - a
        data = buf.tobytes()
        text = np.array([data[x : x + y + WINDOW - 1] for x, y in zip(a.tolist(), n.tolist(), strict=True)], object)
        key = np.array([xxhash.xxh64_intdigest(x) for x in text], U)
        first, again = _first_of_each(key, meta)
        to_b = (meta["h"][first] % U(buckets)).astype(np.int64)
        order = np.argsort(to_b, kind="stable")
        first, to_b = first[order], to_b[order]
        cut = np.flatnonzero(np.diff(to_b, prepend=-1)).tolist()
        for x, y in zip(cut, [*cut, len(first)][1:], strict=True):
            out["bucket"].append(int(to_b[x]))
            out["meta"].append(meta[first[x:y]].tobytes())
            out["bytes"].append(b"".join(text[first[x:y]]))
            out["marks"].append(None)
        if len(again):
            out["bucket"].append(int(_mixed(ids[at : at + 1])[0] % U(buckets)))
            for name, v in (("meta", None), ("bytes", None), ("marks", _marks(meta[again]).tobytes())):
                out[name].append(v)
        at = to
    return pa.table({"bucket": pa.array(out["bucket"], pa.int32()), **{c: pa.array(out[c], pa.binary()) for c in ("meta", "bytes", "marks")}})


class RunIndex:
    """A run-length Burrows-Wheeler transform of distinct phrases, each ended by a
    sign of its own, with the suffix positions at the ends of runs."""

    def __init__(self, texts: list[bytes]):
        size = np.array([len(x) for x in texts], np.int64)
        self.text = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
        self.start = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
        self.phrase = np.repeat(np.arange(len(texts)), size + 1)
        self.left = np.repeat(self.start + size, size + 1) - np.arange(len(self.text))
        self.order = self._suffixes()
        before = self.text[self.order - 1].astype(np.int16)
        at_start = self.left[self.order] == size[self.phrase[self.order]]
        change = np.concatenate([[True], (before[1:] != before[:-1]) | at_start[1:] | at_start[:-1]])
        #: Runs of the transform: their signs, first rows and sampled suffixes.
        self.heads = np.flatnonzero(change)
        self.signs = before[self.heads]
        self.samples = self.order[self.heads]
        self.ends = np.where(self.heads > 0, self.order[self.heads - 1], -1)

    def _suffixes(self) -> np.ndarray:
        """The suffix array, by prefix doubling of what is still tied."""
        n, parts = len(self.text), len(self.start)
        sign = np.concatenate([self.text.astype(np.int64) + 1, np.zeros(8, np.int64)])
        key = np.zeros(n, np.int64)
        for t in range(7):
            key = key << 9 | np.where(self.left > t, sign[t : n + t], 0)
        sa = np.argsort(key, kind="stable")
        new = np.concatenate([[True], key[sa][1:] != key[sa][:-1]])
        rank = np.empty(n, np.int64)
        rank[sa] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        tied = ~new
        tied[:-1] |= ~new[1:]
        slots, k = np.flatnonzero(tied), 7
        while len(slots):
            pos = sa[slots]
            far = self.left[pos] >= k
            second = np.where(far, parts + rank[np.where(far, pos + k, 0)], self.phrase[pos])
            key = rank[pos] * (n + parts) + second
            o = np.argsort(key, kind="stable")
            pos, key = pos[o], key[o]
            sa[slots] = pos
            new = np.concatenate([[True], key[1:] != key[:-1]])
            rank[pos] = slots[np.maximum.accumulate(np.where(new, np.arange(len(pos)), 0))]
            tied = ~new
            tied[:-1] |= ~new[1:]
            slots, k = slots[tied], 2 * k
        return sa

    def _common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Bytes that the suffixes at x and y share."""
        most = np.minimum(self.left[x], self.left[y])
        words = _words8(np.concatenate([self.text, np.zeros(8, np.uint8)]), len(self.text))
        out, live = np.zeros(len(x), np.int64), np.flatnonzero(most > 0)
        while len(live):
            d = words[np.minimum(x[live] + out[live], len(words) - 1)] ^ words[np.minimum(y[live] + out[live], len(words) - 1)]
            low = d & (~d + U(1))
            out[live] += np.where(d == 0, 8, np.log2(np.maximum(low, U(1)).astype(np.float64)).astype(np.int64) >> 3)
            live = live[(d == 0) & (out[live] < most[live])]
        return np.minimum(out, most)

    def statistics(self) -> tuple[np.ndarray, np.ndarray]:
        """For each suffix in text order the one before it in suffix order (-1:
        none) and the bytes they share, carried on from the sampled run ends."""
        n = len(self.text)
        known, of, share = np.zeros(n, bool), np.full(n, -1), np.zeros(n, np.int64)
        known[self.samples] = True
        real = self.ends >= 0
        of[self.samples] = self.ends
        share[self.samples[real]] = self._common(self.samples[real], self.ends[real])
        last = np.maximum.accumulate(np.where(known, np.arange(n), 0))
        step = np.arange(n) - last
        return np.where(of[last] >= 0, of[last] + step, -1), share[last] - step

    def repeated(self, least: int) -> np.ndarray:
        """Whether the ``least`` bytes from each place also start in an earlier phrase."""
        _, share = self.statistics()
        tied = share[self.order] >= least
        start = np.flatnonzero(~tied)
        first = np.minimum.reduceat(self.phrase[self.order], start)
        group = np.cumsum(~tied) - 1
        out = np.zeros(len(self.text), bool)
        out[self.order] = (self.phrase[self.order] > first[group]) & (self.left[self.order] >= least)
        return out


def _chunks(key: np.ndarray, size: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Positions of phrases, those of one key together, ``most`` bytes at once and
    more for a single key only."""
    order = np.argsort(key, kind="stable")
    at = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1], [True]])) if len(key) else np.zeros(1, np.int64)
    upto = np.concatenate([[0], np.cumsum(size[order])])[at]
    a = 0
    while a < len(at) - 1:
        z = max(a + 1, int(np.searchsorted(upto, upto[a] + most, "right")) - 1)
        yield order[at[a] : at[z]]
        a = z


def _halves(meta: np.ndarray, text: list[bytes], low: int, high: int) -> Iterator[tuple]:
    """(phrases, texts, keys, low, high): windows whose anchor is ``low`` to ``high``
    bytes from their start, in two halves of that range, both longer by what all their
    windows hold beside the anchor: equal windows have equal keys."""
    mid = (low + high) // 2
    o, n = meta["o"].astype(np.int64), meta["n"].astype(np.int64)
    fore = np.clip(o - mid + 1, 0, n)
    for a, z, lo, hi in ((0 * n, fore, mid, high), (fore, n, low, mid)):
        real = np.flatnonzero(z > a)
        part = meta[real]
        part["a"] += a[real].astype(np.int32)
        part["o"] -= a[real].astype(np.uint16)
        part["n"] = (z - a)[real]
        own = [text[i][x : y + WINDOW - 1] for i, x, y in zip(real.tolist(), a[real].tolist(), z[real].tolist(), strict=True)]
        key = np.array([xxhash.xxh64_intdigest(x[p - lo : p - hi + 1 + WINDOW]) for x, p in zip(own, part["o"].tolist(), strict=True)], U)
        yield part, own, key, lo, hi


def _index_marks(meta: np.ndarray, text: list[bytes]) -> np.ndarray:
    """Marks within distinct phrases."""
    order = np.lexsort((meta["a"].astype(np.int64) + meta["o"], meta["dig"], meta["doc"]))
    index = RunIndex([text[i] for i in order])
    hit = index.repeated(WINDOW)
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    own = index.phrase[s]
    m = meta[order[own]]
    out = np.empty(len(s), MARK)
    out["doc"], out["dig"] = m["doc"], m["dig"]
    out["s"] = m["a"] + s - index.start[own]
    out["e"] = m["a"] + e - index.start[own] + WINDOW - 1
    return out


def _indexed(t: pa.Table, parts: int) -> pa.Table:
    """Marks of one bucket, by part of the documents."""
    marks = [_unpack(t, "marks", MARK)]
    meta = _unpack(t, "meta", META)
    data = b"".join(x for x in t.column("bytes").to_pylist() if x)
    to = np.cumsum(meta["n"].astype(np.int64) + WINDOW - 1).tolist()
    todo = [(meta, [data[a:z] for a, z in zip([0, *to][:-1], to, strict=True)], meta["h"], 0, SPAN)]
    while todo:
        meta, text, key, low, high = todo.pop()
        for some in _chunks(key, meta["n"].astype(np.int64) + WINDOW - 1, INDEX_BYTES):
            m, own = meta[some], [text[i] for i in some.tolist()]
            first, again = _first_of_each(np.array([xxhash.xxh64_intdigest(x) for x in own], U), m)
            marks.append(_marks(m[again]))
            m, own = m[first], [own[i] for i in first.tolist()]
            if high - low > 1 and sum(map(len, own)) > INDEX_BYTES:
                todo += _halves(m, own, low, high)
            else:
                marks.append(_index_marks(m, own))
    all_ = np.concatenate(marks)
    to, (rows,) = _by((_mixed(all_["doc"]) % U(parts)).astype(np.int64), all_)
    return pa.table({"part": pa.array(to, pa.int32()), "marks": pa.array(rows, pa.binary())})


def _packed(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """(part, doc, dig, packed) of texts, compressed for the shuffle."""
    z = zstandard.ZstdCompressor(level=1)
    for b in batches:
        values = [x.encode() for x in pc.fill_null(b.column(1), "").to_pylist()]
        docs = pc.fill_null(b.column(0).cast(pa.int64()), NULL_ID).to_numpy(zero_copy_only=False)
        rest = {f"_{i}": b.column(2 + i) for i in range(b.num_columns - 2)}
        yield pa.RecordBatch.from_pydict(
            {
                "part": pa.array((_mixed(docs) % U(parts)).astype(np.int32)),
                "doc": pa.array(docs),
                "dig": pa.array(np.array([xxhash.xxh64_intdigest(v) for v in values], U).view(np.int64)),
                "packed": pa.array([z.compress(v) for v in values], pa.binary()),
                "null": b.column(1).is_null(),
                **rest,
            }
        )


def _spans(marks: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
    """Maximal runs of marked bytes of each document."""
    marks = marks[np.lexsort((marks["s"], marks["dig"], marks["doc"]))]
    out = {}
    cut = np.flatnonzero((marks["doc"][1:] != marks["doc"][:-1]) | (marks["dig"][1:] != marks["dig"][:-1])) + 1
    for m in np.split(marks, cut) if len(marks) else []:
        upto = np.maximum.accumulate(m["e"])
        new = np.concatenate([[True], m["s"][1:] > upto[:-1]])
        last = np.append(np.flatnonzero(new)[1:] - 1, len(m) - 1)
        out[int(m["doc"][0]), int(m["dig"][0])] = np.stack([m["s"][new], upto[last]], 1).astype(np.int64)
    return out


def _rest(value: bytes, spans: np.ndarray | None) -> bytes:
    if spans is None:
        return value
    edges = [0, *spans.ravel().tolist(), len(value)]
    return b"".join(value[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2))


def _marked(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(packed documents, marks), both with their ``part``."""
    # Tasks by bytes: long texts make many phrases.
    size = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    parts, buckets = max(48, size // PART_BYTES), max(64, size // BUCKET_BYTES)
    text, key = F.col(text_col).cast("string").alias("_text"), F.col(id_col).cast("long").alias("_id")
    slim, others = docs.select(key, text), [c for c in docs.columns if c != text_col]
    kinds = ", ".join(f"_{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(others))
    base = "part int, doc long, dig long, packed binary, null boolean"
    whole = docs.select(key, text, *(F.col(c).alias(f"_{i}") for i, c in enumerate(others))).mapInArrow(trimmed_stream(lambda b: _packed(b, parts)), f"{base}, {kinds}")
    counted = slim.mapInArrow(trimmed_stream(lambda b: _count_anchors(b, buckets)), "bucket int, hits binary, known binary")
    hits = counted.groupBy("bucket").applyInArrow(trimmed(lambda t: _repeating(t, parts)), "part int, hits binary")
    lean = slim.mapInArrow(trimmed_stream(lambda b: _packed(b, parts)), base).drop("null")
    sent = lean.groupBy("part").cogroup(hits.groupBy("part")).applyInArrow(trimmed(lambda d, h: _send(d, h, buckets)), "bucket int, meta binary, bytes binary, marks binary")
    marks = sent.groupBy("bucket").applyInArrow(trimmed(lambda t: _indexed(t, parts)), "part int, marks binary")
    return whole, marks


@finished("repeat-digests")
def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    whole, marks = _marked(docs.select(id_col, text_col), id_col, text_col)

    def told(d: pa.Table, m: pa.Table) -> pa.Table:
        un = zstandard.ZstdDecompressor().decompress
        spans = _spans(_unpack(m, "marks", MARK))
        doc, rows = d.column("doc").to_numpy(), []
        for i, dig, x in zip(doc.tolist(), d.column("dig").to_numpy().view(U).tolist(), d.column("packed").to_pylist(), strict=True):
            value, own = un(x), spans.get((i, dig))
            rows.append((len(value), 0 if own is None else int((own[:, 1] - own[:, 0]).sum()), 0 if own is None else len(own), hashlib.sha256(_rest(value, own)).hexdigest()))
        n, removed, k, sha = zip(*rows, strict=True) if rows else ((), (), (), ())
        return pa.table({"doc_id": pa.array(doc, mask=doc == NULL_ID), "n_bytes": pa.array(n, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(k, pa.int64()), "kept_sha256": pa.array(sha, pa.string())})

    return whole.drop("_0").groupBy("part").cogroup(marks.groupBy("part")).applyInArrow(told, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


@finished("without-repeats")
def cut(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the repeats cut out of its texts (null texts stay null)."""
    whole, marks = _marked(docs, id_col, text_col)
    others = [c for c in docs.columns if c != text_col]
    schema = T.StructType([*(T.StructField(f"_{i}", docs.schema[c].dataType) for i, c in enumerate(others)), T.StructField("_text", T.StringType())])
    arrow = to_arrow_schema(schema)

    def kept(d: pa.Table, m: pa.Table) -> pa.Table:
        un = zstandard.ZstdDecompressor().decompress
        spans = _spans(_unpack(m, "marks", MARK))
        out = []
        for i, dig, x, null in zip(d.column("doc").to_pylist(), d.column("dig").to_numpy().view(U).tolist(), d.column("packed").to_pylist(), d.column("null").to_pylist(), strict=True):
            out.append(None if null else _rest(un(x), spans.get((i, dig))).decode(errors="ignore"))
        return pa.table([*(d.column(f"_{k}") for k in range(len(others))), pa.array(out, pa.string())], schema=arrow)

    named = whole.groupBy("part").cogroup(marks.groupBy("part")).applyInArrow(kept, schema)
    return named.select(*(F.col("_text").alias(c) if c == text_col else F.col(f"_{others.index(c)}").alias(c) for c in docs.columns))
