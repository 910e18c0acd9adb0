"""SentencePiece encoding and decoding by a relational lattice.

Texts are cut into units that no piece of the model can span: before each run of
the space sign, and between letters or digits and signs that no piece holds side
by side. Units are made distinct within a block of documents and then overall,
so the lattice is built once for each different unit of the corpus:

* explode the substrings of up to the longest piece's length,
* equi-join them to the piece table (broadcast; a model's size bounds it),
* group the edges by unit, and fold over them with ``aggregate``.

The fold depends on the model's kind. A unigram model's is Viterbi over places.
A BPE model has no path of best score: its pieces' scores are the order of
merges, and the best sum of scores is not what the model encodes. There the same
lattice is folded by merges: the state is the set of boundaries, and each step
takes the edge of best score (leftmost of equals) that spans exactly two symbols.
Characters without a piece become byte pieces, or where the model has none, the
unknown id, one for each run of them. Units of more than ``LONGEST`` characters, for
which the state doesn't fit 64 bits, are encoded by their model's rule as well:
merges with a heap, or the path of least cost.

Ids go back to their blocks, which put documents together by position.

Defined results: null and empty texts have no ids and decode to the empty text;
the space sign in a text decodes to a space, as the model can't tell them apart;
equal texts have equal ids; null ids of documents pass through; repeated rows are
kept; other columns are ignored.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import filesystem, finished, scratch, trim, trimmed, trimmed_stream
from foliant.llm.token_files import slices

SPACE = "▁"
LONGEST = 60
MOST_PIECES = 500_000
#: Bit of an edge that marks a late piece; ids lie below it.
LATE = 1 << 19
#: Text of a block. Larger ones share more units and take more memory.
BLOCK_BYTES = 11 << 20
#: Text whose words are parted at a time.
WORDS_BYTES = 1 << 20
#: Text for each bucket of units.
BUCKET_BYTES = 2 << 20
NULL_ID = -(1 << 63)


@dataclass
class Model:
    """What of a SentencePiece model the lattice needs."""

    pieces: dict[str, tuple[int, float]]
    bytes_: dict[int, int]
    decoded: list[bytes]
    unknown: int
    bpe: bool = True
    longest: int = 0
    cut: re.Pattern = field(default=re.compile("(?!)"))

    @classmethod
    def load(cls, path: str, bpe: bool = True) -> Model:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        plain = {p: (i, sp.get_score(i)) for i, p in enumerate(names) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
        raw = {int(p[3:5], 16): i for i, p in enumerate(names) if sp.is_byte(i)}
        back = {i: b for b, i in raw.items()}
        decoded = [bytes([back[i]]) if i in back else b"" if sp.is_control(i) else " \u2047 ".encode() if sp.is_unknown(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(names)]
        if any(SPACE in p.lstrip(SPACE) for p in plain) or any(p.startswith(SPACE * 2) and p.strip(SPACE) for p in plain):
            raise ValueError("pieces must not span words")
        return cls(plain, raw, decoded, sp.unk_id(), bpe, max(map(len, plain)), cut_of(plain))

    def merged(self, unit: str) -> list[int]:
        """The ids of one unit by merges with a heap."""
        n = len(unit)
        end, prev, live = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap: list[tuple] = []

        def offer(i: int) -> None:
            j = end[i]
            if j < n and (p := self.pieces.get(unit[i : end[j]])):
                heapq.heappush(heap, (-p[1], i, j, end[j]))

        for i in range(n):
            offer(i)
        while heap:
            _, i, j, e = heapq.heappop(heap)
            if live[i] and j < n and live[j] and end[i] == j and end[j] == e:
                live[j], end[i] = False, e
                if e < n:
                    prev[e] = i
                offer(i)
                if prev[i] >= 0:
                    offer(prev[i])
        out: list[int] = []
        at = 0
        while at < n:
            out += self.ids_of(unit[at : end[at]])
            at = end[at]
        return out

    def least_cost(self, unit: str) -> list[int]:
        """The ids of one unit along the path of least cost (unigram models)."""
        n, best, from_ = len(unit), [0.0], [0]
        for j in range(1, n + 1):
            cost, at = best[j - 1] + (self.cost(unit[j - 1])), j - 1
            for i in range(j - 2, max(-1, j - self.longest - 1), -1):
                if (p := self.pieces.get(unit[i:j])) and best[i] - p[1] <= cost:
                    cost, at = best[i] - p[1], i
            best.append(cost)
            from_.append(at)
        out, j = [], n
        while j:
            out.append(self.ids_of(unit[from_[j] : j]))
            j = from_[j]
        return [x for ids in reversed(out) for x in ids]

    @property
    def unknown_cost(self) -> float:
        """That of a character without a piece: ten more than the worst piece's."""
        return 10.0 - min(x for _, x in self.pieces.values())

    def cost(self, char: str) -> float:
        return -p[1] if (p := self.pieces.get(char)) else self.unknown_cost

    def long_unit(self, unit: str) -> list[int]:
        return self.merged(unit) if self.bpe else self.least_cost(unit)

    def ids_of(self, piece: str) -> list[int]:
        if p := self.pieces.get(piece):
            return [p[0]]
        return [self.bytes_[b] for b in piece.encode()] if self.bytes_ else [self.unknown]


def late_pieces(pieces: dict[str, tuple[int, float]]) -> set[str]:
    """Pieces that two symbols of no better score may join to. Where a unit's
    lattice holds none, an edge can be joined only after all edges of better score
    are done with, and one pass over the edges in order makes all merges."""
    out = set()
    for p, (_, score) in pieces.items():
        for k in range(1, len(p)):
            halves = [pieces.get(h, (0, None))[1] if len(h) > 1 else float("inf") for h in (p[:k], p[k:])]
            if None not in halves and min(halves) <= score:
                out.add(p)
                break
    return out


def cut_of(pieces: dict) -> re.Pattern:
    """Places within a unit that no piece spans: between a letter or digit and
    one of the usual signs, as far as the pieces keep them apart."""
    word = re.compile(r"[^\W_]")
    signs = set(".,;:!?|*%&$#\"()[]{}<>=+/\\~^@\n\t\r")
    pairs = {(a, b) for p in pieces for a, b in zip(p, p[1:], strict=False)}
    after = signs - {b for a, b in pairs if word.match(a)}
    before = signs - {a for a, b in pairs if word.match(b)}
    kind = lambda s: "[" + "".join(map(re.escape, sorted(s))) + "]" if s else "(?!)"
    return re.compile(rf"(?<=[^\W_])(?={kind(after)})|(?<={kind(before)})(?=[^\W_])")


def units_of(text: str) -> list[str]:
    """Runs of space signs with what follows; the text has its leading one."""
    return re.findall(f"{SPACE}*[^{SPACE}]+|{SPACE}+", text)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """(ids, texts) of ``BLOCK_BYTES`` each at most, or a row, over the bounds of batches."""
    held, size = [], 0
    for b in batches:
        at = 0
        for t in slices(b.column(1), WORDS_BYTES):
            own = pc.sum(pc.binary_length(t)).as_py() or 0
            if held and size + own > BLOCK_BYTES:
                part, held, size = _part(held), [], 0
                yield part
                part = None
            held.append((b.column(0).slice(at, len(t)), t))
            at += len(t)
            size += own
        b = t = None  # a batch goes as soon as its block is made
    if held:
        part, held = _part(held), []
        yield part


def _part(held: list[tuple[pa.Array, pa.Array]]) -> tuple[pa.Array, pa.Array]:
    ids, texts = (pa.concat_arrays(x) for x in zip(*held, strict=True))
    return ids, pc.fill_null(texts, "")


def _words(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """(order of the texts, distinct words, their numbers in the texts in that
    order, words of each): a word is a run of space signs with what follows."""
    marked = pc.replace_substring(texts, " ", SPACE)
    plain = pc.invert(pc.or_(pc.or_(pc.match_substring(marked, SPACE * 2), pc.starts_with(marked, SPACE)), pc.equal(pc.binary_length(texts), 0)))
    odd = np.flatnonzero(~plain.to_numpy(zero_copy_only=False))
    own = [units_of(SPACE + x.as_py()) if len(x.as_py()) else [] for x in marked.take(pa.array(odd, pa.int64()))]
    marked = marked.filter(plain)
    split = pc.split_pattern(marked, SPACE)
    n = np.concatenate([np.diff(split.offsets.to_numpy()), np.array([len(x) for x in own], np.int64)])
    del marked
    coded = split.flatten().dictionary_encode()
    del split
    more = pa.array([w for x in own for w in x], pa.string()).dictionary_encode()
    names = pc.binary_join_element_wise(SPACE, coded.dictionary.cast(pa.string()), "")
    both = pa.concat_arrays([names, more.dictionary.cast(pa.string())]).dictionary_encode()
    to = both.indices.to_numpy(zero_copy_only=False)
    code = np.concatenate([to[coded.indices.to_numpy(zero_copy_only=False)], to[len(names) :][more.indices.to_numpy(zero_copy_only=False)]])
    order = np.concatenate([np.flatnonzero(plain.to_numpy(zero_copy_only=False)), odd])
    return order, both.dictionary, code, n.astype(np.int64)


def _coded(texts: pa.Array, cut: re.Pattern) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(order of the texts, units of each, numbers of their units, distinct units). A
    block has fewer bytes than 32 bits count, and so fewer units."""
    each, before = [], 0
    for t in slices(texts, WORDS_BYTES):
        order, words, code, n = _words(t)
        each.append((order + before, words, code, n))
        before += len(t)
    several = pa.concat_arrays([words for _, words, _, _ in each]).dictionary_encode()
    words, to = several.dictionary, np.split(several.indices.to_numpy(zero_copy_only=False), np.cumsum([len(x[1]) for x in each])[:-1])
    order, n = (np.concatenate([x[i] for x in each]) for i in (0, 3))
    code = np.concatenate([t[x[2]] for t, x in zip(to, each, strict=True)])
    del each, several, to
    whole = pc.utf8_is_alnum(pc.utf8_slice_codeunits(words, 1)).to_numpy(zero_copy_only=False)
    size, start = np.ones(len(words), np.int32), np.zeros(len(words), np.int32)
    flat: list[str] = []
    cuts = np.zeros(len(words) - whole.sum(), np.int32)
    for i, w in enumerate(words.filter(pa.array(~whole))):
        own = [x for x in cut.split(w.as_py()) if x]
        cuts[i] = len(own)
        flat += own
    size[~whole] = cuts
    start[whole] = np.arange(whole.sum())
    start[~whole] = whole.sum() + np.cumsum(cuts) - cuts
    coded = pa.concat_arrays([words.filter(pa.array(whole)), pa.array(flat, pa.string())]).dictionary_encode()
    del flat, words
    k = size[code]
    ends = np.concatenate([np.zeros(1, np.int32), np.cumsum(k, dtype=np.int32)])
    lengths = np.diff(ends[np.concatenate([[0], np.cumsum(n)])])
    first = start[code]
    first -= ends[:-1]
    del code
    at = np.repeat(first, k)
    del first, k
    at += np.arange(ends[-1], dtype=np.int32)
    return order, lengths, coded.indices.to_numpy(zero_copy_only=False)[at], coded.dictionary


def _blocks(batches: Iterator[pa.RecordBatch], cut: re.Pattern, buckets: int, at: str) -> Iterator[pa.RecordBatch]:
    """(bucket, block, units): the units of a block that fall to a bucket, in order;
    each block has a row in bucket 0. Its documents, as sequences of numbers of its
    units, wait in a file below ``at`` that is named after the block, so that they
    needn't be shuffled; a repeated task writes the same file again. Nothing of a block
    is held while the next is read."""
    fs, root = filesystem(at)
    fs.create_dir(root, recursive=True)
    for no, part in enumerate(_parts(batches)):
        out = _block(*part, cut, buckets, (TaskContext.get().partitionId() << 24) + no, fs, root)
        del part
        trim()
        yield out
        del out


def _block(ids: pa.Array, texts: pa.Array, cut: re.Pattern, buckets: int, block: int, fs, root: str) -> pa.RecordBatch:
    """The rows of one block, whose file it writes."""
    hashes = np.fromiter((xxhash.xxh64_intdigest(x.as_py().encode()) for x in texts), np.uint64, len(texts))
    order, lengths, codes, units = _coded(texts, cut)
    ids = pc.fill_null(ids.cast(pa.int64()), NULL_ID).to_numpy(zero_copy_only=False)
    raw = units.cast(pa.binary()).to_pylist()
    to = np.fromiter(map(zlib.crc32, raw), np.int64, len(raw)) % buckets
    # Units are placed bucket by bucket, and numbered by falling counts, which pack well.
    placed = pc.sort_indices(units).to_numpy().astype(np.int64)
    placed = placed[np.argsort(to[placed], kind="stable")]
    by_count = np.argsort(-np.bincount(codes, minlength=len(raw))[placed], kind="stable")
    number = np.empty(len(raw), "<u4")
    number[placed[by_count]] = np.arange(len(raw))
    head = [ids[order].astype("<i8").tobytes(), lengths.astype("<i8").tobytes(), hashes[order].tobytes(), _planes(number[codes]), _planes(np.diff(by_count, prepend=0))]
    del codes
    with fs.open_output_stream(f"{root}/{block}") as f:
        f.write(zstandard.ZstdCompressor(level=3).compress(b"".join([np.array([*map(len, head)], "<i8").tobytes(), *head])))
    del head
    first = np.flatnonzero(np.diff(to[placed], prepend=-1)).tolist()
    rows = [(int(to[placed[x]]), block, _joined([raw[i] for i in placed[x:y]])) for x, y in zip(first, [*first, len(placed)][1:], strict=True)]
    if not rows or rows[0][0]:
        rows.insert(0, (0, block, _joined([])))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["bucket", "block", "units"])


def _head(at: str, block: int) -> list[bytes]:
    """docs, lengths, hashes, codes and order of a block."""
    fs, root = filesystem(at)
    with fs.open_input_file(f"{root}/{block}") as f:
        raw = zstandard.ZstdDecompressor().decompress(f.read())
    ends = (40 + np.cumsum(np.frombuffer(raw, "<i8", 5))).tolist()
    return [raw[a:z] for a, z in zip([40, *ends[:-1]], ends, strict=True)]


def _planes(x: np.ndarray) -> bytes:
    """The bytes of numbers by significance, which compress better so."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _unplaned(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _joined(units: list[bytes]) -> bytes:
    """Strings with their lengths in front, so that any character may occur."""
    return zstandard.ZstdCompressor(level=6).compress(np.array([len(units)], "<u4").tobytes() + _planes(np.array([*map(len, units)], np.int64)) + b"".join(units))


def _unjoined(packed: bytes) -> pa.Array:
    raw = zstandard.ZstdDecompressor().decompress(packed)
    n = int.from_bytes(raw[:4], "little")
    ends = np.concatenate([[0], np.cumsum(_unplaned(raw[4 : 4 + 4 * n]))]).astype("<i4")
    return pa.StringArray.from_buffers(n, pa.py_buffer(ends.tobytes()), pa.py_buffer(raw[4 + 4 * n :]))


def _long(n: int) -> Column:
    return F.lit(n).cast("long")


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", _long(1), place.cast("int"))


def piece_table(spark: SparkSession, m: Model) -> DataFrame:
    """(piece, edge): an edge is one number, of the order of the score (equal
    scores are equal), two places, whether the piece is late, and its id."""
    if len(m.pieces) > MOST_PIECES or len(m.decoded) >= LATE:
        raise ValueError("the piece table is too large to broadcast")
    late = late_pieces(m.pieces) if m.bpe else set()
    order = {c: i for i, c in enumerate(sorted({-x for _, x in m.pieces.values()}))}
    rows = [(p, order[-x] << 32 | (LATE if p in late else 0) | i) for p, (i, x) in m.pieces.items()]
    return spark.createDataFrame(rows, "piece string, edge long")


def first_of(e: Column) -> Column:
    return F.shiftright(e, 26).bitwiseAND(_long(63))


def end_of(e: Column) -> Column:
    return F.shiftright(e, 20).bitwiseAND(_long(63))


def lattice(units: DataFrame, pieces: DataFrame, longest: int) -> DataFrame:
    """(bucket, unit, edges): the edges of each distinct unit in the order of score and
    place; those of one character are left to the end, but that of the first is
    always there, so that no unit is lost. Partitioned by bucket beforehand, the
    edges of a unit never move."""
    n = F.length("unit")
    starts = units.filter(n > 0).select("bucket", "unit", F.explode(F.sequence(F.lit(0), n - 1)).alias("i")).filter((F.col("i") == 0) | (n - F.col("i") >= 2))
    lengths = F.sequence(F.when(F.col("i") == 0, 1).otherwise(2), F.least(F.lit(longest), n - F.col("i")))
    sub = starts.select("bucket", "unit", "i", F.explode(lengths).alias("k")).select("bucket", "unit", "i", "k", F.expr("substring(unit, i + 1, k)").alias("piece"))
    joined = sub.join(F.broadcast(pieces), "piece", "left").filter("edge IS NOT NULL OR k = 1")
    placed = F.expr("coalesce(edge, 0L) + shiftleft(cast(i as bigint), 26) + shiftleft(cast(i + k as bigint), 20)")
    return joined.groupBy("bucket", "unit").agg(F.sort_array(F.collect_list(placed)).alias("edges"))


def _byte_ids(ch: Column, m: Model) -> Column:
    """Byte pieces of one character."""
    if not m.bytes_:
        return F.array(F.lit(m.unknown))
    low = m.bytes_[0]
    if any(i != low + b for b, i in m.bytes_.items()):
        raise ValueError("byte pieces must follow each other")
    digits = F.hex(F.encode(ch, "utf-8"))
    return F.transform(F.sequence(F.lit(1), (F.length(digits) / 2).cast("int")), lambda k: F.conv(F.substring(digits, (k * 2 - 1).cast("int"), F.lit(2)), 16, 10).cast("int") + low)


def _by_code(ch: Column, values: dict[int, float], kind: str) -> Column:
    """The value of one character, by an array over code points; -1 where it has none."""
    near, far = {c: v for c, v in values.items() if c < 1 << 16}, {c: v for c, v in values.items() if c >= 1 << 16}
    by_code = F.from_json(F.lit(str([near.get(c, -1) for c in range(1 + max(near, default=0))])), f"array<{kind}>")
    code = F.ascii(ch)
    rare = F.lit(-1).cast(kind)
    for c, v in far.items():
        rare = F.when(code == c, F.lit(v).cast(kind)).otherwise(rare)
    return F.when(code < 1 << 16, F.coalesce(F.get(by_code, code), F.lit(-1).cast(kind))).otherwise(rare)


def _char_ids(ch: Column, m: Model) -> Column:
    """The ids of one character: its piece or bytes."""
    found = _by_code(ch, {ord(p): i for p, (i, _) in m.pieces.items() if len(p) == 1}, "int")
    return F.when(found >= 0, F.array(found)).otherwise(_byte_ids(ch, m))


def merged_fold() -> Column:
    """The boundaries of ``unit`` left after all merges of ``wide``, as bits."""
    n = F.length("unit")
    first = F.expr("shiftleft(1L, length(unit) + 1) - 1")
    fits = lambda state, e: (state.bitwiseAND(e["ends"]) == e["ends"]) & (F.bit_count(state.bitwiseAND(e["inner"])) == 1)
    without = lambda state, inner: state.bitwiseAND(F.bitwise_not(inner))
    once = F.aggregate("wide", first, lambda state, e: F.when(fits(state, e), without(state, e["inner"])).otherwise(state))

    def best(state: Column, _: Column) -> Column:
        return without(state, F.coalesce(F.get(F.filter("wide", lambda e: fits(state, e)), 0)["inner"], _long(0)))

    late = F.exists("edges", lambda e: e.bitwiseAND(_long(LATE)) != 0)
    return F.when(n == 1, first).when(late, F.aggregate(F.sequence(F.lit(1), n - 1), first, best)).otherwise(once)


def viterbi_fold(m: Model) -> Column:
    """The boundaries of the path of least cost, as bits (unigram models). Of equal
    paths the one with the longer last piece."""
    n = F.length("unit")
    costs = dict(m.pieces.values())
    by_id = F.from_json(F.lit(str([-costs.get(i, 0.0) for i in range(len(m.decoded))])), "array<double>")
    own_ids = {ord(p): i for p, (i, _) in m.pieces.items() if len(p) == 1}
    kind = "array<struct<cost:double,path:bigint>>"

    def step(best: Column, j: Column) -> Column:
        into = F.filter("edges", lambda e: (end_of(e) == j) & (first_of(e) < j - 1))
        wide = F.transform(into, lambda e: F.struct((F.get(best, first_of(e).cast("int"))["cost"] + F.get(by_id, e.bitwiseAND(_long(LATE - 1)).cast("int"))).alias("cost"), F.get(best, first_of(e).cast("int"))["path"].bitwiseOR(_bit(j)).alias("path")))
        own = _by_code(F.substring(F.col("unit"), j, F.lit(1)), own_ids, "int")
        alone = F.when(own >= 0, F.get(by_id, own)).otherwise(m.unknown_cost)
        last = F.get(best, (j - 1).cast("int"))
        one = F.struct((last["cost"] + alone).alias("cost"), last["path"].bitwiseOR(_bit(j)).alias("path"))
        return F.concat(best, F.array(F.array_min(F.concat(wide, F.array(one)))))

    start = F.array(F.struct(F.lit(0.0).alias("cost"), _long(1).alias("path"))).cast(kind)
    return F.element_at(F.aggregate(F.sequence(F.lit(1), n), start, step), -1)["path"]


def encoded_units(units: DataFrame, m: Model, parts: int) -> DataFrame:
    """(bucket, unit, ids) of distinct units (bucket, unit) of up to ``LONGEST`` characters."""
    rows = lattice(units.repartition(parts, "bucket"), piece_table(units.sparkSession, m), m.longest)
    spans = lambda e: F.struct((_bit(first_of(e)) + _bit(end_of(e))).alias("ends"), (_bit(end_of(e)) - _bit(first_of(e) + 1)).alias("inner"))
    rows = rows.withColumn("wide", F.transform(F.filter("edges", lambda e: end_of(e) > first_of(e) + 1), spans))
    rows = rows.withColumn("bits", merged_fold() if m.bpe else viterbi_fold(m))
    held = lambda e: (F.col("bits").bitwiseAND(spans(e)["ends"]) == spans(e)["ends"]) & (F.col("bits").bitwiseAND(spans(e)["inner"]) == 0) & (end_of(e) > first_of(e) + 1)
    wide = F.transform(F.filter("edges", held), lambda e: F.struct(first_of(e).cast("int").alias("i"), F.array(e.bitwiseAND(_long(LATE - 1)).cast("int")).alias("ids")))
    alone = F.filter(F.sequence(F.lit(0), F.length("unit") - 1), lambda p: F.col("bits").bitwiseAND(_bit(p) + _bit(p + 1)) == _bit(p) + _bit(p + 1))
    single = F.transform(alone, lambda p: F.struct(p.alias("i"), _char_ids(F.substring(F.col("unit"), p + 1, F.lit(1)), m).alias("ids")))
    ids = F.flatten(F.transform(F.sort_array(F.concat(wide, single)), lambda x: x["ids"]))
    return rows.select("bucket", "unit", ids.alias("ids"))


#: A task has some ten thousand units; their edges fit in memory without a sort.
NO_SORT = {"spark.sql.objectHashAggregate.sortBased.fallbackThreshold": str(1 << 17)}


@finished("piece-digests", **NO_SORT)
def encoded(docs: DataFrame, model_path: str, bpe: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids_crc32, round_trip) of every row: the ids of its whole
    text, and whether decoding them gives the text back."""
    return _encode(docs, model_path, bpe, _digested, "doc_id long, n_tokens long, ids_crc32 long, round_trip boolean")


@finished("piece-ids", **NO_SORT)
def token_ids(docs: DataFrame, model_path: str, bpe: bool = True) -> DataFrame:
    """(doc_id, ids, text) of every row: its ids, and what they decode to."""
    return _encode(docs, model_path, bpe, _listed, "doc_id long, ids array<int>, text string")


def _encode(docs: DataFrame, model_path: str, bpe: bool, told, schema: str) -> DataFrame:
    m = Model.load(model_path, bpe)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(48, size // BUCKET_BYTES)
    parts = max(8, buckets // 4)
    cut = m.cut
    at = scratch(docs.sparkSession, "heads")
    # Both uses of the dealt units share one exchange.
    dealt = slim.mapInArrow(trimmed_stream(lambda b: _blocks(b, cut, buckets, at)), "bucket int, block long, units binary").repartition(parts, "bucket")

    def distinct(t: pa.Table) -> pa.Table:
        own = pc.unique(pa.chunked_array([_unjoined(p) for p in t.column("units").to_pylist()]))
        own = own.filter(pc.less_equal(pc.utf8_length(own), LONGEST))
        return pa.table({"bucket": pa.array(np.full(len(own), t.column("bucket")[0].as_py()), pa.int32()), "unit": own})

    units = dealt.groupBy("bucket").applyInArrow(trimmed(lambda t: distinct(t)), "bucket int, unit string")
    kind = "array<smallint>" if len(m.decoded) < 1 << 15 else "array<int>"
    known = encoded_units(units, m, parts).select("bucket", "unit", F.col("ids").cast(kind).alias("ids"))

    def placed(d: pa.Table, e: pa.Table) -> pa.Table:
        z, out = zstandard.ZstdCompressor(level=3), []
        each = [_unjoined(p) for p in d.column("units").to_pylist()]
        value, ids = e.column("unit").combine_chunks(), e.column("ids").combine_chunks()
        for row in each:
            found = pc.index_in(row, value_set=value)
            got = ids.take(found)
            n = pc.fill_null(pc.list_value_length(got), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = got.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            if found.null_count:
                late = np.flatnonzero(found.is_null().to_numpy(zero_copy_only=False))
                more = [m.long_unit(row[int(i)].as_py()) for i in late]
                own = np.split(flat, np.cumsum(n)[:-1])
                for i, x in zip(late.tolist(), more, strict=True):
                    own[i] = np.array(x, np.int64)
                flat, n = np.concatenate(own), np.array([len(x) for x in own])
            out.append(z.compress(np.array([len(n)], "<u4").tobytes() + _planes(n) + _planes(flat)))
        return pa.table({"block": d.column("block"), "bucket": d.column("bucket"), "ids": pa.array(out, pa.binary())})

    placed_ids = dealt.groupBy("bucket").cogroup(known.groupBy("bucket")).applyInArrow(trimmed(lambda d, e: placed(d, e)), "block long, bucket int, ids binary")

    unknown = None if m.bytes_ else m.unknown
    return placed_ids.groupBy("block").applyInArrow(trimmed(lambda p: told(*_assembled(p, at, unknown), m)), schema)


def _assembled(p: pa.Table, at: str, unknown: int | None) -> tuple:
    """(docs, hashes, all ids, ids of each document) of one block."""
    un = zstandard.ZstdDecompressor().decompress
    sizes, pool = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
    for i in np.argsort(p.column("bucket").to_numpy()).tolist():
        raw = un(p.column("ids")[i].as_py())
        n = int.from_bytes(raw[:4], "little")
        sizes.append(_unplaned(raw[4 : 4 + 4 * n]).astype(np.int64))
        pool.append(_unplaned(raw[4 + 4 * n :]))
    size = np.concatenate(sizes)
    docs, lengths, hashes, codes, order = _head(at, p.column("block")[0].as_py())
    place = np.cumsum(_unplaned(order), dtype=np.uint32)
    lengths = np.frombuffer(lengths, "<i8")
    start = (np.cumsum(size) - size)[place]
    return np.frombuffer(docs, "<i8"), np.frombuffer(hashes, np.uint64), _unplaned(codes), np.concatenate([[0], np.cumsum(lengths)]), size[place], start, np.concatenate(pool), unknown


def _each(docs, hashes, codes, ends, size, start, pool, unknown) -> Iterator[tuple[int, int, np.ndarray]]:
    """(doc, hash, ids) of each document of a block; a run of unknown ids is one."""
    for i, (d, h) in enumerate(zip(docs.tolist(), hashes.tolist(), strict=True)):
        own = codes[ends[i] : ends[i + 1]]
        n = size[own]
        upto = np.cumsum(n)
        ids = pool[np.repeat(start[own] - upto + n, n) + np.arange(upto[-1] if len(upto) else 0)]
        if unknown is not None and len(ids):
            ids = ids[np.concatenate([[True], (ids[1:] != unknown) | (ids[:-1] != unknown)])]
        yield d, h, ids


def decoded(ids: np.ndarray, m: Model) -> bytes:
    """The text of ids, without the space put in front of it."""
    out = b"".join(map(m.decoded.__getitem__, ids.tolist()))
    return out[1:] if out.startswith(b" ") else out


def _digested(docs, hashes, codes, ends, size, start, pool, unknown, m: Model) -> pa.Table:
    rows = [(d, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), xxhash.xxh64_intdigest(decoded(ids, m)) == h) for d, h, ids in _each(docs, hashes, codes, ends, size, start, pool, unknown)]
    d, n, crc, same = zip(*rows, strict=True)
    d = np.array(d, np.int64)
    return pa.table({"doc_id": pa.array(d, mask=d == NULL_ID), "n_tokens": pa.array(n, pa.int64()), "ids_crc32": pa.array(crc, pa.int64()), "round_trip": pa.array(same, pa.bool_())})


def _listed(docs, hashes, codes, ends, size, start, pool, unknown, m: Model) -> pa.Table:
    rows = [(d, ids.tolist(), decoded(ids, m).decode(errors="replace")) for d, _, ids in _each(docs, hashes, codes, ends, size, start, pool, unknown)]
    d, ids, text = zip(*rows, strict=True)
    d = np.array(d, np.int64)
    return pa.table({"doc_id": pa.array(d, mask=d == NULL_ID), "ids": pa.array(ids, pa.list_(pa.int32())), "text": pa.array(text, pa.string())})
