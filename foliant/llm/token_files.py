"""Token ids as flat unsigned integer files with 64-bit document offsets.

``write`` deals documents into ranges of ``doc_id``, encodes each range in
order and streams it to three files: ``.ids`` (little-endian unsigned 16- or
32-bit, by the vocabulary's size), ``.off`` (signed 64-bit: n + 1 offsets into
this file) and ``.doc`` (signed 64-bit doc_id). ``Manifest`` adds the bases of
each part, the prefix sums of ids and documents of the parts before it, so a
global offset is a base plus a local one and no part waits for another.
``read`` memory-maps parts that lie in a shared file system.

Defined results: null or empty text is a document of the end id alone; a null
``doc_id`` sorts first and comes back null (stored as -2**63); rows that share
a ``doc_id`` are ordered by text and all kept; an empty table gives no parts;
other columns are ignored. A part is written under an attempt's own name and
then moved, so a repeated task replaces a part by the same bytes.
"""

from __future__ import annotations

import json
import os
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import filesystem, local_path, scratch

#: Expected input of a part; its texts may be some times larger unpacked.
PART_BYTES = 32 << 20
NULL_ID = -(1 << 63)
#: Pieces of text that are encoded together, in bytes, and remembered words.
SLICE_BYTES = 8 << 20
REMEMBERED = 400_000
#: The pre-tokenizer's pattern as the vocabulary file states it.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """``texts`` in runs of about ``most`` bytes, a row at least."""
    size = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))])
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(size, size[at] + most, "right")) - 1)
        yield texts.slice(at, to - at)
        at = to


class Encoder:
    """Whole texts to ids by the tokenizers library.

    The vocabulary drops white space, so ASCII white space never lies
    within a token: texts are cut there, each distinct word of a slice is
    encoded once by the library and remembered, and the ids are put together by
    position. Words of plain Latin letters are cut further by the vocabulary's
    own pre-tokenizer pattern, so that new ones can be encoded many at a time.
    """

    _kept: dict[str, Encoder] = {}

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tok = Tokenizer.from_file(path)
        state = json.loads(self.tok.to_str())
        vocab = self.tok.get_vocab(with_added_tokens=True)
        split = [p.get("pattern", {}).get("Regex") for p in (state.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        #: Whether new words may be joined by blanks and told apart by the mark of a word's end.
        self.marked = state["model"].get("end_of_word_suffix") == "</w>" and WORD_PATTERN in split
        if not self.marked:
            raise ValueError("the vocabulary must drop white space and mark ends of words")
        self.dtype = np.dtype("<u2" if max(vocab.values()) < 1 << 16 else "<u4")
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for s, i in vocab.items() if s.endswith("</w>")]] = True
        self.cut = regex.compile(WORD_PATTERN)
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._kept:
            cls._kept[path] = cls(path)
        return cls._kept[path]

    def _bytes(self, ids) -> bytes:
        return np.asarray(ids, self.dtype).tobytes()

    def _whole(self, word: str) -> bytes:
        return self._bytes(self.tok.encode(word, add_special_tokens=False).ids)

    def _plain(self, word: str) -> bool:
        return "<|" not in word and (word.isascii() or (max(word) <= "ɏ" and "İ" not in word and unicodedata.is_normalized("NFC", word)))

    def _learn(self, new: list[str]) -> None:
        single, cut, parts, words = {}, {}, self.parts, self.words
        for w in new:
            if w.isascii() and w.isalpha():
                single[w] = w.lower()
            elif self._plain(w):
                cut[w] = self.cut.findall(w.lower())
            else:
                words[w] = self._whole(w)
        fresh = list({p for p in chain(single.values(), *cut.values()) if p not in parts})
        for at in range(0, len(fresh), 1000):
            group = fresh[at : at + 1000]
            # Ids alone: the library needn't keep track of offsets.
            ids = np.asarray(self.tok.encode_batch_fast([" ".join(group)], add_special_tokens=False)[0].ids, np.int64)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(group) and stops[-1] == len(ids):
                data, edges = self._bytes(ids), (stops * self.dtype.itemsize).tolist()
                got = [data[a:z] for a, z in zip([0, *edges[:-1]], edges, strict=True)]
            else:
                got = map(self._whole, group)
            parts.update(zip(group, got, strict=True))
        for w, p in single.items():
            words[w] = parts[p]
        for w, p in cut.items():
            words[w] = b"".join([parts[x] for x in p])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, ids of each text)."""
        words = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        if len(self.words) > REMEMBERED:
            self.words.clear()
        if len(self.parts) > REMEMBERED:
            self.parts.clear()
        coded = words.flatten().dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if new := [w for w in distinct if w not in self.words]:
            self._learn(new)
        found = list(map(self.words.__getitem__, distinct))
        size = np.fromiter(map(len, found), np.int64, len(found)) // self.dtype.itemsize
        pool = np.frombuffer(b"".join(found), self.dtype)
        start = np.concatenate([[0], np.cumsum(size)[:-1]]) if len(size) else size
        code = coded.indices.to_numpy(zero_copy_only=False)
        n = size[code]
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = pool[np.repeat(start[code] - ends[:-1], n) + np.arange(ends[-1])]
        offsets = words.offsets.to_numpy()
        return ids, np.diff(ends[offsets - offsets[0]])


@dataclass(frozen=True)
class Part:
    name: str
    n_docs: int
    n_ids: int
    base_doc: int
    base_id: int


@dataclass(frozen=True)
class Manifest:
    path: str
    dtype: str
    parts: list[Part]


def _write_part(batches: Iterator[pa.RecordBatch], at: str, vocabulary: str, end_id: int) -> Iterator[pa.RecordBatch]:
    task = TaskContext.get()
    name, own = f"part-{task.partitionId():06d}", f".attempt-{task.taskAttemptId()}"
    fs, root = filesystem(at)
    enc = Encoder.of(vocabulary)
    sinks, docs, total = None, 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        if sinks is None:
            sinks = {x: fs.open_output_stream(f"{root}/{own}{name}.{x}") for x in ("ids", "off", "doc")}
            sinks["off"].write(np.zeros(1, "<i8").tobytes())
        row = 0
        ids_of = pc.fill_null(batch.column(0).cast(pa.int64()), NULL_ID).to_numpy(zero_copy_only=False)
        for texts in slices(batch.column(1)):
            ids, n = enc.encode(texts)
            ends = np.cumsum(n + 1)
            out = np.empty(int(ends[-1]), enc.dtype)
            keep = np.ones(len(out), bool)
            keep[ends - 1] = False
            out[keep], out[ends - 1] = ids, end_id
            sinks["ids"].write(out.tobytes())
            sinks["off"].write((total + ends).astype("<i8").tobytes())
            sinks["doc"].write(ids_of[row : row + len(texts)].astype("<i8").tobytes())
            row += len(texts)
            docs, total = docs + len(texts), total + len(out)
    if sinks:
        for x, s in sinks.items():
            s.close()
            fs.move(f"{root}/{own}{name}.{x}", f"{root}/{name}.{x}")
        yield pa.RecordBatch.from_pydict({"part": [task.partitionId()], "name": [name], "n_docs": [docs], "n_ids": [total]}, schema=pa.schema([("part", pa.int64()), ("name", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))


def parts_of(docs: DataFrame) -> int:
    """Parts of some ``PART_BYTES`` by the size that the plan expects, at least the
    session's number."""
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(least, size // PART_BYTES) if size < 1 << 60 else least


def write(docs: DataFrame, at: str, vocabulary: str, end_id: int) -> Manifest:
    """Writes ``docs`` below the URI ``at``; one shuffle, of the texts."""
    fs, root = filesystem(at)
    fs.create_dir(root, recursive=True)
    ranged = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .repartitionByRange(parts_of(docs), F.col("doc_id").asc_nulls_first())
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    )
    rows = sorted(tuple(r) for r in ranged.mapInArrow(lambda b: _write_part(b, at, vocabulary, end_id), "part long, name string, n_docs long, n_ids long").collect())
    parts, doc, idx = [], 0, 0
    for _, name, n_docs, n_ids in rows:
        parts.append(Part(name, n_docs, n_ids, doc, idx))
        doc, idx = doc + n_docs, idx + n_ids
    out = Manifest(at, Encoder.of(vocabulary).dtype.str, parts)
    with fs.open_output_stream(f"{root}/manifest.json") as f:
        f.write(json.dumps(asdict(out)).encode())
    return out


def mapped(at: str, dtype: str) -> np.ndarray:
    """A file's integers; mapped, not read, where the path allows."""
    if (path := local_path(at)) is not None:
        return np.memmap(path, dtype, "r") if os.path.getsize(path) else np.zeros(0, dtype)
    fs, path = filesystem(at)
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read_buffer(), dtype)


READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def read(spark: SparkSession, m: Manifest) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""
    path, dtype = m.path, m.dtype

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids, off, doc = (mapped(f"{path}/{name}.{x}", d) for x, d in (("ids", dtype), ("off", "<i8"), ("doc", "<i8")))
                for at in range(0, len(doc), 8192):
                    o = off[at : at + 8193].astype(np.int64)
                    own = doc[at : at + 8192].astype(np.int64)
                    crc = [zlib.crc32(ids[a:z].astype("<u4")) for a, z in zip(o[:-1].tolist(), o[1:].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(own, mask=own == NULL_ID), pa.array(base + o[:-1]), pa.array(np.diff(o)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    rows = [(p.name, p.base_id) for p in m.parts]
    parts = spark.createDataFrame(rows, "name string, base long")
    return parts.repartition(max(1, len(rows))).mapInArrow(run, READ)


def encoded(docs: DataFrame, vocabulary: str, end_id: int = 2) -> DataFrame:
    """``write`` to a new folder of the shared one, then ``read``."""
    spark = docs.sparkSession
    return read(spark, write(docs, scratch(spark, "tokens"), vocabulary, end_id))
