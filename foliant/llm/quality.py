"""A quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on every document.
Expectation-maximisation over the counts of vote patterns of the whole corpus
(at most 3 to the power of the labellers, whatever its size) estimates each
labeller's accuracy without a single true label. The patterns' posteriors then
label a bounded sample on which a hashed linear scorer is trained; it scores
every whole text.

Bounds of the fit: ``sample_rows`` different texts, in the order of a hash of the text,
of at most ``sample_bytes`` each, reach the driver. Votes, pattern counts and
scores cover all documents.

Defined results: null and empty texts get the votes of an empty text, score by
the bias alone, and are not sampled; equal texts get equal scores; an empty
table gives no rows; other columns pass through, clashing names are overwritten.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GOOD, BAD, NONE = 1, 0, -1
BLANKS = r"[ \t\r\n\x0b\x0c]+"
#: Frequent short words of the languages at hand.
FUNCTION_WORDS = frozenset("the of and to in is that de la le et en que el los der die und das ein".split())
LABELLERS = ("signs", "doubled_signs", "capitals", "repeats", "function_words", "sentence_ends", "word_length", "digits")
DIMS = 1 << 15
SLICE_ROWS = 1000


def _kinds() -> np.ndarray:
    """Bits of each byte: sign, mark, capital, digit, end of sentence, blank."""
    out = np.zeros(256, np.uint8)
    for c in range(33, 127):
        ch = chr(c)
        if not ch.isalnum():
            out[c] |= 2 if ch == "." or ch in "'\"()-" else 3 if ch not in ",;:!?" else 2
        out[c] |= 4 * ch.isupper() | 8 * ch.isdigit() | 16 * (ch in ".!?")
    out[ord(".")] &= ~np.uint8(2)
    out[[9, 10, 11, 12, 13, 32]] = 32
    return out


KINDS = _kinds()


@dataclass
class Words:
    """The words of a run of texts as numbers of distinct ones."""

    distinct: list[str]
    code: np.ndarray
    row: np.ndarray
    n: np.ndarray
    again: np.ndarray

    @classmethod
    def of(cls, texts: pa.Array) -> Words:
        words = pc.split_pattern_regex(pc.fill_null(texts, ""), BLANKS)
        coded = words.flatten().dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(len(texts)), np.diff(words.offsets.to_numpy()))
        full = np.array([w != "" for w in distinct], bool)[code] if distinct else np.zeros(0, bool)
        code, row = code[full], row[full]
        n = np.bincount(row, minlength=len(texts))
        same = np.zeros(len(code), bool)
        same[1:] = (code[1:] == code[:-1]) & (row[1:] == row[:-1])
        return cls(distinct, code, row, n, np.bincount(row, same, len(texts)) / np.maximum(n, 1))


def votes_of(texts: pa.Array, w: Words) -> np.ndarray:
    """A row of votes for each text, a column for each labeller."""
    filled = pc.fill_null(texts, "")
    size = pc.binary_length(filled).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(size)])
    kind = KINDS[np.frombuffer("".join(filled.to_pylist()).encode(), np.uint8)]
    after = np.append(kind[1:], np.uint8(32))
    after[ends[1:][size > 0] - 1] = 32
    before = np.concatenate([[np.uint8(32)], kind[:-1]])
    before[ends[:-1][size > 0]] = 32

    def share(hit: np.ndarray, of: np.ndarray) -> np.ndarray:
        upto = np.concatenate([[0], np.cumsum(hit, dtype=np.int64)])
        return (upto[ends[1:]] - upto[ends[:-1]]) / np.maximum(of, 1)

    mark = (kind & 2) > 0
    function = np.array([x.strip(".,;:!?$%*#&|").lower() in FUNCTION_WORDS for x in w.distinct], bool)[w.code] if w.distinct else np.zeros(0, bool)
    function = np.bincount(w.row, function, len(texts)) / np.maximum(w.n, 1)
    stops = share(((kind & 16) > 0) & ((after & 32) > 0), w.n)
    length = share((kind & 32) == 0, w.n)
    vote = lambda bad, good=False: np.where(bad, BAD, np.where(good, GOOD, NONE))
    columns = {
        "signs": vote(share((kind & 1) > 0, size) > 0.02),
        "doubled_signs": vote(share(mark & ((after & 2) > 0) & ((before & 2) == 0), w.n) > 0.1),
        "capitals": vote(share((kind & 4) > 0, size) > 0.3),
        "repeats": vote(w.again > 0.1, w.again < 0.02),
        "function_words": vote((w.n >= 20) & (function < 0.03), function > 0.08),
        "sentence_ends": vote(stops < 0.01, (stops >= 0.03) & (stops <= 0.3)),
        "word_length": vote((length > 15) | (length < 2)),
        "digits": vote(share((kind & 8) > 0, size) > 0.15),
    }
    return np.stack([np.broadcast_to(columns[c], len(texts)) for c in LABELLERS], 1)


def pattern_of(votes: np.ndarray) -> np.ndarray:
    """Votes as one number."""
    return ((votes + 1) * 3 ** np.arange(votes.shape[1])).sum(1)


def votes_in(patterns: np.ndarray) -> np.ndarray:
    return np.asarray(patterns, np.int64).reshape(-1, 1) // 3 ** np.arange(len(LABELLERS)) % 3 - 1


@dataclass
class WeakModel:
    names: list[str]
    prior: float
    #: P(vote | class): labeller, class (bad, good), vote (none, bad, good).
    p: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """P(good) of rows of votes; no vote tells nothing."""
        s = np.full(len(votes), log(self.prior / (1 - self.prior)))
        for j in range(len(self.names)):
            v = votes[:, j] + 1
            s += np.where(v > 0, np.log(self.p[j, 1, v] / self.p[j, 0, v]), 0.0)
        return 1 / (1 + np.exp(-np.clip(s, -40, 40)))

    def accuracy(self) -> dict[str, float]:
        right = self.p[:, 1, 2] * self.prior + self.p[:, 0, 1] * (1 - self.prior)
        voted = self.p[:, 1, 1:].sum(1) * self.prior + self.p[:, 0, 1:].sum(1) * (1 - self.prior)
        return dict(zip(self.names, (right / np.maximum(voted, 1e-12)).tolist(), strict=True))


def expectation_maximisation(names: list[str], votes: np.ndarray, counts: np.ndarray, rounds: int = 60) -> WeakModel:
    """Fits class-conditional vote rates to pattern counts, from the start that
    labellers are right more often than not."""
    counts = counts.astype(float)
    yes, no = (votes == GOOD).sum(1), (votes == BAD).sum(1)
    q = (yes + 1.0) / (yes + 3.0 * no + 2.0)
    m = WeakModel(names, 0.5, np.full((len(names), 2, 3), 1 / 3))
    for _ in range(rounds):
        total = counts.sum()
        m.prior = float(np.clip((q * counts).sum() / max(total, 1e-9), 0.01, 0.99))
        for j in range(len(names)):
            for c, weight in ((0, (1 - q) * counts), (1, q * counts)):
                m.p[j, c] = np.bincount(votes[:, j] + 1, weight, 3) + 1.0
                m.p[j, c] /= m.p[j, c].sum()
        q = m.posterior(votes)
    return m


def _shape(word: str) -> str:
    out = ""
    for ch in word:
        c = "a" if ch.islower() else "A" if ch.isupper() else "0" if ch.isdigit() else ch
        if not out.endswith(c):
            out += c
    return out[:12]


def hashed(word: str) -> int:
    return zlib.crc32(word.encode()) % DIMS


class Features:
    """Hashed features of texts: rows, dimensions and values."""

    def __init__(self):
        self.kept: dict[str, tuple[int, int]] = {}

    def _of(self, word: str) -> tuple[int, int]:
        if (got := self.kept.get(word)) is None:
            if len(self.kept) > 300_000:
                self.kept.clear()
            got = self.kept[word] = hashed("w " + word.lower()), hashed("s " + _shape(word))
        return got

    def __call__(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        both = np.array([self._of(x) for x in w.distinct], np.int64).reshape(-1, 2)
        every = np.arange(len(w.n))
        value = 10.0 / np.maximum(w.n, 1)[w.row]
        whole = np.array([hashed(f"r {int(x)}") for x in np.minimum(w.again * 10, 5)], np.int64)
        size = np.array([hashed(f"n {int(x)}") for x in np.minimum(np.log2(w.n + 1), 12)], np.int64)
        return np.concatenate([w.row, w.row, every, every]), np.concatenate([both[w.code, 0], both[w.code, 1], whole, size]), np.concatenate([value, value, np.full(len(every), 4.0), np.ones(len(every))])


def train(texts: list[str], labels: np.ndarray, rounds: int = 150, rate: float = 0.5, decay: float = 1e-4) -> np.ndarray:
    """Logistic weights (the last is the bias) for labels between 0 and 1."""
    w = np.zeros(DIMS + 1)
    if not texts:
        return w
    row, dim, val = Features()(Words.of(pa.array(texts)))
    key, place = np.unique(row * DIMS + dim, return_inverse=True)
    val, row, dim = np.bincount(place, val), key // DIMS, key % DIMS
    seen = np.full(DIMS + 1, 1e-8)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[dim] * val, len(texts)) + w[-1], -40, 40)))
        err = (p - labels) / len(texts)
        grad = np.append(np.bincount(dim, err[row] * val, DIMS), err.sum()) + decay * w / len(texts)
        seen += grad**2
        w -= rate * grad / np.sqrt(seen)
    return w


def scored(docs: DataFrame, keep_at: float = 0.5, sample_rows: int = 6000, sample_bytes: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, WeakModel]:
    """(id, weak posterior, score, keep) of every document, and the label model."""
    spark = docs.sparkSession
    text = F.col(text_col).cast("string").alias("_text")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [pattern_of(votes_of(t, Words.of(t))) for t in _sliced(b.column(0))]
            p, n = np.unique(np.concatenate(found) if found else np.zeros(0, np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int64)), pa.array(n.astype(np.int64))], names=["votes", "n"])

    found = sorted(tuple(r) for r in docs.select(text).mapInArrow(counted, "votes long, n long").groupBy("votes").agg(F.sum("n").alias("n")).collect())
    patterns, counts = np.array(found, np.int64).reshape(-1, 2).T
    model = expectation_maximisation(list(LABELLERS), votes_in(patterns), counts)
    belief = dict(zip(patterns.tolist(), model.posterior(votes_in(patterns)).tolist(), strict=True))
    # Copies count once: the first hashes, then the texts up to the last of them, so
    # that no task sends more.
    order = F.xxhash64("_text")
    some = docs.select(text).filter(F.octet_length("_text").between(1, sample_bytes)).withColumn("_hash", order)
    last = some.select("_hash").distinct().orderBy("_hash").limit(sample_rows).agg(F.max("_hash")).first()[0]
    texts = some.filter(F.col("_hash") <= F.lit(last).cast("long")).select("_text").distinct()
    sample = pa.array([r["_text"] for r in texts.orderBy(order, "_text").limit(sample_rows).collect()], pa.string())
    labels = np.array([belief[p] for t in _sliced(sample) for p in pattern_of(votes_of(t, Words.of(t))).tolist()])
    w = spark.sparkContext.broadcast(train(sample.to_pylist(), labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, weights = Features(), w.value
        for b in batches:
            at = 0
            for t in _sliced(b.column(1)):
                words = Words.of(t)
                row, dim, val = f(words)
                p = 1 / (1 + np.exp(-np.clip(np.bincount(row, weights[dim] * val, len(t)) + weights[-1], -40, 40)))
                weak = [belief.get(v, model.prior) for v in pattern_of(votes_of(t, words)).tolist()]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(t)), pa.array(weak, pa.float64()), pa.array(p), pa.array(p >= keep_at)], names=[id_col, "weak_posterior", "score", "keep"])
                at += len(t)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text).mapInArrow(run, f"{id_col} {kind}, weak_posterior double, score double, keep boolean"), model


def _sliced(texts: pa.Array) -> Iterator[pa.Array]:
    for at in range(0, len(texts), SLICE_ROWS):
        yield texts.slice(at, SLICE_ROWS)
