"""The Viterbi fold against the library, on unigram models written out by hand."""

import struct
import tracemalloc
from types import SimpleNamespace

import pyarrow as pa
import pytest

sentencepiece = pytest.importorskip("sentencepiece")
from foliant.llm import pieces  # noqa: E402

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa omega aaa aaaa 123 1 2 3 4 çà été leading zero".split()


def field(no: int, kind: int, data: bytes) -> bytes:
    return varint(no << 3 | kind) + data


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def text(no: int, data: bytes) -> bytes:
    return field(no, 2, varint(len(data)) + data)


def unigram(path, fallback: bool) -> str:
    """A model of substrings of some words, scored by a rule in 64ths, so that sums are exact."""
    plain = {pieces.SPACE}
    for w in WORDS:
        for word in (w, pieces.SPACE + w):
            plain |= {word[i:j] for i in range(len(word)) for j in range(i + 1, len(word) + 1) if j - i == 1 or (7 * i + 3 * j + len(word)) % 3}
    plain -= set("xk") | {p for p in plain if pieces.SPACE in p[1:]}
    rows = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
    rows += [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)] if fallback else []
    rows += [(p, -(64 * 3 + (sum(map(ord, p)) * 31 + len(p)) % 997) / 64 - 0.25 * len(p), 1) for p in sorted(plain)]
    made = b"".join(text(1, text(1, p.encode()) + field(2, 5, struct.pack("<f", s)) + field(3, 0, varint(k))) for p, s, k in rows)
    made += text(2, field(3, 0, varint(1)) + field(4, 0, varint(len(rows))) + (field(35, 0, varint(1)) if fallback else b""))
    made += text(3, text(1, b"identity") + field(4, 0, varint(0)))
    path.write_bytes(made)
    return str(path)


@pytest.mark.parametrize("fallback", [True, False])
def test_viterbi_equals_the_library(spark, odd_docs, no_docs, tmp_path, fallback):
    path = unigram(tmp_path / "own.model", fallback)
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    long = "".join(w for _ in range(3) for w in WORDS)
    own = [(100, long), (101, f"{long} {long}x{long}"), (102, "xxkk xxk?! x x kx"), (103, "x"), (104, "日本語 日本 alpha日本beta"), (105, long[:59] + " " + long[:60] + " " + long[:61])]
    docs = odd_docs.select("doc_id", "text").union(spark.createDataFrame(own, "doc_id long, text string"))
    got = {(r.doc_id, r.text): list(r.ids) for r in pieces.token_ids(docs, path, bpe=False).collect()}
    want = {}
    for r in docs.collect():
        ids = sp.encode(r.text or "")
        want[r.doc_id, decoded(sp, ids, r.text or "", fallback)] = ids
    assert sorted(got.values()) == sorted(want.values())
    assert {k[0] for k in got} == {k[0] for k in want}
    assert not pieces.token_ids(no_docs, path, bpe=False).collect()


def decoded(sp, ids, text, fallback):
    return text if fallback else sp.decode(ids)


def test_long_units_have_their_models_rule(tmp_path):
    path = unigram(tmp_path / "own.model", True)
    sp, m = sentencepiece.SentencePieceProcessor(model_file=path), pieces.Model.load(path, bpe=False)
    for n in (61, 150, 3000):
        unit = ("".join(WORDS) * 40)[:n]
        assert m.long_unit(pieces.SPACE + unit) == sp.encode(unit)


def batches_of(texts, per):
    for i in range(0, len(texts), per):
        own = texts[i : i + per]
        yield pa.RecordBatch.from_arrays([pa.array(range(i, i + len(own)), pa.int64()), pa.array(own, pa.string())], names=["doc_id", "text"])


def test_blocks_have_a_bound_and_every_row(monkeypatch):
    monkeypatch.setattr(pieces, "BLOCK_BYTES", 1 << 20)
    texts = [None, "", *("word " * 800 for _ in range(1500)), "x" * (3 << 20), None, "end"]
    parts = list(pieces._parts(batches_of(texts, 180)))
    assert [x for ids, _ in parts for x in ids.to_pylist()] == list(range(len(texts)))
    assert [x or "" for _, t in parts for x in t.to_pylist()] == [t or "" for t in texts]
    for _, t in parts:
        assert len(t) == 1 or sum(len(x or "") for x in t.to_pylist()) <= 1 << 20


def test_nothing_of_a_block_is_held_while_the_next_is_read(monkeypatch, tmp_path):
    monkeypatch.setattr(pieces, "BLOCK_BYTES", 1 << 20)
    monkeypatch.setattr(pieces, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    texts = [" ".join(f"w{(i * 131 + j * j) % 9973}" for j in range(1000)) for i in range(900)]
    held = []

    def read():
        own = batches_of(texts, 100)
        while True:
            held.append(pa.total_allocated_bytes() + tracemalloc.get_traced_memory()[0] - before)
            if (b := next(own, None)) is None:
                return
            yield b
            del b

    tracemalloc.start()
    try:
        before = pa.total_allocated_bytes() + tracemalloc.get_traced_memory()[0]
        assert sum(1 for _ in pieces._blocks(read(), pieces.cut_of({}), 4, str(tmp_path))) > 4
    finally:
        tracemalloc.stop()
    assert max(held) < 2 << 20
