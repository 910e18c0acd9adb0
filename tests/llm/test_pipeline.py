"""The pipeline's stages against brute force on the smallest table."""

import sys
import zlib

import numpy as np
import pytest

sys.path[:0] = [__file__.rsplit("/tests/", 1)[0], __file__.rpartition("/")[0]]
corpus_pipeline = pytest.importorskip("corpus_pipeline")
public_tokenizers = pytest.importorskip("public_tokenizers")

from test_documents import cut, shingles  # noqa: E402

from foliant.llm.common import table, written  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    import sentencepiece

    docs = [table(spark, SF, "documents")]
    for name, stage in corpus_pipeline.STAGES:
        docs.append(written(stage(spark, docs[-1], SF), name))
    for before, after in zip(docs[:-2], docs[1:-1], strict=True):
        assert after.columns == docs[0].columns and 0.8 * before.count() <= after.count() <= before.count()
    known, single, clean, mixed, told = ({r.doc_id: r for r in d.collect()} for d in docs[1:])
    sets = {i: shingles(r.text, 5) for i, r in known.items()}
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in sets.items():
        for j, b in sets.items():
            if j < i and a and b and 100 * len(a & b) >= 80 * len(a | b):
                p, q = sorted((top(i), top(j)))
                up[q] = p
    assert set(single) == {i for i in sets if top(i) == i}
    want = cut(docs[2])
    assert {i: r.text for i, r in clean.items()} == {i: want[i, r.text][4].decode(errors="ignore") for i, r in single.items()}
    assert all(r.n_chars == len(r.text) for r in clean.values())
    assert set(mixed) <= set(clean) and set(told) == set(mixed)
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for i, r in mixed.items():
        ids = np.array(sp.encode(r.text), "<u4")
        assert (told[i].n_tokens, told[i].ids_crc32, told[i].round_trip) == (len(ids), zlib.crc32(ids.tobytes()), True)


CLASHING = ("score", "margin", "rejected", "lang_pred", "domain", "quarters", "epoch")


@pytest.mark.parametrize("empty", [False, True])
def test_columns_of_any_name_pass(spark, odd_docs, no_docs, empty):
    """Nulls, empty and repeated rows, an empty table, and names that operators use."""
    from pyspark.sql import functions as F

    docs = (no_docs if empty else odd_docs).drop(*CLASHING)
    docs = written(docs.withColumns({c: F.concat(F.lit(f"{c} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for c in CLASHING}), "odd")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = written(stage(spark, docs, SF), name)
        assert after.columns == docs.columns and after.count() <= docs.count()
        for r in after.collect():
            assert all(r[c] == f"{c} of {'none' if r.doc_id is None else r.doc_id}" for c in CLASHING), name
        docs = after
    assert empty == (docs.count() == 0)


def test_stages_begin_after_a_collection(spark, no_docs):
    """What only an earlier stage used is gone when one has run: an old object without
    a reference, which a collection of young ones leaves."""
    util = spark.sparkContext._jvm.java.util
    for name, stage in corpus_pipeline.STAGES:
        weak, held = util.WeakHashMap(), util.ArrayList()
        weak.put(f"of {name}", 1)
        held.addAll(weak.keySet())
        for _ in range(2):
            spark.sparkContext._jvm.System.gc()
        assert weak.size() == 1
        held.removeAll(held)
        stage(spark, no_docs, SF)
        assert weak.size() == 0, name
