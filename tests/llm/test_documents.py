"""Operators over documents against brute force, on odd inputs and the smallest table."""

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foliant.llm import jaccard_join, language_id, media, mixture, pieces, quality, repeats, token_files, token_rollup
from foliant.llm.common import scratch, table, written

public_tokenizers = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def rows_of(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture(params=["odd", "none", "sf"])
def docs(request, spark, odd_docs, no_docs):
    return {"odd": odd_docs, "none": no_docs, "sf": None}[request.param] if request.param != "sf" else table(spark, SF, "documents")


def key(x):
    return tuple((v is not None, v) for v in x)


def test_media_round_trip(docs):
    got = sorted(rows_of(media.stored_text(docs).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32")), key=key)
    want = []
    for r in docs.collect():
        data = (r.text or "").encode()
        full = data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))
        want.append((r.doc_id, len(data), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:])))
    assert got == sorted(want, key=key)


def test_language_learns_and_holds_out(spark):
    docs = table(spark, SF.replace("0.001", "0.01"), "documents")
    out = language_id.classify(docs, language_id.learned_from(docs)).withColumn("held", language_id.held_out())
    share = out.filter("held").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert share >= 0.95
    assert out.filter("NOT rejected").count() >= 0.97 * docs.count()


def test_language_of_odd_texts(odd_docs, no_docs):
    dicts = language_id.learned_from(odd_docs, sample_range=(1, 1000))
    out = {(r.doc_id, r.text): r for r in language_id.classify(odd_docs, dicts).collect()}
    for text in (None, "", "   \n\t ", "0123456789 " * 40):
        r = next(r for (_, t), r in out.items() if t == text)
        assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
    assert all(0 <= r.score <= 1 for r in out.values()) and len(odd_docs.collect()) == language_id.classify(odd_docs, dicts).count()
    assert language_id.learned_from(no_docs) == {} and language_id.classify(no_docs, {}).count() == 0
    assert language_id.classify(odd_docs, {}).filter("lang_pred <> 'und'").count() == 0


def test_token_files(docs):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    got = sorted(rows_of(token_files.encoded(docs, path)), key=lambda r: r[1])
    tok, at, want = Tokenizer.from_file(path), 0, []
    for r in sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text is not None, (r.text or "").encode())):
        ids = [*tok.encode(r.text or "", add_special_tokens=False).ids, 2]
        want.append((r.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want


def test_encoder_cuts_at_any_white_space():
    import public_tokenizers
    import pyarrow as pa

    texts = ["a\x0bb\x0cc  d", "it's don'\x0bt I'LL\x0c", "\x0b", "\x1c\x1d x\x85y z", "é\x0cé İx ſ K", "<|startoftext|> a<|endoftext|>\x0bq", "<|start\x0boftext|>", None, "", "e\x0b\u0301 A1b2 _x_ 日本\x0c語"]
    enc = token_files.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    want = [enc.tok.encode(t or "", add_special_tokens=False).ids for t in texts]
    for _ in range(2):  # new words, then remembered ones
        ids, n = enc.encode(pa.array(texts))
        assert ids.tolist() == sum(want, [])
        assert n.tolist() == [len(w) for w in want]


def test_pieces_equal_the_library(docs):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    got = sorted(rows_of(pieces.encoded(docs, path)), key=key)
    ids = [(r.doc_id, np.array(sp.encode(r.text or ""), "<u4"), pieces.SPACE not in (r.text or "")) for r in docs.collect()]
    assert got == sorted([(d, len(x), zlib.crc32(x.tobytes()), same) for d, x, same in ids], key=key)


def shingles(text, n):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(LOW)) if x]
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_jaccard_components(docs, n, percent):
    sets = [(r.doc_id, shingles(r.text, n)) for r in docs.collect()]
    up = {d: d for d, _ in sets if d is not None}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            both = len(x & y)
            if a is not None and b is not None and both and 100 * both >= percent * (len(x) + len(y) - both):
                p, q = sorted((top(a), top(b)))
                up[q] = p
    want = sorted([(d, len(s), top(d) if d is not None else None) for d, s in sets], key=key)
    assert sorted(rows_of(jaccard_join.clustered(docs, n, percent)), key=key) == want


def test_jaccard_of_ids_with_different_texts(spark):
    """Each text of an id makes its links, whichever of their digests is less, and
    others keep theirs."""
    rng = np.random.default_rng(11)
    prose = lambda: " ".join(f"w{x}" for x in rng.integers(0, 10**6, 120))
    rows, want = [], []
    for base in range(0, 600, 100):
        one, two, alone = prose(), prose(), prose()
        rows += [(base + 5, one), (base + 5, two), (base + 5, ""), (base + 5, two), (base + 9, two), (base + 10, two + " end"), (base + 20, one + " end"), (base + 30, alone), (base + 40, ""), (None, two)]
        want += [(d, base + 5) for d in (5, 5, 5, 5, 9, 10, 20)] + [(30, base + 30), (40, base + 40), (None, None)]
    want = [(d if d is None else d + 100 * (k // 10), c) for k, (d, c) in enumerate(want)]
    got = jaccard_join.clustered(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "component_id")
    assert sorted(rows_of(got), key=key) == sorted(want, key=key)


def test_jaccard_bounds_lose_no_pair():
    """Linked rows share a class, agree in a block and have near sketches."""
    rng = np.random.default_rng(3)
    for percent in (80, 90):
        for n in (4, 5, 9, 10, 30, 75, 200, 431, 1200, 2999):
            d = jaccard_join.differing(n, percent)
            if not d:
                continue
            a = np.unique(rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64))[: n + d]
            for x, y in ((a[:n], np.delete(a, rng.choice(n, 0))[: n + d]), (np.delete(a[:n], rng.choice(n, d // 2, replace=False)), a[:n])):
                both, either = len(np.intersect1d(x, y)), len(np.union1d(x, y))
                if 100 * both < percent * either:
                    continue
                shared = set(jaccard_join.classes(len(x), percent)) & set(jaccard_join.classes(len(y), percent))
                assert shared
                assert any(set(jaccard_join.signatures(x, c, percent).tolist()) & set(jaccard_join.signatures(y, c, percent).tolist()) for c in shared)
                for c in shared:
                    far = sum((p ^ q).bit_count() for p, q in zip(jaccard_join.sketch(x, c, percent), jaccard_join.sketch(y, c, percent), strict=True))
                    assert jaccard_join.may_link(far, len(x), len(y), percent)


def cut(docs, window=100):
    order = sorted({(r.doc_id is not None, r.doc_id or 0, r.text or "") for r in docs.collect()}, key=lambda r: (r[0], r[1], repeats.xxhash.xxh64_intdigest(r[2].encode())))
    seen, out = set(), {}
    for has, d, t in order:
        b, gone = t.encode(), bytearray(len(t.encode()))
        for i in range(len(b) - window + 1):
            w = b[i : i + window]
            if w in seen:
                gone[i : i + window] = b"\1" * window
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[d if has else None, t] = (len(b), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest(), kept)
    return out


def test_long_repeats(docs):
    want = cut(docs)
    rows = docs.select("doc_id", "text").collect()
    assert sorted(rows_of(repeats.digest(docs)), key=key) == sorted([(r.doc_id, *want[r.doc_id, r.text or ""][:4]) for r in rows], key=key)
    left = sorted([(r.doc_id, r.text) for r in repeats.cut(docs).collect()], key=key)
    assert left == sorted([(r.doc_id, None if r.text is None else want[r.doc_id, r.text][4].decode(errors="ignore")) for r in rows], key=key)
    assert repeats.cut(docs).columns == docs.columns


@pytest.mark.parametrize("most", [150, 1000, 20_000])
def test_no_index_of_repeats_is_larger_than_its_bound(monkeypatch, most):
    """Many different phrases share an anchor: before a passage, after it, and within."""
    rng = np.random.default_rng(3)
    word = lambda n, top=122: bytes(rng.integers(97, top, n, dtype=np.uint8))
    common = [word(n) for n in (60, 105, 180)]
    texts = [word(int(rng.integers(0, 90)), 99) + common[i % 3] + word(int(rng.integers(0, 90)), 99) for i in range(150)]
    texts += [t[int(rng.integers(0, 40)) :] for t in texts[::5]] + [word(150)] * 3 + [b"", b"a" * 300, b"ab" * 150]
    buf, ends = repeats._joined(texts)
    a, _, _, h = repeats.phrases(buf, ends)
    hits = np.empty(len(h), repeats.HIT)
    hits["doc"], hits["h"] = np.searchsorted(ends, a, "right"), h
    z = repeats.zstandard.ZstdCompressor()
    docs = pa.table({"doc": pa.array(range(len(texts)), pa.int64()), "dig": pa.array(range(len(texts)), pa.int64()), "packed": [z.compress(t) for t in texts]})
    sizes, whole = [], repeats.RunIndex
    monkeypatch.setattr(repeats, "RunIndex", lambda own: sizes.append(sum(map(len, own))) or whole(own))
    monkeypatch.setattr(repeats, "INDEX_BYTES", most, raising=False)
    sent = repeats._send(docs, pa.table({"hits": pa.array([hits.tobytes()])}), 1)
    marks = repeats._unpack(repeats._indexed(sent, 1), "marks", repeats.MARK)
    have = {doc: x.tolist() for (doc, _), x in repeats._spans(marks).items()}
    seen, want = set(), {}
    for i, t in enumerate(texts):
        gone = np.zeros(len(t) + 2, np.int8)
        for j in range(len(t) - 99):
            if t[j : j + 100] in seen:
                gone[j + 1 : j + 101] = 1
            seen.add(t[j : j + 100])
        edge = np.diff(gone)
        if gone.any():
            want[i] = np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)], 1).tolist()
    assert have == want and len(want) > 60
    assert max(sizes) <= most


def test_run_index_matches_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(20):
        texts = list(dict.fromkeys(bytes(rng.integers(97, 99 + rng.integers(3), rng.integers(1, 40), dtype=np.uint8)) for _ in range(30)))
        index = repeats.RunIndex(texts)
        all_ = [(i, t[j:]) for i, t in enumerate(texts) for j in range(len(t) + 1)]
        place = {p: k for k, p in enumerate((i, len(t)) for i, t in all_)}
        order = sorted(range(len(all_)), key=lambda k: ([c + 1 for c in all_[k][1]] + [0], all_[k][0]))
        assert index.order.tolist() == order
        of, share = index.statistics()
        for a, b in zip(order, order[1:], strict=False):
            x, y = all_[a][1], all_[b][1]
            n = next((i for i, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
            assert (of[b], share[b]) == (a, n)
        assert len(place) == len(all_) and len(index.heads) <= len(order)
        seen = {}
        want = []
        for i, t in all_:
            want.append(len(t) >= 5 and seen.setdefault(t[:5], i) < i)
        assert index.repeated(5).tolist() == want


def test_mixture_against_brute_force(odd_docs, no_docs, spark):
    weights = {("en",): 2.0, ("en", "src0"): 3.0}
    for docs, total in ((odd_docs, 0.7), (no_docs, 0.7), (table(spark, SF, "documents"), 1.6), (odd_docs, 0)):
        docs = docs.withColumn("size", F.when(F.col("text").isNotNull(), F.length("text")))
        rows = docs.withColumns({f"h{e}": F.shiftrightunsigned(F.xxhash64(F.lit(3), F.lit(e).cast("long"), "doc_id", "text"), 2) for e in range(3)}).collect()
        leaf = {}
        for r in rows:
            leaf.setdefault((r.lang, r.source), []).append(r)
        have = {k: sum(r["size"] or 0 for r in v) for k, v in leaf.items()}
        amount = total if isinstance(total, int) else int(mixture.floor(mixture.Fraction(total).limit_denominator(10**6) * sum(have.values())))
        plan = mixture.budgets(amount, have, weights, 2)
        want = []
        for k, v in leaf.items():
            if not plan.get(k):
                continue
            whole, rest = divmod(plan[k], have[k])
            want += [(r.doc_id, e) for r in v for e in range(whole)]
            used = 0
            for r in sorted(v, key=lambda r: r[f"h{whole}"]):
                used += r["size"] or 0
                if used > rest or not rest:
                    break
                want.append((r.doc_id, whole))
        got = [(r.doc_id, r.epoch) for r in mixture.select(docs, ("lang", "source"), "size", total, weights, 3, 2).collect()]
        assert sorted(got, key=key) == sorted(want, key=key)


def test_budgets_go_to_siblings_first():
    have = {("a", "x"): 10, ("a", "y"): 100, ("b", "z"): 100}
    assert mixture.budgets(100, have, {}, 1) == {("a", "x"): 10, ("a", "y"): 40, ("b", "z"): 50}
    assert mixture.budgets(1000, have, {}, 1) == have
    assert mixture.budgets(150, {("a", "x"): 10, ("a", "y"): 20, ("b", "z"): 200}, {}, 1) == {("a", "x"): 10, ("a", "y"): 20, ("b", "z"): 120}


def test_quality_model(spark, odd_docs, no_docs):
    out, model = quality.scored(table(spark, SF.replace("0.001", "0.01"), "documents"))
    both = out.join(table(spark, SF.replace("0.001", "0.01"), "labels"), "doc_id")
    good, bad = (both.filter(f"quality = {q}").agg(F.avg(F.col("keep").cast("int"))).first()[0] for q in (1, 0))
    assert good >= 0.97 and bad <= 0.2
    assert set(model.accuracy()) == set(quality.LABELLERS)
    out, _ = quality.scored(odd_docs)
    assert out.count() == odd_docs.count() and out.filter("score IS NULL").count() == 0
    assert quality.scored(no_docs)[0].count() == 0


def test_samples_hold_different_texts(spark, monkeypatch):
    """Copies fill neither a language's dictionary nor the scorer's sample."""
    texts = [" ".join(f"{chr(97 + i)}{chr(97 + j)}{w}" for w in ("river", "stone", "cloud") * 40) for i in range(6) for j in range(10)]
    docs = spark.createDataFrame([(i, t, lang) for i, t in enumerate(texts) for lang in ("en", "de") for _ in range(30)], "doc_id long, text string, lang string")
    for data in language_id.fit(docs, sample_rows=20).values():
        parts = data.split(b"\n")
        assert len(parts) == len(set(parts)) == 20 and {p.decode() for p in parts} <= set(texts)
    seen = []
    train = quality.train
    monkeypatch.setattr(quality, "train", lambda t, labels: seen.extend(t) or train(t, labels))
    quality.scored(docs, sample_rows=20)
    assert len(seen) == len(set(seen)) == 20


def test_rollup_commits_once(spark, odd_docs, no_docs):
    store = token_rollup.Rollup(spark, scratch(spark, "rollup"))
    add = odd_docs.select(F.lit("insert").alias("op"), "source", "lang", F.lit("v1").alias("tokenizer"), F.col("n_chars").alias("n_tokens"), "kept")
    assert store.totals().count() == 0
    assert store.commit(1, add) and not store.commit(1, add)
    assert store.totals().agg(F.sum("n_docs"), F.sum("n_tokens")).first()[:] == (odd_docs.count(), odd_docs.agg(F.sum("n_chars")).first()[0])
    revise = add.filter("source = 'src0'").withColumns({"op": F.lit("revise"), "old_tokens": F.col("n_tokens"), "n_tokens": F.lit(0)})
    store.commit(2, revise)
    store.compact()
    assert not store.commit(2, revise)
    assert store.totals().filter("source = 'src0'").agg(F.sum("n_tokens")).first()[0] == 0
    store.commit(3, no_docs.select(F.lit("insert").alias("op"), "source", "lang", F.lit("v1").alias("tokenizer"), "n_chars"))
    store.commit(4, add.withColumn("op", F.lit("delete")).withColumn("n_tokens", F.when(F.col("source") == "src0", 0).otherwise(F.col("n_tokens"))))
    assert store.totals().count() == 0
    with pytest.raises(Exception, match="unknown change"):
        store.commit(5, add.withColumn("op", F.lit("rename")))


def test_written_survives_clashing_names(odd_docs):
    assert written(odd_docs, "t").count() == odd_docs.count()


def test_jaccard_pairs_of_near_copies_meet_once(spark, monkeypatch):
    """Copies that share many blocks but mostly don't link: a pair is given by one of
    their groups, and no link is lost."""
    rng = np.random.default_rng(3)
    base, rows = [f"w{x}" for x in range(150)], []
    for i in range(90):
        words = list(base)
        for k in rng.integers(0, 150, 2).tolist():
            words[k] = f"x{i}"
        rows.append((i, " ".join(words)))
    given, whole = [], jaccard_join.linked

    def counted(pairs, *rest):
        given.append(pairs.groupBy("a", "b").count().agg(F.sum("count").alias("n"), F.count("*").alias("different")).first())
        return whole(pairs, *rest)

    monkeypatch.setattr(jaccard_join, "linked", counted)
    got = rows_of(jaccard_join.clustered(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80))
    sets, own = [shingles(t, 5) for _, t in rows], list(range(90))
    for i in range(90):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                low, high = sorted((own[i], own[j]))
                own = [low if o == high else o for o in own]
    assert sorted(got) == [(i, len(sets[i]), own[i]) for i in range(90)]
    assert given[1].different > 40 and given[1].n <= 1.2 * given[1].different
