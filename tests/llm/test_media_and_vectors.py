import struct

import numpy as np
import pytest

from foliant.llm import media, rp_forest
from foliant.llm.graph import components


def _two_tracks():
    """A container with a video track of samples of several sizes and key frames."""
    frames = [b"K" * 10, b"p" * 4, b"p" * 3, b"K" * 8, b"p" * 5]
    sizes = [len(f) for f in frames]

    def moov(base):
        stbl = media._box(
            b"stbl",
            media._full(b"stsd", struct.pack(">I", 1), media._box(b"avc1", bytes(78))),
            media._full(b"stts", struct.pack(">III", 1, 5, 100)),
            media._full(b"stsc", struct.pack(">IIIIIII", 2, 1, 3, 1, 2, 2, 1)),
            media._full(b"stsz", struct.pack(">7I", 0, 5, *sizes)),
            media._full(b"co64", struct.pack(">I", 2), struct.pack(">QQ", base, base + 17 + 7)),
            media._full(b"stss", struct.pack(">III", 2, 1, 4)),
        )
        mdia = media._box(b"mdia", media._full(b"mdhd", struct.pack(">QQIQHH", 0, 0, 1000, 500, 0, 0), version=1), media._full(b"hdlr", bytes(4), b"vide", bytes(13)), media._box(b"minf", stbl))
        return media._box(b"moov", media._box(b"trak", mdia), media._box(b"udta", b"xx"))

    head = media._box(b"ftyp", b"isom", bytes(4))
    base = len(head) + len(moov(0)) + 16
    body = b"".join(frames[:3]) + b"skipped" + b"".join(frames[3:])
    return head + moov(base) + struct.pack(">I4sQ", 1, b"mdat", 16 + len(body)) + body, base


def test_probe_reads_tables():
    data, base = _two_tracks()
    facts = media.probe_bytes(data)
    assert facts["error"] is None and (facts["codec"], facts["duration_s"], facts["n_samples"]) == ("avc1", 0.5, 5)
    assert facts["keyframes"] == [{"offset": base, "length": 10}, {"offset": base + 24, "length": 8}]
    assert media.read_samples(data, media.tracks(data)[0]) == b"K" * 10 + b"pppp" + b"ppp" + b"K" * 8 + b"p" * 5


@pytest.mark.parametrize("bad", [None, b"", b"\0" * 40, b"\0\0\0\x08free", media.pack(bytes(64))[:60], media.pack(bytes(64))[:300]])
def test_probe_of_broken_media(bad):
    assert media.probe_bytes(bad)["error"]


def _fragmented(number=1, trex=True):
    """Two fragments of a track whose own tables are empty: defaults of trex, of tfhd
    and of samples; a run placed by the moof box, one that follows, one placed by the file."""
    pack, full, box = struct.pack, media._full, media._box
    stbl = box(b"stbl", full(b"stsd", pack(">I", 1), box(b"avc1", bytes(78))), *(full(k, bytes(4)) for k in (b"stts", b"stsc", b"stco")), full(b"stsz", bytes(8)))
    mdia = box(b"mdia", full(b"mdhd", pack(">IIIIHH", 0, 0, 1000, 0, 0, 0)), full(b"hdlr", bytes(4), b"vide", bytes(13)), box(b"minf", stbl))
    mvex = box(b"mvex", full(b"trex", pack(">5I", 1, 1, 40, 3, 0x10000))) if trex else b""
    head = box(b"ftyp", b"isom", bytes(4)) + box(b"moov", box(b"trak", full(b"tkhd", pack(">IIII", 0, 0, 1, 0)), mdia), mvex)

    def first(to):
        runs = full(b"trun", pack(">IiI", 3, to, 0), flags=5), full(b"trun", pack(">IIIII", 2, 50, 4, 60, 2), flags=0x300)
        return box(b"moof", box(b"traf", full(b"tfhd", pack(">I", number), flags=0x20000), *runs))

    at = len(head)
    one = first(len(first(0)) + 8) + box(b"mdat", b"KKKpppppp" + b"qqqqrr")
    base = at + len(first(0)) + 8
    second = lambda where: box(b"moof", box(b"traf", full(b"tfhd", pack(">IQII", number, where, 5, 0), flags=0x31), full(b"trun", pack(">I", 2))))
    where = at + len(one) + len(second(0)) + 8
    return head + one + second(where) + box(b"mdat", b"k" * 10), base, where


def test_probe_reads_fragments():
    data, base, where = _fragmented()
    facts = media.probe_bytes(data)
    assert facts["error"] is None and (facts["codec"], facts["n_samples"], facts["duration_s"]) == ("avc1", 7, (3 * 40 + 50 + 60 + 2 * 40) / 1000)
    assert facts["keyframes"] == [{"offset": base, "length": 3}, {"offset": where, "length": 10}]
    assert media.read_samples(data, media.tracks(data)[0]) == b"KKKppppppqqqqrr" + b"k" * 10


@pytest.mark.parametrize("bad", [{"number": 2}, {"trex": False}])
def test_probe_of_fragments_without_their_track_or_sizes(bad):
    assert media.probe_bytes(_fragmented(**bad)[0])["error"]


def test_media_columns(spark):
    df = spark.createDataFrame([(1, bytearray(media.padded(b"abc")), "x"), (2, None, "y"), (1, bytearray(media.padded(b"abc")), "x")], "id int, payload binary, codec string")
    got = media.with_probe(media.with_pack(df)).orderBy("id").collect()
    assert [r.codec for r in got] == ["raw ", "raw ", None] and got[2].error and len(got) == 3


VECTORS = "vec_id long, embedding array<float>, label int, n_links string"


def test_links_against_brute_force(spark):
    rng = np.random.default_rng(0)
    centre = rng.normal(size=(40, 16))
    x = np.concatenate([centre[rng.integers(0, 40, 600)] + 0.12 * rng.normal(size=(600, 16)), np.repeat(centre[:1], 50, 0)]).astype(np.float32)
    odd = [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, [float("inf")] + [1.0] * 15, [1.0, 2.0], [1.0, 2.0]]
    rows = [(i, v.tolist(), 0, "z") for i, v in enumerate(x)] + [(1000 + i, v, 1, "z") for i, v in enumerate(odd)]
    got = {r.vec_id: r for r in rp_forest.linked(spark.createDataFrame(rows, VECTORS), few=60, sample_rows=200).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    true, found = near.sum(), sum(got[i].n_links for i in range(len(x)))
    assert 0.97 * true <= found <= true and all(got[i].n_links <= near[i].sum() for i in range(len(x)))
    assert [got[1000 + i].n_links for i in range(8)] == [0] * 6 + [1, 1]
    assert got[1006].component_id == got[1007].component_id == 1006 and got[1000].kept and not got[1007].kept


def _near(x):
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    return near


def _tops(near):
    """The least row of each row's component."""
    top = np.arange(len(near))
    while (now := np.minimum(top, np.where(near, top, len(top)).min(1))).tolist() != top.tolist():
        top = now
    return top


@pytest.mark.parametrize(("n", "group", "dims"), [(4000, 1000, 64), (3000, 1000, 64), (2500, 300, 3)])
def test_no_link_of_a_large_group_is_lost(spark, n, group, dims):
    """Groups of near and unequal vectors, whole in one node, over several blocks
    and, in few dimensions, over many leaves."""
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, dims))
    x[:group] = x[0] / np.linalg.norm(x[0]) + 0.2 / dims**0.5 * rng.normal(size=(group, dims))
    x = np.concatenate([x, x[:5]])[rng.permutation(n + 5)].astype(np.float32)
    near = _near(x)
    df = spark.createDataFrame([(i, v.tolist(), 0, "z") for i, v in enumerate(x)], VECTORS)
    for more in ({}, {"few": 100, "sample_rows": 500, "block_rows": 700} if dims > 3 else {"few": 100, "block_rows": 60}):
        got = {r.vec_id: r for r in rp_forest.linked(df, **more).collect()}
        assert [got[i].n_links for i in range(len(x))] == near.sum(1).tolist()
        assert [got[i].component_id for i in range(len(x))] == _tops(near).tolist()


def test_a_tree_in_few_dimensions_splits():
    x = rp_forest.unit(np.random.default_rng(1).normal(size=(3000, 3)))
    tree, sizes = rp_forest.fit(x, 0.95)
    leaves = list(rp_forest.route(tree, x, np.arange(3000), rp_forest.half_band(0.95), np.zeros(3000, np.int64)))
    assert len(leaves) > 4 and [len(i) for _, i, _ in leaves] == sizes
    counted = np.zeros((3000, 3000), int)
    for _, i, mask in leaves:
        counted[np.ix_(i, i)] += (mask[:, None] & mask[None, :]) == 0
    assert (counted[_near(x)] == 1).all()


def test_no_vectors(spark):
    assert rp_forest.linked(spark.createDataFrame([], VECTORS)).count() == 0


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1040)] + [(5, None), (7, 7)]
    up = {n: n for e in edges for n in e if n is not None}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if b is not None:
            p, q = sorted((top(a), top(b)))
            up[q] = p
    linked = {n for a, b in edges if b is not None and a != b for n in (a, b)}
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: top(n) for n in linked}
