"""Golden values of single operators."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from foliant.functions import text as t
from foliant.operators import blocks, chunking, evaluation, geometry, operations, store

BLOCK = "doc_id string, pos int, block_id string, block_type string, text string, token_count int, pages array<int>, asset_refs array<string>, level int, summary string"


def chunked(spark, rows, **more):
    df = spark.createDataFrame([("d", i, *r) for i, r in enumerate(rows)], BLOCK)
    df = df.withColumn("rendered", blocks.rendered(F.col("block_type"), F.col("text")))
    return chunking.chunks(df, **more).orderBy("chunk_no").collect()


def test_asset_aware_chunks(spark):
    out = chunked(spark, [("b1", "text", "a", 5, [1], [], None, ""), ("b2", "table", "t", 12, [1], ["table-1"], None, "s"), ("b3", "text", "c", 4, [1], [], None, "")], most=256, strategy="asset_aware", window=1)
    assert [r.block_refs for r in out] == [["b1"], ["b2"], ["b3"]] and out[1].direct_refs == ["table-1"] and out[1].text == "[Table]\nt"
    assert out[0].context_refs == ["table-1"] and out[0].text.endswith("Related assets: s") and out[0].strategy == "asset_aware_v1"


def test_page_aware_and_titles(spark):
    out = chunked(spark, [("p1", "text", "a", 4, [1], [], None, ""), ("p2", "text", "b", 4, [2], [], None, "")], most=256, strategy="page_aware")
    assert [r.pages for r in out] == [[1], [2]]
    out = chunked(spark, [("h1", "title", "Top", 60, [1], [], 1, ""), ("h2", "title", "Sub", 10, [1], [], 2, ""), ("b", "text", "body", 60, [1], [], None, "")], most=64)
    assert out[-1].title_path == ["Top", "Sub"] and out[-1].text == "Section: Top > Sub\n\nbody" and out[-1].chunk_id.startswith("chunk-0002-")


def test_cuts():
    assert list(chunking.cuts([5, 5, 5, 5], 64)) == [(0, 4)]
    assert list(chunking.cuts([100, 5], 64)) == [(0, 1), (1, 2)]
    assert list(chunking.cuts([30, 30, 30, 30], 64, 30)) == [(0, 2), (1, 3), (2, 4)]
    assert chunking.limits(10, 500) == (64, 32)
    assert chunking.text_parts("a!b?c", most=0, count=len) == ["a", "b", "c"]


def test_scores_of_the_golden_sample(spark):
    seen = spark.createDataFrame([("s", x) for x in ("a", "b", "c")], "sample string, item string")
    true = spark.createDataFrame([("s", x) for x in ("a", "b", "c", "d")], "sample string, item string")
    r = evaluation.multiset_scores(seen, true, "sample", "item").first()
    assert (r.precision, r.recall) == (1.0, 0.75) and abs(r.f1 - 6 / 7) < 1e-12
    df = spark.createDataFrame([("hello brave world", "hello world")], "a string, b string")
    a, b = F.col("a"), F.col("b")
    assert df.select(F.levenshtein(a, b), t.error_rate(a, b), evaluation.word_error_rate("a", "b")).first()[:] == (6, 6 / 11, 0.5)
    assert evaluation.table_similarity.func(pd.Series(["<table><tr><td>1</td><td>2</td></tr></table>"]), pd.Series(["<table><tr><td>1</td><td>3</td></tr></table>"]))[0] == 0.75


def test_specs(spark):
    df = spark.createDataFrame([("3/min",), ("1.5mb/day",), ("x",)], "s string").select(t.rate_spec(F.col("s")).alias("r"))
    assert [None if r.r is None else r.r[:] for r in df.collect()] == [(3, 60), (1_500_000, 86_400), None]
    df = spark.createDataFrame([(10,), (2048,), (3 * 1024**2,)], "n long").select(t.humanised(F.col("n")))
    assert [r[0] for r in df.collect()] == ["10 B", "2.00 KB", "3.00 MB"]


@pytest.mark.parametrize(("limit", "amounts", "allowed"), [(1, [1, 1], [True, False]), (10, [6, 6], [True, False])])
def test_limits(spark, limit, amounts, allowed):
    df = spark.createDataFrame([(i, "u", a) for i, a in enumerate(amounts)], "event_id long, who string, amount long").withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    out = operations.limited(df, ["who"], limit, 60, F.col("amount")).orderBy("event_id").collect()
    assert [r.allowed for r in out] == allowed


def test_store_rules(spark):
    df = spark.createDataFrame([(1, "k", 5), (2, "k", 3), (3, None, 1)], "id int, key string, at int")
    first, rest = store.deduplicated(df.filter("key IS NOT NULL"), ["key"], ["at", "id"])
    assert [r.id for r in first.collect()] == [2] and [(r.id, r.canonical_id) for r in rest.collect()] == [(1, 2)]
    assert store.where_equal(df, key=None, id="").count() == 3
    assert store.upserted(df, df.filter("id = 1").withColumn("at", F.lit(9)), ["id"]).filter("at = 9").count() == 1


def test_boxes(spark):
    rows = [(i, 1, "text", *xy, s) for i, (xy, s) in enumerate([((0.0, 10.0, 0.0, 10.0), 0.9), ((1.0, 11.0, 0.0, 10.0), 0.8), ((50.0, 60.0, 0.0, 10.0), 0.7)])]
    df = spark.createDataFrame(rows, "box_id int, page int, kind string, x0 double, x1 double, top double, bottom double, score double")
    assert sorted(r.box_id for r in geometry.suppressed(df).collect()) == [0, 2]
    cols = geometry.columned(df.unionByName(df.withColumn("x0", F.col("x0") + 300).withColumn("x1", F.col("x1") + 300))).collect()
    assert {r.col_id for r in cols if r.x0 < 100} == {0} and {r.col_id for r in cols if r.x0 > 100} == {1}
    cells = [dict(x0=x, x1=x + 5, top=y, bottom=y + 8, text=f"{x}{y}") for y in (0, 20) for x in (0, 50)]
    grid = geometry.grid(cells)
    assert grid == [["00", "500"], ["020", "5020"]] and geometry.grid_sentences(grid) == ["00：020; 500：5020"]
    assert geometry.grid_html(grid) == "<table><tr><th>00</th><th>500</th></tr><tr><td>020</td><td>5020</td></tr></table>"


def test_columns_by_brute_force():
    import itertools

    rng = __import__("random").Random(3)

    def squares(v):
        return sum((a - sum(v) / len(v)) ** 2 for a in v)

    def plain_silhouette(x, own):
        total = 0.0
        for i, a in enumerate(x):
            mine = [abs(a - b) for j, b in enumerate(x) if own[j] == own[i] and j != i]
            others = [sum(abs(a - b) for j, b in enumerate(x) if own[j] == c) / own.count(c) for c in set(own) if c != own[i]]
            if mine:
                p, q = sum(mine) / len(mine), min(others)
                total += (q - p) / max(p, q) if max(p, q) > 0 else 0
        return total / len(x)

    def divided(x, k):
        v = sorted(set(x))
        best = min((sum(squares([a for a in x if v[s] <= a <= v[e - 1]]) for s, e in zip((0, *c), (*c, len(v)))), c) for c in itertools.combinations(range(1, len(v)), k - 1))[1]
        return [sum(v.index(a) >= s for s in best) for a in x]

    for _ in range(150):
        x = [float(rng.choice([0, 5, 8, 100, 104, 210, 215, 300])) for _ in range(rng.randrange(1, 8))]
        low, wide = min(x), max(x) + 60 - min(x)
        snapped = [low if abs(a - low) < 0.12 * wide else a for a in x]
        scores = [(0.0, -1)]
        for k in range(2, min(4, len(x), len(set(snapped))) + 1):
            if k < len(x):
                scores.append((round(plain_silhouette(snapped, divided(snapped, k)), 9), -k))
        k = -max(scores)[1]
        import numpy as np

        assert geometry.columns_of(np.array(x), np.array(x) + 60).tolist() == divided(x, k)


def test_retention_with_nulls_and_equal_rows(spark):
    rows = [(9, None), (8, None), (7, "x"), (8, None), (1, "x"), (1, "x")]
    df = spark.createDataFrame(rows, "at int, note string").withColumn("ts", F.timestamp_seconds("at"))
    old = lambda keep: sorted((r.at, r.note) for r in operations.expired(df, F.col("ts"), F.lit("2024-01-01").cast("timestamp"), 1, keep, [F.desc("ts"), F.desc("note")]).collect())
    assert old(2) == [(1, "x"), (1, "x"), (7, "x"), (8, None)] and old(5) == [(1, "x")] and old(9) == []


def test_json_parts():
    import json
    import random

    from foliant.sources.formats import json_parts

    rng = random.Random(4)

    def made(depth):
        if depth == 0 or rng.random() < 0.3:
            return rng.choice(["x" * rng.randrange(40), rng.randrange(1000), None, True, "é\"" * 5])
        return [made(depth - 1) for _ in range(rng.randrange(5))] if rng.random() < 0.4 else {f"k{i}": made(depth - 1) for i in range(rng.randrange(5))}

    def leaves(v, path=()):
        if isinstance(v, list):
            v = {str(i): x for i, x in enumerate(v)}
        if isinstance(v, dict):
            return [y for k, x in v.items() for y in leaves(x, (*path, k))]
        return [(path, v)]

    for _ in range(300):
        value = {"top": made(4), "more": made(4)}
        parts = json_parts(value, 120)
        assert [y for p in parts for y in leaves(p)] == leaves(value)
        assert all(p for p in parts) and all(len(json.dumps(p, ensure_ascii=False)) >= 50 for p in parts[:-1])
    assert json_parts({"a": {"b": 1}, "c": [1, 2]}) == [{"a": {"b": 1}, "c": {"0": 1, "1": 2}}]
    assert json_parts("x") == [{"value": "x"}] and json_parts({}) == [] and len(json_parts({str(i): "y" * 30 for i in range(20)}, 100)) > 5
