"""Queries on small tables of odd values give the rows of their SQL, those without one
the rows of brute force."""

import datetime
import time
from functools import cmp_to_key

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa

from foliant import catalog
from foliant.operators import geometry


def both(spark, folder, name, tables):
    """Sorted rows of a query and of its SQL over ``tables``."""
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t, rows in tables.items():
        con.register("_rows", rows)
        con.execute(f"COPY _rows TO '{folder}/{t}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    out = con.execute(catalog.oracle_sql()[name])
    cols = [c[0] for c in out.description]
    theirs = sorted(out.fetchall(), key=repr)
    return sorted((tuple(r[c] for c in cols) for r in catalog.queries()[name](spark, str(folder)).collect()), key=repr), theirs


def test_redrive_by_parts_of_a_second(spark, tmp_path):
    due = datetime.datetime(2024, 1, 29)
    near = [due + datetime.timedelta(microseconds=u) for u in (-1, 0, 1, 500_000, 999_999, 1_000_000)]
    rows = [(x, k) for x in near for k in (0, -1)] + [(None, 0), (None, 0)]
    ids = [3 * i + 1 for i in range(len(rows))]
    # Odd ids count from ts, even ones from a day later.
    moments = [x and x + datetime.timedelta(days=k if i % 2 == 0 else 0) for i, (x, k) in zip(ids, rows, strict=True)]
    events = pd.DataFrame({"event_id": ids, "ts": pd.Series(moments, dtype="datetime64[us]"), "user_id": 1, "event_type": "purchase", "value": 1.0, "props": "{}"})
    mine, theirs = both(spark, tmp_path, "fl08_callback_redrive", {"events": events})
    assert mine == theirs and mine


def lineitem(rows):
    cols = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus"]
    return pd.DataFrame(rows, columns=cols).astype({"l_linenumber": "int32", "l_quantity": "float64"})


def test_lined_text_of_wide_part_keys(spark, tmp_path):
    # The id of the box of page 4 says page 5, whose lines are taller than the box.
    orders = pd.DataFrame({"o_orderkey": [4, 5, 9_000_000]})
    rows = lineitem([(4, 900_001, 1, 1, 8, "A", "F"), (4, 2, 1, 1, 9, "N", "O"), (5, 1_200_000, 7, 2, 10, "R", "F"), (5, 899_999, 999, 1, 10, "A", "O"), (9_000_000, 299_999, 999, 7, 12, "N", "F"), (4, 900_000, 2, 1, 8, "R", "O")])
    mine, theirs = both(spark, tmp_path, "jn15_lined_text", {"lineitem": rows, "orders": orders})
    assert mine == theirs and mine


def seconds_of(work):
    began = time.time()
    out = work()
    return out, time.time() - began


def many_pages(spark, folder):
    """6,000 pages of one to seven boxes, a page of 3,000 and one without a number."""
    rng = np.random.default_rng(5)
    page = np.concatenate([np.repeat(np.arange(6_000), rng.integers(1, 8, 6_000)), np.full(3_000, 10**6), np.full(40, -1)])
    xy = rng.integers(0, 30, (len(page), 2)) * 5.0
    rows = pd.DataFrame({"page": pd.array(page, "Int64"), "kind": rng.choice(["A", "B", None], len(page)), "box_id": rng.permutation(len(page)), "score": rng.integers(0, 9, len(page)) / 8, "x0": xy[:, 0], "x1": xy[:, 0] + 30, "top": xy[:, 1], "bottom": xy[:, 1] + 12})
    rows.loc[rows["page"] == -1, "page"] = pd.NA
    duckdb.connect().execute(f"COPY (SELECT * REPLACE (page::BIGINT AS page) FROM rows) TO '{folder}/boxes.parquet' (FORMAT parquet)")
    return rows, spark.read.parquet(f"{folder}/boxes.parquet")


def test_suppression_of_many_small_groups(spark, tmp_path):
    rows, boxes = many_pages(spark, tmp_path)
    out, took = seconds_of(lambda: geometry.suppressed(boxes).toPandas())
    want = []
    for _, g in rows.sort_values(["score", "box_id"], ascending=[False, True]).groupby(["page", "kind"], dropna=False, sort=False):
        xy, live = g[["x0", "top", "x1", "bottom"]].to_numpy(float), np.arange(len(g))
        while len(live):
            want.append(g["box_id"].iat[live[0]])
            live = live[1:][geometry.iou(xy[live[0]], xy[live[1:]]) <= 0.45]
    assert sorted(out["box_id"]) == sorted(want) and len(want) < len(rows)
    assert took < 40  # a Python call a group took minutes


def test_threshold_order_of_many_pages(spark, tmp_path):
    rows, boxes = many_pages(spark, tmp_path)
    out, took = seconds_of(lambda: geometry.by_rows(boxes, 16.0).toPandas())
    want = {}
    for _, g in rows.sort_values("box_id").groupby("page", dropna=False, sort=False):
        r = list(zip(g["top"].tolist(), g["x0"].tolist(), g["box_id"].tolist(), strict=True))
        r.sort(key=cmp_to_key(lambda a, b: a[1] - b[1] if abs(a[0] - b[0]) < 16.0 else a[0] - b[0]))
        want.update({x[2]: i for i, x in enumerate(r, 1)})
    assert dict(zip(out["box_id"], out["place"], strict=True)) == want
    assert took < 40


def test_groups_over_many_batches():
    keys = [0, 0, 0, 1, 1, 2, 2, None, None, float("nan"), float("nan"), 5]
    for size in (1, 2, 3, 5, 12):
        rows = pa.table({"k": pa.array(keys, pa.float64()), "i": range(12)})
        got = [(t.column("i").to_pylist(), s.tolist()) for t, s in geometry._whole(iter([*rows.to_batches(max_chunksize=size), rows.to_batches()[0].slice(0, 0)]), ["k"])]
        assert [i for t, _ in got for i in t] == list(range(12))
        assert [t[a] for t, s in got for a in s] == [0, 3, 5, 7, 9, 11]
        assert size > 3 or max(len(t) for t, _ in got) < 7
