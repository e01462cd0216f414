import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from util import SMALL

from flowsieve.llm import negatives
from flowsieve.llm.queries import op11_hard_negatives

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, every=100, positives=5, negatives=5, percent=80, scale=256):
    """Every anchor against every row, in whole numbers."""
    kept = []
    for vec_id, vector, label in rows:
        if vec_id is not None and label is not None and vector is not None and all(x is not None and math.isfinite(x) for x in vector):
            kept.append((vec_id, [math.floor(scale * x) for x in vector], label))
    out = []
    for a, q, own in kept:
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, v, strict=False)), b, label) for b, v, label in kept)
        near = [(b, -s) for s, b, label in scored if label == own and b != a][:positives]
        for p, ps in near:
            fits = [(b, -s) for s, b, label in scored if label != own and percent * ps <= -100 * s <= 100 * ps][:negatives]
            out += [(a, p, n, b, ps, s) for n, (b, s) in enumerate(fits, 1)]
    return sorted(out)


def mined(made):
    assert made.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in made.collect())


def clustered(seed, n, width, labels=4):
    """Vectors around a few centres, of different lengths, so that keys tell rows apart."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, width)) * rng.uniform(0.2, 3, size=(6, 1))
    return [(i, (centres[i % 6] + rng.normal(size=width) * 0.1).tolist(), int(rng.integers(0, labels))) for i in range(n)]


def test_query_against_brute_force(spark):
    rows = [(r["vec_id"], r["embedding"], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"]) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    made = op11_hard_negatives(spark, SMALL)
    assert dict(made.dtypes) == dict.fromkeys(made.columns, "bigint") | {"rank": "int"}
    assert mined(made) == brute(rows)


@pytest.mark.parametrize("block", [1024, 16])
def test_rings_and_small_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(negatives, "BLOCK", block)
    monkeypatch.setattr(negatives, "GROUP", 5)
    monkeypatch.setattr(negatives, "SAMPLE", 40)
    rows = clustered(1, 900, 8)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit("x")).withColumn("pivot", F.lit(1))
    assert mined(negatives.hard_negatives(df, F.col("vec_id") % 20 == 0)) == brute(rows, 20)


def test_rows_that_the_sample_lacks(spark, monkeypatch):
    monkeypatch.setattr(negatives, "SAMPLE", 3)
    monkeypatch.setattr(negatives, "PIVOTS", 2)
    rows = clustered(2, 300, 6, labels=100)  # labels of two or three rows each
    assert mined(negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 30 == 0)) == brute(rows, 30)


def test_copies_and_ties(spark):
    rows = [(i, [0.5, 0.25, -0.125], i % 3) for i in range(400)] + clustered(3, 50, 3)
    rows = [(i, v, label) for i, (_, v, label) in enumerate(rows)]
    got = mined(negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 100 == 0))
    assert got == brute(rows)


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = clustered(4, 60, 4) + [
        (100, [0.0, 0.0, 0.0, 0.0], 1), (200, [1.0], 2), (300, [], 3), (400, [1.0, 2.0, 3.0, 4.0, 5.0], 1), (500, None, 1), (600, [1.0, None, 1.0, 1.0], 1), (700, [nan, 1.0, 1.0, 1.0], 1), (800, [1.0, -inf, 1.0, 1.0], 0),
        (900, [1.0, 1.0, 1.0, 1.0], None), (None, [1.0, 1.0, 1.0, 1.0], 1), (201, [1e5, -3e5, 2e6, 7.0], 2), (1000, [-1e-20, 0.1, 0.0, 0.0], 2), (1001, [3.0, 3.0, 3.0, 3.0], -5),
    ]
    assert mined(negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 100 == 0)) == brute(rows)


def test_repeated_rows_count_each(spark):
    rows = clustered(5, 40, 4, labels=2)
    rows += [rows[0], rows[0], rows[7], rows[9]]
    assert mined(negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0)) == brute(rows, 20)


def test_large_components(spark):
    rows = [(i, [(-1) ** i * 3e9 * (i % 7 + 1), 12345.678 * i], i % 2) for i in range(120)]
    assert mined(negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 40 == 0, scale=1)) == brute(rows, 40, scale=1)
    assert negatives.scores(np.array([[2.0**53, 2.0**53]]), np.array([[2.0**53, 1.0]])).tolist() == [[2**63 - 1]]


def test_far_rows_are_not_scanned(spark, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK", 32)
    rng = np.random.default_rng(8)
    ways = np.eye(3)
    rows = [(i, (ways[i % 3] * 4 + rng.normal(size=3) * 0.01).tolist(), i % 2) for i in range(1500)]  # three clusters on a sphere
    df = spark.createDataFrame(rows, SCHEMA)
    whole = negatives.whole_vectors(df).cache()
    space = negatives.survey(whole)
    index = negatives.distance_index(whole, space).collect()
    q = negatives.unpacked([whole.filter("vec_id = 0").first()["v"]], np.array([3]), 3)
    near = space.to_pivots(q, np.zeros(1))[0]
    best = float(space.distance((q @ q.T)[0, 0], np.sort(negatives.scores(q, negatives.unpacked([r["v"] for r in whole.collect()], np.full(1500, 3), 3))[0])[-200]))
    reached = [b for b in index if max(near[b["pivot"]] - b["hi"], b["lo"] - near[b["pivot"]], 0) <= best]
    assert 0 < len(reached) < len(index) / 2
    assert all(a["hi"] <= b["lo"] for a, b in zip(index, index[1:], strict=False) if a["pivot"] == b["pivot"])
    assert mined(negatives.hard_negatives(df, F.col("vec_id") % 300 == 0)) == brute(rows, 300)


def test_empty_tables(spark):
    assert negatives.hard_negatives(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 100 == 0).count() == 0
    assert negatives.hard_negatives(spark.createDataFrame(clustered(1, 20, 3), SCHEMA), F.col("vec_id") == -1).count() == 0
    assert negatives.hard_negatives(spark.createDataFrame([(0, [1.0], 1), (1, [1.0], 2)], SCHEMA), F.col("vec_id") == 0).count() == 0
