"""Hard negatives by one-dimensional distance keys.

Highest inner product is nearest distance once every vector x gets one more component, sqrt(M^2 - |x|^2) with M the longest vector's length, and
an anchor q a zero: d^2 = |q|^2 + M^2 - 2 q.x. Rows belong to the nearest of a few pivots, and the index holds them sorted by (pivot, distance to it), cut into
blocks of at most BLOCK rows. By the triangle inequality a row within r of q has a key between (p, d(q, p) - r) and (p, d(q, p) + r) of some pivot p.

A search scans those key intervals for a radius that a sample suggests, then the rings between it and larger ones, until every row that isn't scanned is certainly
farther than the k-th best found. Rows may have to score at most a target's ceiling, so blocks whose rows are all nearer than that are passed over, and no radius
goes beyond the target's floor. Each anchor meets a block once at most, and each round's open anchors and best rows are written tables.

Anchors are searched in groups of at most GROUP that are near each other; groups meet blocks by a join on the pivot and a range of its keys. Scores are whole numbers and exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .workspace import Workspace, arrow_map, shuffle_width

#: Rows of a block of the index, anchors of a group; rows, chosen by a hash, that pivots and first radii come from; pivots.
BLOCK, GROUP, SAMPLE, PIVOTS = 1024, 128, 1024, 16
#: Components beyond this, either way, count as this: the largest that doubles hold exactly together with all smaller ones.
LARGEST = float(2**53)
LOWEST, HIGHEST = -(2**63), 2**63 - 1


def _scaled(scale: int):
    """Vectors as whole numbers: packed in 32-bit floats where those are exact, else in 64-bit ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(2)
            values = np.clip(np.floor(scale * np.asarray(vectors.flatten(), np.float64)), -LARGEST, LARGEST)
            cuts = np.concatenate([[0], np.cumsum(np.asarray(pa.compute.list_value_length(vectors)))]).astype(int)
            own = [values[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            packed = [x.astype("<f4" if not len(x) or np.abs(x).max() < 2**24 else "<f8").tobytes() for x in own]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(np.diff(cuts), pa.int32()), pa.array([float(x @ x) for x in own], pa.float64()), pa.array(packed, pa.binary())], ["vec_id", "label", "dim", "norm", "v"])

    return run


def whole_vectors(rows: DataFrame, scale: int = 256, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, label, dim, norm (the square of the length) and v: each component x as floor(scale * x), packed.

    Rows with a null id, label, vector or component, or with a component that is not finite, are left out. Repeated rows count each."""
    bad = F.exists(F.col(vector), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    good = rows.filter(F.col(vec_id).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull()).filter(~bad)
    return arrow_map(good.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("x")), _scaled(scale), "vec_id long, label long, dim int, norm double, v binary")


def unpacked(vectors: list[bytes], dims: np.ndarray, width: int) -> np.ndarray:
    """A matrix of packed vectors; shorter ones end in zeros."""
    out = np.zeros((len(vectors), width))
    for row, raw, dim in zip(out, vectors, dims, strict=True):
        if dim:
            row[:dim] = np.frombuffer(raw, "<f4" if len(raw) == 4 * dim else "<f8")
    return out


def scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products as exact whole numbers; beyond 64 bits, the nearest of those."""
    if not anchors.size or not rows.size:
        return np.zeros((len(anchors), len(rows)), np.int64)
    if np.abs(anchors).max() * np.abs(rows).max() * rows.shape[1] < 2**53:
        return (anchors @ rows.T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in row] for row in m], object)
    return np.array([[min(max(int(x), LOWEST), HIGHEST) for x in row] for row in whole(anchors) @ whole(rows).T], np.int64)


@dataclass(frozen=True)
class Space:
    """What all tasks know: the width of vectors, M^2, the pivots with their extra component, and the sample."""

    width: int
    longest: float
    pivots: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    rows: np.ndarray

    @property
    def reach(self) -> float:
        """No two points are farther apart."""
        return 2 * float(np.sqrt(self.longest))

    @property
    def slack(self) -> float:
        """More than the error of any distance that is computed here."""
        return 1e-6 * self.reach

    def to_pivots(self, vectors: np.ndarray, extra: np.ndarray) -> np.ndarray:
        points = np.concatenate([vectors, extra[:, None]], axis=1)
        squares = (points**2).sum(axis=1)[:, None] + (self.pivots**2).sum(axis=1)[None] - 2 * points @ self.pivots.T
        return np.sqrt(np.maximum(squares, 0))

    def extra(self, norms: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.longest - norms, 0))

    def distance(self, norm, score) -> np.ndarray:
        """Of an anchor and a row by their score."""
        return np.sqrt(np.maximum(np.asarray(norm) + self.longest - 2.0 * np.asarray(score, np.float64), 0))

    def distance_column(self, score: Column) -> Column:
        return F.sqrt(F.greatest(F.col("norm") + F.lit(self.longest) - F.lit(2.0) * score.cast("double"), F.lit(0.0)))


def _pivots(points: np.ndarray, n: int) -> np.ndarray:
    """Centres of the points by a few rounds of k-means from the first ones."""
    centres = points[:n].copy()
    for _ in range(5 if len(points) else 0):
        near = ((points**2).sum(axis=1)[:, None] + (centres**2).sum(axis=1)[None] - 2 * points @ centres.T).argmin(axis=1)
        for i in range(len(centres)):
            if (near == i).any():
                centres[i] = points[near == i].mean(axis=0)
    return centres


def survey(rows: DataFrame) -> Space:
    """The space of a table of ``whole_vectors``. The sample has at most SAMPLE rows, those of the lowest hash."""
    most = rows.agg(F.max("dim").alias("width"), F.max("norm").alias("longest")).first()
    width, longest = most["width"] or 0, most["longest"] or 0.0
    taken = rows.withColumn("h", F.xxhash64("vec_id", "label", "v")).orderBy("h", "vec_id").limit(SAMPLE).collect()
    matrix, norms = unpacked([r["v"] for r in taken], np.array([r["dim"] for r in taken], int), width), np.array([r["norm"] for r in taken])
    points = np.concatenate([matrix, np.sqrt(np.maximum(longest - norms, 0))[:, None]], axis=1)
    return Space(width, longest, _pivots(points, PIVOTS), np.array([r["vec_id"] for r in taken], np.int64), np.array([r["label"] for r in taken], np.int64), matrix)


def _keyed(space: Space, anchor: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = unpacked(batch.column(4).to_pylist(), np.asarray(batch.column(2)), space.width)
            extra = np.zeros(len(vectors)) if anchor else space.extra(np.asarray(batch.column(3)))
            away = space.to_pivots(vectors, extra)
            home = away.argmin(axis=1)
            made = [pa.array(home, pa.int32()), pa.array(away[np.arange(len(home)), home])]
            if anchor:
                made.append(pa.ListArray.from_arrays(pa.array(np.arange(len(away) + 1) * away.shape[1], pa.int32()), pa.array(away.ravel())))
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, "pivot", "key", *(["near"] if anchor else [])])

    return run


_ROW = "vec_id long, label long, dim int, norm double, v binary, pivot int, key double"


def _sorted(spark, rows: DataFrame) -> DataFrame:
    order = ["pivot", "key", "vec_id", "label"]
    return rows.repartitionByRange(shuffle_width(spark), *order).sortWithinPartitions(*order)


def _blocks(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = TaskContext.get().partitionId() << 40
        for batch in batches:
            pivots, keys = np.asarray(batch.column(5)), np.asarray(batch.column(6))
            ids, labels = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            ends = [*(np.flatnonzero(np.diff(pivots)) + 1).tolist(), len(pivots)] if len(pivots) else []
            out, a = [], 0
            for end in ends:
                while a < end:
                    b = min(a + BLOCK, end)
                    part = batch.slice(a, b - a)
                    rows = unpacked(part.column(4).to_pylist(), np.asarray(part.column(2)), width)
                    exact = "<f4" if not rows.size or np.abs(rows).max() < 2**24 else "<f8"
                    out.append((n, int(pivots[a]), float(keys[a:b].min()), float(keys[a:b].max()), b - a, ids[a:b].tobytes(), labels[a:b].tobytes(), rows.astype(exact).tobytes()))
                    n, a = n + 1, b
            for row in out:
                yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, _BLOCK_TYPES, strict=True)], _BLOCK_NAMES)

    return run


_BLOCK_NAMES = ["block", "pivot", "lo", "hi", "n", "ids", "labels", "vectors"]
_BLOCK_TYPES = [pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]


def distance_index(rows: DataFrame, space: Space) -> DataFrame:
    """``whole_vectors`` sorted by (pivot, distance to it), a row for each block of at most BLOCK: block, pivot, lo and hi (its range of keys), n, ids, labels, vectors."""
    keyed = arrow_map(rows, _keyed(space, False), _ROW)
    return arrow_map(_sorted(rows.sparkSession, keyed), _blocks(space.width), "block long, pivot int, lo double, hi double, n int, ids binary, labels binary, vectors binary")


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = TaskContext.get().partitionId() << 40
    for batch in batches:
        own = np.arange(n, n + batch.num_rows)
        n += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(own // GROUP), *batch.columns], ["aid", "g", *batch.schema.names])


def _place_anchors(rows: DataFrame, space: Space) -> DataFrame:
    """Anchors with a number of their own (aid), the group of near ones (g) and their distances to all pivots (near)."""
    keyed = arrow_map(rows, _keyed(space, True), f"{_ROW}, near array<double>")
    return arrow_map(_sorted(rows.sparkSession, keyed), _grouped, f"aid long, g long, {_ROW}, near array<double>").drop("pivot", "key")


def _eligible(same: bool, ids, labels, own_id, own_label) -> np.ndarray:
    return (labels == own_label) & (ids != own_id) if same else labels != own_label


def _first_radius(space: Space, same: bool, names: list[str]):
    """The distance of the sample's best row for each target, and no more than the target's floor; the farthest of an anchor's targets."""
    at = {c: i for i, c in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = lambda c: batch.column(at[c])  # noqa: E731, B023
            own = unpacked(column("v").to_pylist(), np.asarray(column("dim")), space.width)
            every, radii = scores(own, space.rows), []
            for i, norm, own_id, own_label, high, low in zip(range(len(own)), *[column(c).to_pylist() for c in ("norm", "vec_id", "label", "ceilings", "floors")], strict=True):
                fits = _eligible(same, space.ids, space.labels, own_id, own_label)
                radius = 0.0
                for c, f in zip(high, low, strict=True):
                    held = every[i][fits & (every[i] <= c) & (every[i] >= f)]
                    first = float(space.distance(norm, held.max())) if len(held) else space.reach / 16
                    radius = max(radius, min(first, float(space.distance(norm, f))))
                radii.append(radius)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([-np.inf] * len(own), pa.float64()), pa.array(radii, pa.float64())], [*names, "scanned", "radius"])

    return run


def _scan(space: Space, same: bool, k: int):
    """Best k rows of a block for each target of a group's anchors whose rings reach the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = ([], [], [], [])
            for pivot, lo, hi, n, ids, labels, vectors, group in zip(*[batch.column(i) for i in range(8)], strict=True):
                own, n = group.values, n.as_py()
                field = lambda c: np.asarray(own.field(c))  # noqa: E731, B023
                near = np.asarray(own.field("near").flatten()).reshape(len(own), -1)[:, pivot.as_py()]
                least, most = np.maximum(np.maximum(near - hi.as_py(), lo.as_py() - near), 0), near + hi.as_py()
                active = np.flatnonzero((least <= field("radius") + space.slack) & (least > field("scanned") + space.slack))
                if not len(active):
                    continue
                high, low = own.field("ceilings").to_pylist(), own.field("floors").to_pylist()
                norms, own_ids, own_labels = field("norm"), field("vec_id"), field("label")
                active = [i for i in active if high[i] and most[i] >= space.distance(norms[i], max(high[i])) - space.slack]
                if not active:
                    continue
                ids, labels, raw = np.frombuffer(ids.as_py(), np.int64), np.frombuffer(labels.as_py(), np.int64), vectors.as_py()
                rows = np.frombuffer(raw, "<f4" if len(raw) == 4 * n * space.width else "<f8").reshape(n, space.width).astype(float)
                packed = own.field("v").take(pa.array(active)).to_pylist()
                every = scores(unpacked(packed, field("dim")[active], space.width), rows)
                for line, i in zip(every, active, strict=True):
                    fits = _eligible(same, ids, labels, own_ids[i], own_labels[i])
                    for t, (c, f) in enumerate(zip(high[i], low[i], strict=True)):
                        held = np.flatnonzero(fits & (line <= c) & (line >= f))
                        if len(held):
                            held = held[np.lexsort((ids[held], ~line[held]))[:k]]  # ~x falls as x rises and never overflows
                            for out, more in zip(found, ([own.field("aid")[int(i)].as_py()] * len(held), [t] * len(held), ids[held].tolist(), line[held].tolist()), strict=True):
                                out += more
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(found, (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["aid", "target", "vec_id", "score"])

    return run


_FOUND = "aid long, target int, vec_id long, score long"


def _best(found: DataFrame, k: int) -> DataFrame:
    """The first k rows of each target; Spark thins them a task before the shuffle."""
    place = F.row_number().over(Window.partitionBy("aid", "target").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k)


def search(work: Workspace, name: str, anchors: DataFrame, index: DataFrame, space: Space, same: bool, k: int) -> DataFrame:
    """aid, target, rank, vec_id and score: for each anchor and each of its targets (ceilings, floors: arrays of scores) the first k rows with the anchor's label (``same``; other ids only)
    or with another one that score within the target, highest first, ties by lower vec_id."""
    spark, schema = anchors.sparkSession, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in anchors.schema.fields)
    opened = work.write(arrow_map(anchors, _first_radius(space, same, anchors.columns), f"{schema}, scanned double, radius double"), f"{name}-open-0")
    best = spark.createDataFrame([], f"{_FOUND}, rank int")
    directory = index.select("block", "pivot", "lo", "hi")
    for turn in range(1, 100):
        spans = opened.select("g", F.posexplode("near").alias("pivot", "at"), "radius").groupBy("g", "pivot").agg(F.min(F.col("at") - F.col("radius")).alias("low"), F.max(F.col("at") + F.col("radius")).alias("high"))
        reached = (directory["pivot"] == spans["pivot"]) & (F.col("hi") >= F.col("low") - space.slack) & (F.col("lo") <= F.col("high") + space.slack)
        pairs = directory.join(spans, reached).select("g", "block")
        fields = ["aid", "vec_id", "label", "dim", "norm", "v", "near", "ceilings", "floors", "scanned", "radius"]
        groups = opened.groupBy("g").agg(F.collect_list(F.struct(*fields)).alias("group"))
        met = pairs.join(groups, "g").join(index, "block").select("pivot", "lo", "hi", "n", "ids", "labels", "vectors", "group")
        found = arrow_map(met, _scan(space, same, k), _FOUND)
        best = work.write(_best(best.drop("rank").unionByName(found), k), f"{name}-best-{turn}")
        last = best.groupBy("aid", "target").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("worst"))
        asked = opened.select("aid", "norm", "radius", F.posexplode(F.arrays_zip("ceilings", "floors")).alias("target", "t")).join(last, ["aid", "target"], "left")
        full, bottom = F.coalesce(F.col("n") == k, F.lit(False)), space.distance_column(F.col("t.floors"))
        kth = space.distance_column(F.col("worst"))
        done = (full & (kth <= F.col("radius"))) | (F.col("radius") >= bottom) | (F.col("radius") >= space.reach)
        wider = F.least(F.when(full, kth).otherwise(F.greatest(2 * F.col("radius"), F.lit(space.reach / 16))), bottom, F.lit(space.reach))
        further = asked.filter(~done).groupBy("aid").agg(F.max(wider).alias("wider"))
        left = opened.join(further, "aid").withColumn("scanned", F.col("radius")).withColumn("radius", F.col("wider")).drop("wider")
        opened = work.write(left, f"{name}-open-{turn}")
        if opened.isEmpty():
            return best
    raise RuntimeError("the search doesn't end")


def hard_negatives(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 5, percent: int = 80, scale: int = 256, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    Anchors are the rows that ``anchor`` (a condition on vec_id) picks. A score is the inner product of vectors of whole numbers, floor(scale * x). An anchor's positives are its first rows with its
    label and another id; a positive's negatives the first rows of another label that score at most as it does and at least ``percent`` of that; fewer where there are fewer. Highest scores come
    first, ties by lower id. A positive with a score below zero has none. See ``whole_vectors`` for rows that take no part. A shorter vector ends in zeros beside a longer one; an empty one is all zeros. Repeated
    rows are rows each, as anchors too. Other columns are not read; an empty table gives an empty result."""
    spark = rows.sparkSession
    work = Workspace(spark, "negatives")
    whole = work.write(whole_vectors(rows, scale, vec_id, vector, label), "rows")
    space = survey(whole)
    if not len(space.ids):
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    index = work.write(distance_index(whole, space), "index")
    anchors = work.write(_place_anchors(whole.filter(anchor), space), "anchors")
    bound = lambda x: F.array(F.lit(x).cast("long"))
    first = search(work, "positives", anchors.withColumns({"ceilings": bound(HIGHEST), "floors": bound(LOWEST)}), index, space, True, positives)
    near = first.filter("score >= 0").groupBy("aid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "score"))), lambda x: x["score"]).alias("ceilings"))
    floors = F.transform("ceilings", lambda s: F.ceil(s.cast("decimal(20,0)") * F.lit(percent) / F.lit(100)).cast("long"))
    asked = work.write(anchors.join(near, "aid").withColumn("floors", floors), "asked")
    second = search(work, "negatives", asked, index, space, False, negatives)
    named = first.join(anchors.select("aid", F.col("vec_id").alias("anchor_id")), "aid").select("aid", "anchor_id", (F.col("rank") - 1).alias("target"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return second.join(named, ["aid", "target"]).select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
