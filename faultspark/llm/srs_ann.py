"""Nearest neighbours through low-dimensional stable projections.

Vectors are projected to eight dimensions with Gaussian (2-stable) weights: the
square of a projected distance over that of the distance has a chi-square
distribution with eight degrees of freedom. A kd-tree over the projections cuts
the points into cells, and each cell into leaves. A query meets points from the
near leaves outwards and verifies them by their distance, until the chi-square
test holds: a neighbour as near as the present k-th would, with probability
``SURE``, have been met by now.

Spark runs this in two rounds: a query searches its own cell, which gives a
radius, and then the other cells whose boxes the test does not rule out at that
radius. A cell with more points than ``PART`` is parted, one with more visits
than ``BLOCK`` is met by its visitors in blocks; no other is copied. Cells are
bounded in number by the sample they are learned from. Equal vectors are one
point with its smallest ids.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultspark.llm import work

DIMENSIONS = 8
NEIGHBOURS = 10
SURE = 0.98
CELL = 2048
LEAF = 64
STEP_LEAVES = 16
PART = 16_384
BLOCK = 4096
TAKEN = 4096
SAMPLE = 20_000
CELLS = 4096
NO_ID = -(1 << 63)
SEED = 11


def chi_square(x: float, dimensions: int = DIMENSIONS) -> float:
    """The distribution function, for an even number of degrees of freedom."""
    half, term, total = x / 2, 1.0, 0.0
    for i in range(dimensions // 2):
        total += term
        term *= half / (i + 1)
    return 1 - math.exp(-half) * total


def stop_ratio(sure: float = SURE, dimensions: int = DIMENSIONS) -> float:
    """Squared projected over squared true distance at which the test holds."""
    low, high = 0.0, 1e4
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, dimensions) < sure else (low, middle)
    return high


def weights(size: int, dimensions: int = DIMENSIONS, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((size, dimensions))


class Splits:
    """A kd-tree's split planes: node k has children 2k + 1 and 2k + 2."""

    def __init__(self, points: np.ndarray, depth: int):
        self.depth, n = depth, 2**depth - 1
        self.axis, self.value = np.zeros(n, np.int64), np.full(n, np.inf)
        parts = {0: points}
        for k in range(n):
            part = parts.pop(k)
            if len(part):
                axis = int(np.ptp(part, axis=0).argmax())
                value = float(np.median(part[:, axis]))
                self.axis[k], self.value[k] = axis, value
            left = part[:, self.axis[k]] < self.value[k]
            if 2 * k + 2 < n:
                parts[2 * k + 1], parts[2 * k + 2] = part[left], part[~left]

    def cell(self, points: np.ndarray) -> np.ndarray:
        at = np.zeros(len(points), np.int64)
        for _ in range(self.depth):
            at = 2 * at + 1 + (points[np.arange(len(points)), self.axis[at]] >= self.value[at])
        return at - (2**self.depth - 1)


def box_gaps(query: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances of a point to boxes."""
    return (np.maximum(0, np.maximum(low - query, query - high)) ** 2).sum(-1)


class Leaves:
    """The points of a cell in kd-tree leaves with their boxes."""

    def __init__(self, projected: np.ndarray, vectors: np.ndarray, ids: list[np.ndarray]):
        depth = max(0, math.ceil(math.log2(max(1, len(projected)) / LEAF)))
        of = Splits(projected, depth).cell(projected) if depth else np.zeros(len(projected), np.int64)
        self.rows = [r for k in range(2**depth) if len(r := np.flatnonzero(of == k))]
        self.low = np.array([projected[r].min(0) for r in self.rows])
        self.high = np.array([projected[r].max(0) for r in self.rows])
        self.projected, self.vectors, self.ids = projected, vectors, ids
        self.counts = np.array([len(i) for i in ids])

    def search(self, place: np.ndarray, vector: np.ndarray, want: int, radius: float, ratio: float, own: int = NO_ID) -> tuple[np.ndarray, np.ndarray, float]:
        """Rows and distances of the nearest points that hold ``want`` ids besides
        ``own``, and the radius: the distance at which ids suffice, or the given one."""
        counts = self.counts if own == NO_ID else np.array([np.count_nonzero(i != own) for i in self.ids])
        gaps = box_gaps(place, self.low, self.high)
        rows, far = np.empty(0, np.int64), np.empty(0)
        nearest, at, many = np.argsort(gaps, kind="stable"), 0, 1
        while at < len(nearest) and gaps[nearest[at]] <= ratio * radius**2:
            met = np.concatenate([self.rows[k] for k in nearest[at : at + many] if gaps[k] <= ratio * radius**2])
            at, many = at + many, min(STEP_LEAVES, 2 * many)
            met = met[((self.projected[met] - place) ** 2).sum(1) <= ratio * radius**2]
            rows = np.concatenate([rows, met])
            far = np.concatenate([far, np.sqrt(((self.vectors[met] - vector) ** 2).sum(1))])
            order = np.argsort(far, kind="stable")
            held = np.cumsum(counts[rows[order]])
            enough = int(np.searchsorted(held, want))
            if enough < len(order):
                radius = min(radius, float(far[order[enough]]))
                keep = far <= far[order[enough]]
                rows, far = rows[keep], far[keep]
        return rows, far, radius


FOUND = "qa bigint, qb bigint, own bigint, score double, ids array<bigint>, radius double"


def _search(data, queries, want: int, ratio: float):
    import pandas as pd

    kinds = {"qa": "int64", "qb": "int64", "own": "int64", "score": "float64", "ids": object, "radius": "float64"}
    if not len(data) or not len(queries):
        return pd.DataFrame([], columns=list(kinds)).astype(kinds)
    unpack = lambda c: np.stack([np.frombuffer(x, "<f8") for x in c])
    leaves = Leaves(unpack(data.place), unpack(data.vector), [np.asarray(i) for i in data.ids])
    out = []
    for qa, qb, own, place, vector, radius in zip(queries.qa, queries.qb, queries.own, unpack(queries.place), unpack(queries.vector), queries.radius):
        rows, far, radius = leaves.search(place, vector, want, radius, ratio, own)
        out += [(qa, qb, own, float(d), leaves.ids[r][leaves.ids[r] != own].tolist(), radius) for r, d in zip(rows.tolist(), far)]
    return pd.DataFrame(out, columns=list(kinds)).astype(kinds)


def nearest(vectors: DataFrame, every: int = 100, neighbours: int = NEIGHBOURS, sure: float = SURE, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of the nearest rows found for each row whose
    id is divisible by ``every``.

    Vectors that are null, empty, zero, or hold a null or non-finite number
    take no part, nor do those of another length than most, or with a null id.
    Rows that repeat an id and its vector are one. Where an id has several
    vectors, each is a candidate, and that with the least hash is the query; no
    row of its id is among its neighbours. Fewer candidates than asked for give
    fewer rows; none give none. Other columns are not read."""
    spark, want = vectors.sparkSession, neighbours + 1
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.transform(F.col(vec_col).cast("array<double>"), lambda x: x + F.lit(0.0)).alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)).where(~bad).where(F.exists("v", lambda x: x != 0))
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if sizes is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    rows = rows.where(F.size("v") == sizes.n).select("id", "v", F.xxhash64("v").alias("a"), F.xxhash64(F.lit(SEED), "v").alias("b"))
    rows = work.cut(rows.groupBy("id", "a", "b").agg(F.first("v").alias("v"), F.count("*").alias("n")).drop("n"), "vectors")
    first = rows.withColumn("k", F.row_number().over(Window.partitionBy("a", "b").orderBy("id"))).where(F.col("k") <= want)
    points = first.groupBy("a", "b").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.first("v").alias("v"))
    matrix, ratio = weights(sizes.n), stop_ratio(sure)

    def project(batches):
        for batch in batches:
            flat = np.asarray(batch.column(3).flatten()).reshape(batch.num_rows, -1)
            vectors, places = np.ascontiguousarray(flat, "<f8"), np.ascontiguousarray(flat @ matrix, "<f8")
            packed = [pa.array([r.tobytes() for r in x], pa.binary()) for x in (vectors, places)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *packed], ["a", "b", "ids", "vector", "place"])

    points = work.cut(points.select("a", "b", "ids", "v").mapInArrow(project, "a bigint, b bigint, ids array<bigint>, vector binary, place binary"), "points")
    total = points.count()
    share = min(1.0, 2 * SAMPLE / total)
    sample = points.where(F.pmod("b", F.lit(1 << 30)) < int(share * (1 << 30))).select("place").limit(SAMPLE).collect()
    places = np.stack([np.frombuffer(r[0], "<f8") for r in sample]) if sample else np.empty((0, DIMENSIONS))
    splits = Splits(places, max(0, math.ceil(math.log2(min(CELLS, total / CELL)))))

    def to_cells(batches):
        for batch in batches:
            where = splits.cell(np.stack([np.frombuffer(x.as_py(), "<f8") for x in batch.column(4)])) if batch.num_rows else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(where, pa.int64())], [*batch.schema.names, "cell"])

    points = work.cut(points.mapInArrow(to_cells, "a bigint, b bigint, ids array<bigint>, vector binary, place binary, cell bigint"), "cells")

    def bounds(batches):
        for batch in batches:
            places, cells = np.stack([np.frombuffer(x.as_py(), "<f8") for x in batch.column(0)]) if batch.num_rows else np.empty((0, DIMENSIONS)), batch.column(1).to_numpy()
            of = np.unique(cells)
            low, high = ([getattr(places[cells == c], f)(0).tolist() for c in of] for f in ("min", "max"))
            yield pa.RecordBatch.from_arrays([pa.array(of), pa.array(low, pa.list_(pa.float64())), pa.array(high, pa.list_(pa.float64()))], ["cell", "low", "high"])

    ends = points.select("place", "cell").mapInArrow(bounds, "cell bigint, low array<double>, high array<double>")
    ends = ends.groupBy("cell").agg(*(F.min(F.col("low")[k]).alias(f"l{k}") for k in range(DIMENSIONS)), *(F.max(F.col("high")[k]).alias(f"h{k}") for k in range(DIMENSIONS))).collect()
    names, low, high = [r[0] for r in ends], np.array([r[1 : 1 + DIMENSIONS] for r in ends]), np.array([r[1 + DIMENSIONS :] for r in ends])

    asked = rows.where(F.col("id") % every == 0).groupBy(F.col("id").alias("query_id")).agg(F.min(F.struct(F.col("a").alias("qa"), F.col("b").alias("qb"))).alias("q"), F.count("*").alias("n"))
    # An id with several vectors is asked for by itself, as its rows are no neighbours of each other.
    asked = work.cut(asked.select("query_id", "q.qa", "q.qb", F.when(F.col("n") > 1, F.col("query_id")).otherwise(F.lit(NO_ID)).alias("own")), "asked")
    queries = asked.select("qa", "qb", "own").distinct().join(points, (F.col("qa") == F.col("a")) & (F.col("qb") == F.col("b")))
    queries = work.cut(queries.select("qa", "qb", "own", "vector", "place", "cell", F.lit(float("inf")).alias("radius")), "queries")
    held = points.groupBy(F.col("cell").alias("of")).agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    held = work.cut(held, "held")

    def visit(trips: DataFrame, name: str) -> DataFrame:
        """What ``trips`` (queries with a cell to search) find in their cells."""
        asks = trips.groupBy(F.col("cell").alias("to")).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
        sizes = work.cut(asks.join(held, F.col("to") == F.col("of")).select("to", "parts", "blocks"), name + "-sizes")
        upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        data = points.join(sizes, F.col("cell") == F.col("to")).withColumn("part", F.pmod("b", F.col("parts"))).withColumn("block", upto("blocks"))
        some = trips.join(sizes, F.col("cell") == F.col("to")).withColumn("block", F.pmod("qb", F.col("blocks"))).withColumn("part", upto("parts"))
        data = data.select("cell", F.col("part").cast("int").alias("part"), F.col("block").cast("int").alias("block"), "ids", "vector", "place")
        some = some.select("cell", F.col("part").cast("int").alias("part"), F.col("block").cast("int").alias("block"), "qa", "qb", "own", "vector", "place", "radius")
        keys = ["cell", "part", "block"]
        return some.groupBy(keys).cogroup(data.groupBy(keys)).applyInPandas(lambda q, d: _search(d, q, want, ratio), FOUND)

    own = work.cut(visit(queries, "own"), "own")

    radii = own.groupBy(F.col("qa").alias("ra"), F.col("qb").alias("rb"), F.col("own").alias("ro")).agg(F.min("radius").alias("near"))
    ready = queries.drop("radius").join(radii, (F.col("qa") == F.col("ra")) & (F.col("qb") == F.col("rb")) & (F.col("own") == F.col("ro"))).select("qa", "qb", "own", "vector", "place", "cell", F.col("near").alias("radius"))

    def visits(batches):
        for batch in batches:
            take, cells = [], []
            for k, (place, home, radius) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("place", "cell", "radius")))):
                for c in np.flatnonzero(box_gaps(np.frombuffer(place, "<f8"), low, high) <= ratio * radius**2):
                    if names[c] != home:
                        take.append(k)
                        cells.append(names[c])
                    if len(take) >= TAKEN:
                        yield trip(batch, take, cells)
                        take, cells = [], []
            yield trip(batch, take, cells)

    def trip(batch, take, cells):
        some = batch.take(pa.array(take, pa.int64()))
        return pa.RecordBatch.from_arrays([*(some.column(c) for c in ("qa", "qb", "own", "vector", "place", "radius")), pa.array(cells, pa.int64())], ["qa", "qb", "own", "vector", "place", "radius", "cell"])

    trips = ready.mapInArrow(visits, "qa bigint, qb bigint, own bigint, vector binary, place binary, radius double, cell bigint")
    other = visit(work.cut(trips, "trips"), "other")
    found = work.cut(own.union(other).select("qa", "qb", "own", "score", F.explode("ids").alias("vec_id")), "found")
    best = found.withColumn("k", F.row_number().over(Window.partitionBy("qa", "qb", "own").orderBy("score", "vec_id"))).where(F.col("k") <= want)
    best = work.cut(best.select(F.col("qa").alias("ba"), F.col("qb").alias("bb"), F.col("own").alias("bo"), "score", "vec_id"), "best")
    joined = asked.join(best, (F.col("qa") == F.col("ba")) & (F.col("qb") == F.col("bb")) & (F.col("own") == F.col("bo"))).where("vec_id <> query_id")
    ranked = joined.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))).where(F.col("rank") <= neighbours)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op8_srs(spark, sf_dir: str) -> DataFrame:
    return nearest(work.read(spark, sf_dir, "embeddings"))
