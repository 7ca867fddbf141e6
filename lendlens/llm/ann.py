"""Approximate nearest neighbours: balanced posting lists under a centroid graph."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lendlens.llm.common import slices
from lendlens.session import settle

#: The centroids are fitted on at most so many vectors, those with the smallest hash of their id;
#: every vector is listed.
SAMPLE = 16_384
LIST = 128  # vectors meant for a list, before replicas
REPLICAS = 3  # lists that a vector near a boundary may stand in
EDGE = 1.12  # ... if their centroids are at most so much farther than the nearest
PRUNE = 1.14  # a query reads the lists whose centroids are at most so much farther than the nearest, or more:
#: as far as it takes to reach a share of ``TARGET`` of the true neighbours of ``PROBES`` queries
TARGET, PROBES = 0.95, 256
BEAM = 256  # centroids that a search keeps in view at first; twice as many until the limit is in view
LINKS, FAR_LINKS = 16, 4  # graph links of a centroid: to its nearest, and to any others
PART = 1024  # rows of a list, or queries of it, in one task


def usable(vector: Column) -> Column:
    """Not null, not zero, all components present and finite."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & F.coalesce(~odd, F.lit(False)) & F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum(0, (a**2).sum(1)[:, None] - 2 * (a @ b.T) + (b**2).sum(1)[None, :])


def balanced_centroids(points: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """K-means that charges a cluster for being larger than the mean, so that lists come out alike in size."""
    rng = np.random.default_rng(7)
    centroids = points[np.sort(rng.choice(len(points), k, replace=False))].copy()
    charge = np.zeros(k)
    for _ in range(rounds):
        own, spread = [], 0.0
        for at in range(0, len(points), 2048):
            d = _squares(points[at : at + 2048], centroids)
            own.append((d + charge).argmin(1))
            spread += d.min(1).sum()
        label = np.concatenate(own)
        n = np.bincount(label, minlength=k)
        sums = np.zeros_like(centroids)
        np.add.at(sums, label, points)
        centroids[n > 0] = sums[n > 0] / n[n > 0, None]
        charge += 0.02 * (n / n.mean() - 1) * spread / len(points)
    return centroids


@dataclass
class Index:
    """Centroids in a space where the largest inner product is the nearest point, and their graph."""

    centroids: np.ndarray
    graph: np.ndarray
    radius: float  # typical distance of a vector from its centroid
    norm: float  # largest norm of a vector

    @classmethod
    def fit(cls, sample: np.ndarray, norm: float, lists: int) -> Index:
        points = np.unique(cls.lifted(sample, norm), axis=0)
        k = max(1, min(lists, len(points) // 8 or 1))
        centroids = balanced_centroids(points, k)
        rng = np.random.default_rng(11)
        near = []
        for at in range(0, k, 1024):
            d = _squares(centroids[at : at + 1024], centroids)
            near.append(np.argsort(d, axis=1, kind="stable")[:, 1 : LINKS + 1])
        # the link to the next number keeps the graph connected
        graph = np.concatenate([np.concatenate(near), (np.arange(k)[:, None] + 1) % k, rng.integers(0, k, (k, FAR_LINKS))], axis=1)
        radius = float(np.mean([np.sqrt(_squares(points[at : at + 2048], centroids).min(1)).mean() for at in range(0, len(points), 2048)]))
        return cls(centroids, graph, radius, norm)

    @staticmethod
    def lifted(vectors: np.ndarray, norm: float) -> np.ndarray:
        """One more component brings every vector to the same norm."""
        rest = np.sqrt(np.maximum(0, norm**2 - (vectors**2).sum(1)))
        return np.concatenate([vectors, rest[:, None]], axis=1)

    def search(self, points: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroids found for each point (ascending) and their distances, -1 and inf where there
        are fewer. Best-first over the graph, for all points in step: each looks at the neighbours of the
        nearest centroids in its view that it hasn't looked at yet, until there are none."""
        n, k = len(points), len(self.centroids)
        beam, start = min(beam, k), np.unique(np.linspace(0, k - 1, min(k, 8)).astype(int))
        seen = np.zeros((n, k), bool)
        seen[:, start] = True
        view = np.tile(start, (n, 1))
        dist = np.sqrt(_squares(points, self.centroids[start]))
        opened = np.zeros(view.shape, bool)
        while True:
            order = np.argsort(np.where(opened, np.inf, dist), axis=1, kind="stable")[:, :4]
            rows = np.arange(n)[:, None]
            fresh = ~opened[rows, order] & np.isfinite(dist[rows, order])
            live = np.flatnonzero(fresh.any(axis=1))
            if not len(live):
                break
            opened[rows, order] = True
            found = np.where(fresh[live][:, :, None], self.graph[view[live[:, None], order[live]]], -1).reshape(len(live), -1)
            found = np.sort(found, axis=1)
            new = (found >= 0) & ~seen[live[:, None], found]
            new[:, 1:] &= found[:, 1:] != found[:, :-1]
            r, c = np.nonzero(new)
            seen[live[r], found[r, c]] = True
            d = np.full(found.shape, np.inf)
            d[r, c] = np.sqrt(((points[live[r]] - self.centroids[found[r, c]]) ** 2).sum(1))
            wide = np.full((n, found.shape[1]), np.inf)
            wide[live] = d
            names = np.full((n, found.shape[1]), -1)
            names[live] = np.where(new, found, -1)
            dist, view = np.concatenate([dist, wide], 1), np.concatenate([view, names], 1)
            opened = np.concatenate([opened, ~np.isfinite(wide)], 1)
            best = np.argsort(dist, axis=1, kind="stable")[:, :beam]
            dist, view, opened = dist[rows, best], view[rows, best], opened[rows, best]
        best = np.argsort(dist, axis=1, kind="stable")
        rows = np.arange(n)[:, None]
        return np.where(np.isfinite(dist[rows, best]), view[rows, best], -1), dist[rows, best]

    def homes(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) pairs: the nearest list of each vector, and further ones near a boundary."""
        lists, dist = self.search(self.lifted(vectors, self.norm), max(24, REPLICAS))
        near = dist[:, :REPLICAS] <= EDGE * dist[:, :1]
        near[:, 0] = True
        r, c = np.nonzero(near)
        return r, lists[r, c]

    def asked(self, queries: np.ndarray) -> np.ndarray:
        return self.lifted(queries * (self.norm / np.sqrt((queries**2).sum(1)))[:, None], self.norm)

    def readings(self, queries: np.ndarray, sizes: np.ndarray, enough: int, ratio: float = PRUNE) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) pairs that queries read: all within the distance ratio, and as many as hold ``enough`` rows."""
        points, todo, beam, found = self.asked(queries), np.arange(len(queries)), BEAM, []
        while len(todo):
            lists, dist = self.search(points[todo], beam)
            limit = ratio * np.maximum(dist[:, :1], self.radius)
            held = np.cumsum(np.where(lists >= 0, sizes[lists], 0), axis=1)
            before = np.concatenate([np.zeros((len(held), 1)), held[:, :-1]], axis=1)
            # a view whose farthest centroid is still to be read may hide others
            whole = (beam >= len(self.centroids)) | ((dist[:, -1] > limit[:, 0]) & (before[:, -1] >= enough))
            r, c = np.nonzero((lists >= 0) & ((dist <= limit) | (before < enough)) & whole[:, None])
            found.append((todo[r], lists[r, c]))
            todo, beam = todo[~whole], 2 * beam
        rows, lists = (np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64),) * 2
        return rows, lists


def reach(known: DataFrame, asked: DataFrame, homes: DataFrame, index: Index, k: int) -> float:
    """The distance ratio within which a share of ``TARGET`` of the true neighbours of a sample of queries stand.

    At most ``PROBES`` queries, those with the smallest hash of their id, are compared with every vector."""
    probes = asked.orderBy(F.xxhash64(F.lit("probe"), "query_id"), "query_id").limit(PROBES).toArrow()
    if not probes.num_rows:
        return PRUNE
    width = index.centroids.shape[1] - 1
    own, x = probes.column("query_id").to_numpy(), matrix(probes.column("vector").combine_chunks(), width)
    shared = known.sparkSession.sparkContext.broadcast((own, x))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, x = shared.value
        best = np.full((len(own), 2 * k), -np.inf)
        ids = np.zeros(best.shape, np.int64)
        rows = np.arange(len(own))[:, None]
        for batch in slices(batches, 4096):
            new = batch.column(0).to_numpy()
            scores = np.where(own[:, None] == new[None, :], -np.inf, x @ matrix(batch.column(1), width).T)
            scores, names = np.concatenate([best, scores], 1), np.concatenate([ids, np.broadcast_to(new, scores.shape)], 1)
            at = np.argpartition(-scores, 2 * k - 1, axis=1)[:, : 2 * k]
            best, ids = scores[rows, at], names[rows, at]
        r, c = np.nonzero(np.isfinite(best))
        columns = [pa.array(r.astype(np.int32)), pa.array(ids[r, c]), pa.array(best[r, c])]
        yield pa.RecordBatch.from_arrays(columns, ["probe", "vec_id", "score"])

    met = known.select("vec_id", "vector").mapInArrow(run, "probe int, vec_id long, score double")
    met = met.groupBy("probe", "vec_id").agg(F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("probe").orderBy(F.col("score").desc(), "vec_id"))
    true = met.withColumn("place", place).where(F.col("place") <= k).select("probe", "vec_id")
    # at most PROBES * k neighbours with the lists that hold them
    found = true.join(homes.select("vec_id", "list"), "vec_id").distinct().toPandas()
    if found.empty:
        return PRUNE
    dist = np.sqrt(_squares(index.asked(x), index.centroids))
    far = dist / np.maximum(dist.min(axis=1, keepdims=True), index.radius)
    found["ratio"] = far[found["probe"].to_numpy(), found["list"].to_numpy()]
    ratios = np.sort(found.groupby(["probe", "vec_id"])["ratio"].min().to_numpy())
    return max(PRUNE, float(ratios[int(np.ceil(TARGET * len(ratios))) - 1]) * (1 + 1e-9))


def _score(k: int):
    def score(vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[np.ndarray, ...]] = []
        if len(vectors) and len(queries):
            ids, bounds = vectors["vec_id"].to_numpy(), queries["bound"].to_numpy(np.float64)
            v, q = (np.stack(x["vector"].to_list()).astype(np.float64) for x in (vectors, queries))
            rough = q @ v.T
            for i, own in enumerate(queries["query_id"].to_numpy()):
                s = np.where(ids == own, -np.inf, rough[i])
                if len(s) > k:
                    kth = np.partition(s, len(s) - k)[len(s) - k]
                    at = np.flatnonzero(s >= kth - 1e-9 * (1 + abs(kth)) if np.isfinite(kth) else np.isfinite(s))
                else:
                    at = np.flatnonzero(np.isfinite(s))
                # products summed in one order for every row, so that equal vectors score equally
                exact = (v[at] * q[i]).sum(axis=1)
                at, exact = at[exact >= bounds[i]], exact[exact >= bounds[i]]
                best = np.lexsort((ids[at], -exact))[:k]
                out.append((np.full(len(best), own), ids[at][best], exact[best]))
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), columns)))

    return score


RESULT = "query_id long, rank int, vec_id long, score double"


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` nearest found of each query by largest inner product: ``query_id``, ``rank`` (from 1), ``vec_id``,
    ``score``, nearest first, ties to the smaller id. Approximate in the lists read, exact in the scores.

    ``vectors`` (vec_id, vector) and ``queries`` (query_id, vector); a row with the query's own id is no
    candidate. Null, zero and non-finite vectors, null ids, and vectors of another length than the most common one take
    no part. Centroids come from a bounded sample; every vector is listed with its nearest centroid and, near a boundary,
    with up to ``REPLICAS``. A list of any size is read whole: lists and the queries that read them are dealt into parts
    of about ``PART`` rows, so a very common vector spreads over tasks. Lists are read in two rounds: the nearest ones, as many as the
    square root of those in reach, give each query its k-th score so far, and of the other lists only rows that reach it leave
    their task. If the lists in reach hold too few rows, a query reads on in the order of distance. How far queries read is measured on a sample of them against all vectors (``reach``). Ids that repeat count once, with their best score. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    known = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("vector"))).select(F.col("vec_id").cast("long").alias("vec_id"), "vector")
    squared = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    shapes = known.select(F.size("vector").alias("width"), squared.alias("s")).groupBy("width")
    shape = shapes.agg(F.count(F.lit(1)).alias("n"), F.max("s").alias("s")).orderBy(F.col("n").desc(), "width").first()
    if shape is None:
        return spark.createDataFrame([], RESULT)
    width, norm = shape["width"], float(np.sqrt(shape["s"]))
    fitting = F.size("vector") == width
    known = known.where(fitting)
    asked = queries.where(F.col("query_id").isNotNull() & usable(F.col("vector")) & fitting)
    asked = asked.select(F.col("query_id").cast("long").alias("query_id"), "vector")

    first = known.orderBy(F.xxhash64(F.lit("ann"), "vec_id"), "vec_id").limit(SAMPLE).select("vector").toArrow()
    sample = matrix(first.column("vector").combine_chunks(), width)
    index = Index.fit(sample, norm, -(-shape["n"] // LIST))
    # at most SAMPLE / 8 centroids: a fixed bound on what every task is sent
    shared = spark.sparkContext.broadcast(index)
    kind = dict(known.dtypes)["vector"]

    homes = settle(known.mapInArrow(_placed(shared, "vec_id", width, lambda ix, x: ix.homes(x)), f"list int, vec_id long, vector {kind}, early boolean"))
    sizes = _per_list(homes, len(index.centroids))
    enough = REPLICAS * (k + 1)
    ratio = reach(known, asked, homes, index, k)
    schema = f"list int, query_id long, vector {dict(asked.dtypes)['vector']}, early boolean"
    readings = settle(asked.mapInArrow(_placed(shared, "query_id", width, lambda ix, x: ix.readings(x, sizes, enough, ratio)), schema))

    first = settle(_best(_read(homes, readings.where("early").withColumn("bound", F.lit(float("-inf"))), sizes, k), k))
    # the k-th score found so far: what lies below can't be among the k best
    bounds = first.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("bound"))
    late = readings.where("NOT early").join(bounds, "query_id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("-inf"))))
    second = _read(homes, late, sizes, k)
    return _best(first.select("query_id", "vec_id", "score").unionByName(second), k).select("query_id", "rank", "vec_id", "score")


def _placed(shared, name: str, width: int, choose):
    """One row for every list that ``choose`` gives a vector; ``early`` are the nearest lists of a row, as many as the square
    root of all its lists."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 512):
            r, lists = choose(shared.value, matrix(batch.column("vector"), width))
            order = np.argsort(r, kind="stable")  # lists of a row stay nearest first
            r, lists = r[order], lists[order]
            n = np.bincount(r, minlength=batch.num_rows)
            place = np.arange(len(r)) - np.repeat(np.cumsum(n) - n, n)
            rows = batch.take(pa.array(r))
            early = pa.array(place < np.ceil(np.sqrt(n))[r])
            yield pa.RecordBatch.from_arrays([pa.array(lists.astype(np.int32)), rows.column(name), rows.column("vector"), early], ["list", name, "vector", "early"])

    return run


def _per_list(rows: DataFrame, lists: int) -> np.ndarray:
    sizes = np.zeros(lists, np.int64)
    for row in rows.groupBy("list").count().collect():  # at most one row per centroid
        sizes[row["list"]] = row["count"]
    return sizes


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query with their rank, every vector once."""
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k)


def _read(homes: DataFrame, readings: DataFrame, sizes: np.ndarray, k: int) -> DataFrame:
    """(query_id, vec_id, score): of every list and query that reads it the k best rows that reach the query's ``bound``."""
    readers = _per_list(readings, len(sizes))

    def parts(n: np.ndarray) -> np.ndarray:
        return np.maximum(1, -(-n // PART))

    counts = [(i, int(a), int(b)) for i, (a, b, n) in enumerate(zip(parts(sizes), parts(readers), readers)) if n]

    def dealt(df: DataFrame, own: str, count: str, name: str, other: str, others: str) -> DataFrame:
        cuts = df.sparkSession.createDataFrame(counts, "list int, parts int, askers int")
        cut = df.join(F.broadcast(cuts), "list")  # one row per centroid
        cut = cut.withColumn(own, F.pmod(F.xxhash64(F.lit(own), name), F.col(count)).cast("int"))
        return cut.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(others) - 1)))

    held = dealt(homes.drop("early"), "part", "parts", "vec_id", "asker", "askers").groupBy("list", "part", "asker")
    reading = dealt(readings.drop("early"), "asker", "askers", "query_id", "part", "parts").groupBy("list", "part", "asker")
    return held.cogroup(reading).applyInPandas(_score(k), "query_id long, vec_id long, score double")
