"""Exact top-k search over binary codes: multi-index hashing with growing segment radii."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lendlens.session import settle

BLOCK = 1 << 13  # distinct codes in one index
WORD = 64


def sign_code(vector: Column) -> Column:
    """The sign bits of a vector of any width, 64 to a number: bit i of word j is set where component 64 j + i is positive.
    Missing, null and non-finite components give 0; a vector without components has no words."""
    def bit(x: Column, i: Column) -> Column:
        return F.when((x > 0) & ~F.isnan(x) & (x < float("inf")), F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(0)

    def word(j: Column) -> Column:
        bits = F.transform(F.slice(vector, j * WORD + 1, F.lit(WORD)), bit)
        return F.aggregate(bits, F.lit(0).cast("long"), lambda code, one: code.bitwiseOR(one))

    words = F.ceil(F.size(vector) / WORD).cast("int")
    places = F.when(words > 0, F.sequence(F.lit(0), words - 1)).otherwise(F.array().cast("array<int>"))
    return F.when(vector.isNotNull(), F.transform(places, word))


class SegmentIndex:
    """Codes of one block (a row of words each), listed under the value of each of their segments. No segment spans words."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes = codes.reshape(len(codes), -1)
        self.bits = WORD * codes.shape[1]
        n = max(2, len(codes))
        cuts = np.linspace(0, WORD, max(1, round(WORD / max(4, min(16, n.bit_length() - 1)))) + 1).astype(int)
        self.segments = [(word, int(a), int(b - a)) for word in range(codes.shape[1]) for a, b in zip(cuts, cuts[1:])]
        self.parts = len(self.segments)
        self.lists = []
        for word, at, width in self.segments:
            value = self.value(codes[:, word], at, width)
            order = np.argsort(value, kind="stable")
            self.lists.append((order, np.concatenate([[0], np.cumsum(np.bincount(value, minlength=1 << width))])))
        self.masks: dict[tuple[int, int], np.ndarray] = {}

    @staticmethod
    def value(codes: np.ndarray, at: int, width: int) -> np.ndarray:
        return ((codes >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.int64)

    def flips(self, width: int, radius: int) -> np.ndarray:
        """All segment values with ``radius`` bits set."""
        if (width, radius) not in self.masks:
            sets = combinations([1 << b for b in range(width)], radius)
            self.masks[width, radius] = np.fromiter((sum(s) for s in sets), np.int64)
        return self.masks[width, radius]

    def listed(self, query: np.ndarray, part: int, radius: int) -> np.ndarray:
        """Positions of the codes whose segment differs from the query's by exactly ``radius`` bits."""
        word, at, width = self.segments[part]
        if radius > width:
            return np.empty(0, np.int64)
        order, starts = self.lists[part]
        values = int(self.value(query[word : word + 1], at, width)[0]) ^ self.flips(width, radius)
        low, size = starts[values], starts[values + 1] - starts[values]
        if not (total := int(size.sum())):
            return np.empty(0, np.int64)
        return order[np.repeat(low - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(total)]

    def nearest(self, query: np.ndarray, k: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions and distances of all codes within the distance of the k-th nearest row.

        ``rows`` says how many rows a code stands for. Radii grow segment by segment. Once segments
        0..j are searched to radius r and the others to r - 1, a code not yet seen differs in more than
        r bits in each of the first and r - 1 in each of the others, so every code within
        parts * r + j bits has been verified; the search ends when that covers the k-th distance.
        """
        query = np.atleast_1d(query)
        seen = np.zeros(len(self.codes), bool)
        found: list[np.ndarray] = []
        dists: list[np.ndarray] = []
        counts = np.zeros(self.bits + 1, np.int64)
        for radius in range(max((w for *_, w in self.segments), default=-1) + 1):
            for part in range(self.parts):
                new = self.listed(query, part, radius)
                new = new[~seen[new]]
                if len(new):
                    seen[new] = True
                    d = np.bitwise_count(self.codes[new] ^ query).sum(axis=1, dtype=np.int64)
                    found.append(new)
                    dists.append(d)
                    counts += np.bincount(d, weights=rows[new], minlength=self.bits + 1).astype(np.int64)
                covered = min(self.bits, self.parts * radius + part)
                if counts[: covered + 1].sum() >= k:
                    kth = int(np.searchsorted(np.cumsum(counts), k))
                    at, d = np.concatenate(found), np.concatenate(dists)
                    return at[d <= kth], d[d <= kth]
        at = np.concatenate(found) if found else np.empty(0, np.int64)
        return at, np.concatenate(dists) if dists else at


def words_of(column: pa.Array, words: int) -> np.ndarray:
    """A row of ``words`` numbers per code; words that a code has not are 0."""
    n = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), words), np.uint64)
    flat = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    row = np.repeat(np.arange(len(column)), n)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out


def _search(k: int, words: int):
    """Streams rows sorted by block, codes before queries: a block's codes become one index, its queries pass it batch by batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, index, held, ids, rows = None, None, [], [], None
        for batch in batches:
            key = batch.column("block").to_numpy() * 2 + batch.column("asks").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
            for start, stop in zip(cuts, cuts[1:]):
                part = batch.slice(start, stop - start)
                own, asks = divmod(int(key[start]), 2)
                if own != block:
                    block, index, held, ids = own, None, [], []
                code = words_of(part.column("code"), words)
                if not asks:
                    held.append(code)
                    ids += [np.array(x, np.int64) for x in part.column("ids").to_pylist()]
                    continue
                if not held:
                    continue
                if index is None:
                    index, rows = SegmentIndex(np.concatenate(held)), np.fromiter(map(len, ids), np.int64, len(ids))
                out: list[tuple[np.ndarray, ...]] = []
                for query_id, query in zip(part.column("query_id").to_numpy(zero_copy_only=False), code):
                    at, dist = index.nearest(query, k, rows)
                    mine, d = np.concatenate([ids[i] for i in at]), np.repeat(dist, rows[at])
                    best = np.lexsort((mine, d))[:k]
                    out.append((np.full(len(best), query_id, np.int64), mine[best], d[best]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["query_id", "id", "distance"])

    return run


def top_k(rows: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` nearest rows of each query: ``query_id``, ``rank`` (from 1), ``id``, ``distance``, nearest
    first, ties to the smaller id. Exact: nothing is approximated, and no bucket is cut.

    ``rows`` (id, code) and ``queries`` (query_id, code) hold codes of 64 bits, or arrays of any number of 64-bit words; words
    that a shorter code has not count as 0. Rows with equal codes are collapsed to the code and its k smallest ids, so a very common code
    costs no more than a rare one. Distinct codes are dealt by hash into blocks of about ``BLOCK``; every block is indexed once, in
    one task, and all queries stream past it, so a query is copied once per block and a code never. The k best of each
    block meet per query, reduced before the exchange. A query that is a row too finds itself.
    Rows and queries with a null id or code take no part; repeated rows count once per distinct
    id; fewer than k rows give fewer results, an empty table none. Other columns are not read.
    """
    rows, queries = (df.withColumn("code", F.array("code")) if dict(df.dtypes)["code"] == "bigint" else df for df in (rows, queries))
    rows, queries = (df.where(~F.exists("code", F.isnull)) for df in (rows, queries))
    known = rows.where("id IS NOT NULL").select("id", "code").distinct()
    first = F.row_number().over(Window.partitionBy("code").orderBy("id"))
    codes = settle(known.withColumn("__n", first).where(F.col("__n") <= k).groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    asked = settle(queries.where("query_id IS NOT NULL").select("query_id", "code").distinct())
    widest = F.coalesce(F.max(F.size("code")), F.lit(0))
    n, words = codes.agg(F.count(F.lit(1)), widest).first()
    words = max(words, asked.agg(widest).first()[0])
    blocks = max(1, -(-n // BLOCK))
    held = codes.select(F.pmod(F.xxhash64("code"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("asks"), F.lit(None).cast("long").alias("query_id"), "code", "ids")
    copies = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    asking = asked.select(copies.alias("block"), F.lit(1).alias("asks"), F.col("query_id").cast("long").alias("query_id"), "code", F.lit(None).cast("array<long>").alias("ids"))
    ordered = held.withColumn("ids", F.col("ids").cast("array<long>")).unionByName(asking).repartition(blocks, "block").sortWithinPartitions("block", "asks")
    found = ordered.mapInArrow(_search(k, words), "query_id long, id long, distance long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    best = found.withColumn("rank", rank).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "id", F.col("distance").cast("int").alias("distance"))
