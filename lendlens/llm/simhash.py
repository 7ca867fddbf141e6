"""SimHash near-duplicates: exact comparison of fingerprint tiles that their bit counts admit."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lendlens.llm.common import byte_list, slices
from lendlens.llm.components import components
from lendlens.session import settle

BANDS = 4  # a fingerprint's cell: the bit counts of its 4 parts of 16 bits
TILE = 2048  # fingerprints in a tile
_CHUNK = 1 << 16  # shingles hashed at a time
_SEED = 42


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def fingerprint(text: bytes, width: int) -> int:
    """64 majority bits over the hashes of all word shingles, repeats included; 0 without words."""
    # bytes.lower and bytes.split know A-Z and the six ASCII white-space characters only
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - width + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = ends[min(width, len(words)) - 1 :]
    counts, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, n, _CHUNK):
        pairs = zip(starts[at : min(n, at + _CHUNK)].tolist(), last[at : at + _CHUNK].tolist())
        counts += _bit_counts(np.array([digest(joined[s:e], _SEED) for s, e in pairs], np.uint64))
    return int.from_bytes(np.packbits(counts * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """(key, fp): the fingerprint of every whole text as a signed long, without a shuffle."""
    rows = df.select(df[key].alias("_key"), df[text].alias("_text"))
    kind = dict(rows.dtypes)["_key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 512):
            fps = np.array([fingerprint(t, width) for t in byte_list(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], [key, "fp"])

    return rows.mapInArrow(run, f"`{key}` {kind}, fp long")


def _cell() -> Column:
    """The bit counts of the parts as digits of a number."""
    bits, cell = 64 // BANDS, F.lit(0)
    for b in range(BANDS):
        part = F.shiftrightunsigned("fp", b * bits).bitwiseAND(F.lit((1 << bits) - 1))
        cell = cell * 32 + F.bit_count(part)
    return cell.cast("int")


def _steps(radius: int) -> list[tuple[int, ...]]:
    """Differences of cells whose parts differ by ``radius`` bit counts in all, each pair of cells once."""
    near = [d for d in product(range(-radius, radius + 1), repeat=BANDS) if sum(map(abs, d)) <= radius]
    return [d for d in near if d >= (0,) * BANDS]


def _forest(a: np.ndarray, b: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links within ``radius`` bits between the tiles, without those that close a circle."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    out = []
    step = max(1, (1 << 20) // max(1, len(b)))
    for at in range(0, len(a), step):
        i, j = np.nonzero(np.bitwise_count(a[at : at + step, None] ^ b[None, :]) <= radius)
        for x, y in zip(a[at + i].tolist(), b[j].tolist()):
            if x != y and (p := find(x)) != (q := find(y)):
                parent[p] = q
                out.append((x, y))
    return out


def near_links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """(a, b) links between distinct fingerprints within ``radius`` bits, enough of them to connect
    all that are connected: a pair of tiles returns a spanning forest of its links.

    Fingerprints are grouped into cells by the bit counts of their parts, cells are cut into tiles of about
    ``TILE``, and a pair of tiles is compared only if its cells' bit counts differ by ``radius`` or less in
    all: no other pair can lie within the radius. Every admitted pair of tiles is compared exactly.
    There are at most 17^4 cells, so the table of cells has a fixed bound.
    """
    distinct = settle(fps.select("fp").distinct().withColumn("cell", _cell()))
    sizes = distinct.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(TILE)).cast("int").alias("parts"))
    # at most 83,521 rows of 8 bytes
    cut = distinct.join(F.broadcast(sizes), "cell").withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    tiles = settle(cut.groupBy("cell", "part").agg(F.collect_list("fp").alias("fps")))

    places = [32 ** (BANDS - 1 - b) for b in range(BANDS)]
    steps = [sum(x * p for x, p in zip(d, places)) for d in _steps(radius)]
    ids = tiles.select("cell", "part")
    other = ids.select(F.col("cell").alias("cell2"), F.col("part").alias("part2"))
    ahead = ids.withColumn("cell2", F.explode(F.array(*[F.col("cell") + F.lit(s) for s in steps])))
    pairs = ahead.join(other, "cell2").where("cell < cell2 OR (cell = cell2 AND part <= part2) OR cell > cell2")
    left = tiles.withColumnRenamed("fps", "a")
    right = tiles.select(F.col("cell").alias("cell2"), F.col("part").alias("part2"), F.col("fps").alias("b"))
    met = pairs.join(left, ["cell", "part"]).join(right, ["cell2", "part2"]).select("a", "b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flat(column: pa.ListArray, k: int) -> np.ndarray:
            return column[k].values.to_numpy(zero_copy_only=False).view(np.uint64)

        for batch in slices(batches, 256):
            found: list[tuple[int, int]] = []
            for k in range(batch.num_rows):
                found += _forest(flat(batch.column(0), k), flat(batch.column(1), k), radius)
            ends = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0].copy()), pa.array(ends[:, 1].copy())], ["a", "b"])

    return met.mapInArrow(compare, "a long, b long")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, radius: int = 2) -> DataFrame:
    """One row per row of ``df``: ``key``, ``fingerprint`` (16 hex digits) and ``component_id``, the
    smallest key reachable over links of ``radius`` differing bits or less.

    Equal fingerprints are collapsed before any comparison, so a group of copies counts once however large
    it is; links connect fingerprints, never documents. Null and empty texts have fingerprint zero and are linked
    like any other. A null key takes part with its text and gets the smallest key of its group, null only
    if all keys there are null. Repeated rows stay repeated, an empty table gives an empty result, and
    other columns are not read.
    """
    fps = settle(fingerprints(df, key, text, width))
    nodes = fps.groupBy("fp").agg(F.min(key).alias("_low"))
    roots = settle(components(near_links(fps, radius)))
    classes = nodes.join(roots, nodes["fp"] == roots["node"], "left").select(
        nodes["fp"], F.coalesce("root", nodes["fp"]).alias("_root"), "_low"
    )
    lows = classes.groupBy("_root").agg(F.min("_low").alias("component_id"))
    named = classes.join(lows, "_root").select(F.col("fp").alias("_fp"), "component_id")
    return fps.join(named, fps["fp"] == named["_fp"]).select(
        fps[key], F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def survivors(df: DataFrame, named: DataFrame) -> DataFrame:
    """One row of ``df`` for each ``root`` of ``named`` (doc_id, text_hash, root), which has a row for every row of ``df``.

    The row of a root with the smallest id stays, null ids last, then the one with the smallest text hash (xxhash64), whatever
    other roots hold rows under the same id. Of rows equal in both the smallest hash of all columns stays."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("_none"), "doc_id", "text_hash")).alias("_first")
    kept = named.groupBy("root").agg(first).select("_first.doc_id", F.col("_first.text_hash").alias("__text"))
    # keys without nulls, by which the join and the window share one shuffle of the texts
    id_key = {"__none": F.col("doc_id").isNull(), "__id": F.coalesce(F.col("doc_id").cast("string"), F.lit(""))}
    keys = [*id_key, "__text"]
    rows = df.withColumns({**id_key, "__text": F.xxhash64("text")})
    once = rows.join(kept.withColumns(id_key).select(*keys), keys, "left_semi")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.xxhash64(*df.columns)))
    return once.withColumn("__place", place).where("__place = 1").select(*df.columns)


def keep_one(df: DataFrame, width: int = 3, radius: int = 2) -> DataFrame:
    """One row of each group that links of ``radius`` bits connect, as ``survivors`` chooses it."""
    rows = df.select(F.struct("doc_id", F.xxhash64("text").alias("text_hash")).alias("_row"), "text")
    fps = settle(fingerprints(rows, "_row", "text", width))
    roots = components(near_links(fps, radius))
    named = fps.join(roots, fps["fp"] == roots["node"], "left")
    named = named.select("_row.doc_id", "_row.text_hash", F.coalesce("root", "fp").alias("root"))
    return survivors(df, named)
