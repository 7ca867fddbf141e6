"""Alignment of two tokenizers over the bytes they share, and what that says about pairs of their ids."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendlens.session import settle

BLOCK = 8 << 20  # bytes of text whose id pairs are looked up together
_BATCH = 1 << 20  # bytes of text aligned at a time
#: Fixed value: how a byte-level vocabulary of this kind cuts a text before its merges.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable bytes stand for themselves,
    the others, in order, for the code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = (b for b in range(256) if b not in set(plain))
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteLevel:
    """A tokenizers file with a byte-level vocabulary. Strings of special tokens inside a text are plain text."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        letters, vocab, self._path, self._whole = _byte_letters(), model["vocab"], path, None
        self.bytes_of = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            # a special token is an ordinary string here, so it is never met
            self.bytes_of[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        merged = [vocab["".join(m)] for m in merges]
        self._quick = None
        if merged == sorted(merged) and len(set(merged)) == len(merged) and all(vocab[c] < merged[0] for c in letters):
            import tiktoken

            ranks = {self.bytes_of[i]: i for i in [*(vocab[c] for c in letters), *merged]}
            self._quick = tiktoken.Encoding("byte_level", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def _library(self, text: str) -> list[int]:
        if self._whole is None:
            from tokenizers import Tokenizer

            self._whole = Tokenizer.from_file(self._path)
            self._whole.encode_special_tokens = True
        return self._whole.encode(text, add_special_tokens=False).ids

    def encode(self, texts: Sequence[str]) -> list[list[int]]:
        """Where ids follow the order of the merges, they are ranks, and a faster library gives the same ids."""
        if self._quick is None:
            return [self._library(t) for t in texts]
        return [self._quick.encode_ordinary(t) if len(t) < 1 << 18 else self._library(t) for t in texts]


class Pieces:
    """A sentencepiece model with byte pieces."""

    def __init__(self, path: str):
        import sentencepiece

        self._model = model = sentencepiece.SentencePieceProcessor(model_file=path)

        def own(i: int) -> bytes:
            piece = model.id_to_piece(i)
            return bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode()

        self.bytes_of = [own(i) for i in range(model.get_piece_size())]

    def encode(self, texts: Sequence[str]) -> list[list[int]]:
        return self._model.encode(list(texts), num_threads=1)


@lru_cache(maxsize=4)
def _loaded(kind: type, path: str):
    """Read once per Python worker, with the lengths of all tokens."""
    tokenizer = kind(path)
    return tokenizer, np.array([len(b) for b in tokenizer.bytes_of], np.int64)


def slices_of(ends_a: Sequence[int], ends_b: Sequence[int], first_a: int = 0, first_b: int = 0) -> tuple[list[int], list[int]]:
    """Where groups stop in both token lists: the places behind the tokens that end at a common byte, places
    counted from ``first_a`` and ``first_b``."""
    place_a, place_b = dict(zip(ends_a, count(first_a + 1))), dict(zip(ends_b, count(first_b + 1)))
    common = sorted(place_a.keys() & place_b.keys())
    return [place_a[e] for e in common], [place_b[e] for e in common]


def links_of(ends_a: np.ndarray, ends_b: np.ndarray, stops_a: np.ndarray, stops_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all token pairs with overlapping bytes, slice by slice.

    In a slice with a single token on one side that token meets all of the other side. Elsewhere the ends of both sides
    cut the slice into stretches, each of which lies in one token of either side and gives their link.
    """
    n_a, n_b = np.diff(stops_a, prepend=0), np.diff(stops_b, prepend=0)
    from_a, from_b = stops_a - n_a, stops_b - n_b
    easy = (n_a == 1) | (n_b == 1)
    size = np.where(easy, n_a * n_b, 0)
    step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    wide = np.repeat(n_a > 1, size)
    left, right = np.repeat(from_a, size) + np.where(wide, step, 0), np.repeat(from_b, size) + np.where(wide, 0, step)
    stretches = np.union1d(ends_a[np.repeat(~easy, n_a)], ends_b[np.repeat(~easy, n_b)])
    return np.concatenate([left, np.searchsorted(ends_a, stretches)]), np.concatenate([right, np.searchsorted(ends_b, stretches)])


def _merged(ids_a: np.ndarray, ids_b: np.ndarray, stops_a: np.ndarray, stops_b: np.ndarray) -> np.ndarray:
    """All tokens in the order of the groups, A before B: 4 * id, + 2 for B, + 1 where the part of a group ends."""
    out = np.empty(len(ids_a) + len(ids_b), np.int64)
    a, b = np.arange(len(ids_a)), np.arange(len(ids_b))
    group_a, group_b = np.searchsorted(stops_a, a, "right"), np.searchsorted(stops_b, b, "right")
    out[a + np.concatenate([[0], stops_b])[group_a]] = ids_a * 4 + (a + 1 == stops_a[group_a])
    out[b + stops_a[group_b]] = ids_b * 4 + 2 + (b + 1 == stops_b[group_b])
    return out


class Aligner:
    """Aligns lists of texts; ``spell`` has the text of a token of the merged order."""

    def __init__(self, first: tuple[type, str], second: tuple[type, str]):
        (self.a, self.len_a), (self.b, self.len_b) = _loaded(*first), _loaded(*second)
        n = max(len(self.len_a), len(self.len_b))
        self.spell = [f"{i}{end}" for i in range(n) for end in ",|,;"]

    def batch(self, texts: Sequence[str | None]) -> dict[str, np.ndarray | list[str]]:
        """Per text ``n_a``, ``n_b``, ``n_groups``, ``n_links`` and ``groups``, the digest of the groups; per distinct
        pair of ids linked in a text ``owner`` (place of the text), ``pair`` (A id times B ids plus B id) and ``times``."""
        spaced = [f" {t}" if t else "" for t in texts]
        known = [k for k, t in enumerate(spaced) if t]
        tokens_a = self.a.encode([spaced[k] for k in known])
        tokens_b = self.b.encode([texts[k] for k in known])
        kept, sizes, ids_a, ids_b = [], [], [], []
        for k, own_a, own_b in zip(known, tokens_a, tokens_b):
            data = spaced[k].encode()
            if b"".join(map(self.b.bytes_of.__getitem__, own_b)) == data == b"".join(map(self.a.bytes_of.__getitem__, own_a)):
                kept.append(k)
                sizes.append((len(own_a), len(own_b)))
                ids_a += own_a
                ids_b += own_b
        n = np.zeros((4, len(texts)), np.int64)
        digests = [""] * len(texts)
        if not kept:
            none = np.zeros(0, np.int64)
            return {"n": n, "groups": digests, "owner": none, "pair": none, "times": none}
        a, b = np.array(ids_a, np.int64), np.array(ids_b, np.int64)
        n_a, n_b = np.array(sizes, np.int64).T
        ends_a, ends_b = np.cumsum(self.len_a[a]), np.cumsum(self.len_b[b])
        lists, at_a, at_b, n_groups = ([], []), 0, 0, []
        for own_a, own_b in sizes:
            found = slices_of(ends_a[at_a : at_a + own_a].tolist(), ends_b[at_b : at_b + own_b].tolist(), at_a, at_b)
            for stops, own in zip(lists, found):
                stops += own
            n_groups.append(len(found[0]))
            at_a, at_b = at_a + own_a, at_b + own_b
        stops_a, stops_b = (np.array(stops, np.int64) for stops in lists)
        left, right = links_of(ends_a, ends_b, stops_a, stops_b)
        owner = np.searchsorted(np.cumsum(n_a), left, "right")
        n[:, kept] = [n_a, n_b, n_groups, np.bincount(owner, minlength=len(kept))]
        many = len(self.len_b)
        width = len(self.len_a) * many
        keys, times = np.unique(owner * width + a[left] * many + b[right], return_counts=True)
        merged, at = _merged(a, b, stops_a, stops_b), 0
        for k, size in zip(kept, (n_a + n_b).tolist()):
            own = "".join(map(self.spell.__getitem__, merged[at : at + size].tolist()))
            digests[k] = hashlib.sha256(own[:-1].encode()).hexdigest()
            at += size
        return {"n": n, "groups": digests, "owner": np.array(kept)[keys // width], "pair": keys % width, "times": times}


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in batches of about ``_BATCH`` bytes of text, a longer text alone."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy()
        start = 0
        while start < len(sizes):
            n = max(1, int(np.searchsorted(np.cumsum(sizes[start:]), _BATCH, "right")))
            yield batch.slice(start, n)
            start += n


def _aligned(rows: DataFrame, key: str, kind: str, first: tuple[type, str], second: tuple[type, str]) -> DataFrame:
    """One row per document and one per block of about ``BLOCK`` bytes, told apart by ``pairs``.

    A document names its linked pairs by their ``places`` in the pairs of its block, with their number of ``times``.
    """
    schema = f"`{key}` {kind}, block long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, places array<int>, times array<int>, pairs array<long>, totals array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(first, second)
        block, held, size, id_type = TaskContext.get().partitionId() << 32, [], 0, None

        def close() -> Iterator[pa.RecordBatch]:
            pairs, places = np.unique(np.concatenate([d["pair"] for _, d in held]), return_inverse=True)
            totals = np.bincount(places, np.concatenate([d["times"] for _, d in held]), len(pairs)).astype(np.int64)
            at = 0
            for ids, d in held:
                m = len(d["pair"])
                cuts = pa.array(np.searchsorted(d["owner"], np.arange(len(ids) + 1)).astype(np.int32))
                own, nulls = places[at : at + m].astype(np.int32), pa.nulls(len(ids), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(np.full(len(ids), block)), *map(pa.array, d["n"]), pa.array(d["groups"], pa.string()),
                     pa.ListArray.from_arrays(cuts, pa.array(own)), pa.ListArray.from_arrays(cuts, pa.array(d["times"].astype(np.int32))), nulls, nulls],
                    names,
                )
                at += m
            one = [pa.nulls(1, id_type), pa.array([block]), *[pa.array([0])] * 4, pa.array([""]), *[pa.array([[]], pa.list_(pa.int32()))] * 2]
            yield pa.RecordBatch.from_arrays([*one, pa.array([pairs], pa.list_(pa.int64())), pa.array([totals], pa.list_(pa.int64()))], names)

        names = [key, "block", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "places", "times", "pairs", "totals"]
        for batch in _batches(batches):
            id_type = batch.column(0).type
            held.append((batch.column(0), aligner.batch(batch.column(1).to_pylist())))
            size += batch.column(1).nbytes
            if size >= BLOCK:
                yield from close()
                block, held, size = block + 1, [], 0
        if held:
            yield from close()

    return rows.mapInArrow(run, schema)


def align(
    df: DataFrame, byte_level: str, pieces: str, key: str = "doc_id", text: str = "text",
    first: Callable[[str], object] = ByteLevel, second: Callable[[str], object] = Pieces,
) -> tuple[DataFrame, DataFrame]:
    """Aligns the tokens of two tokenizers over every whole text: (documents, pairs).

    ``documents`` has one row per row of ``df``: ``key``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``,
    ``count_sum`` and ``groups_sha256``. ``pairs`` has one row per pair of ids that is linked anywhere: ``a``, ``b``,
    ``links`` (how often) and ``best`` (no A id is linked with this B id more often). A encodes a space and the text,
    B the text, before which it puts a space itself. Byte offsets at which tokens of both end, found as the common keys
    of two dictionaries from ends to places, cut the tokens into groups; links join tokens whose bytes overlap.

    Every text is encoded once, where it is read. Its linked pairs are kept as places in the pairs of its block (about
    ``BLOCK`` bytes of text), so that blocks, not documents, meet the counts of the corpus: one row per block and
    pair is shuffled, and one block at a time meets its documents again in a task. What is broadcast has one row per B id.

    A text that is null, empty, or not given back by the bytes of either tokenizer has no tokens: zeros and an empty
    digest. A text longer than a block is a block of its own. Repeated rows are aligned alike and all of them
    count, null keys stay, an empty table gives empty results, and no other column is read.
    """
    rows = df.select(df[key].alias("__key"), df[text].alias("__text"))
    kind = dict(rows.dtypes)["__key"]
    done = settle(_aligned(rows, key, kind, (first, byte_level), (second, pieces)))
    many = len(second(pieces).bytes_of)
    met = done.where("pairs IS NOT NULL").select(F.col("block").alias("own"), F.posexplode(F.arrays_zip("pairs", "totals")).alias("place", "_"))
    met = met.select("own", "place", F.col("_.pairs").alias("pair"), F.col("_.totals").alias("n"))
    counts = settle(met.groupBy("pair").agg(F.sum("n").alias("links")))
    b = F.pmod("pair", F.lit(many)).alias("b")
    tops = counts.groupBy(b).agg(F.max("links").alias("top"))
    judged = counts.withColumn("b", b).join(F.broadcast(tops), "b")  # one row per id of the second vocabulary
    judged = judged.select("pair", "b", "links", (F.col("links") == F.col("top")).alias("best"))
    found = met.select("own", "place", "pair").join(judged, "pair").select("own", "place", "links", "best")
    docs = done.where("pairs IS NULL").drop("pairs", "totals")
    names = [key, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

    def look_up(own: pa.Table, table: pa.Table) -> pa.Table:
        places = table.column("place").to_numpy()
        links, best = np.zeros((2, len(places)), np.int64)
        links[places], best[places] = table.column("links").to_numpy(), table.column("best").to_numpy(zero_copy_only=False)
        lists, times = own.column("places").combine_chunks(), own.column("times").combine_chunks()
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())]).astype(np.int64)
        place, n = lists.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)

        def summed(value: np.ndarray) -> pa.Array:
            return pa.array(np.diff(np.concatenate([[0], np.cumsum(value[place] * n)])[ends]))

        return pa.table([*(own.column(c) for c in names[:5]), summed(best), summed(links), own.column("groups_sha256")], names)

    schema = f"`{key}` {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    documents = docs.groupBy("block").cogroup(found.groupBy("own")).applyInArrow(look_up, schema)
    pairs = judged.select(F.expr(f"pair div {many}").alias("a"), "b", "links", "best")
    return documents, pairs
