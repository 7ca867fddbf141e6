"""Suffix-array dedup: anchored suffixes, sorted deep and shallow, give every repeated string.

A string of ``length`` bytes holds an anchor in its first half: the position with the smallest hash of its next
eight bytes among the string's first ``length - key + 1`` positions. Equal strings hold it at the same
offset. So every repeat is seen between two anchors that agree in the ``key`` bytes to their right.
Only anchors whose ``key`` bytes occur again are sorted: their suffixes behind these bytes (and, read
backwards, their prefixes) are put in order by a multikey quicksort to a shallow depth; the groups that still agree
are ordered by blind tries. The common prefixes of neighbours in both orders say which strings around an
anchor occur elsewhere.

Repeated passages of a number of words are found the same way, on texts whose words are codes of eight bytes.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendlens.llm.common import byte_list, same, slices
from lendlens.session import settle

LENGTH = 400
CODE = 8  # bytes that stand for a word
SHALLOW = 24  # bytes that the multikey sort looks at before the tries take over: the mark of the group and 16 of the text
GROUP = 1 << 15  # contexts (of at most 600 bytes) that are sorted together; larger groups are parted by further bytes
_BATCH = 20_000  # contexts sorted at a time
_CHUNK = 1 << 18  # bytes whose anchors are found at a time
#: Odd multipliers of the anchor hash.
_FACTORS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))


# --- words -----------------------------------------------------------------------------------------


def word_codes(text: bytes) -> bytes:
    """The hashes of the words (runs of bytes that are not ASCII blanks) of a text, one after another."""
    return np.array([xxhash.xxh3_64_intdigest(w) for w in text.split()], np.uint64).tobytes()


def _word_bounds(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a text start and stop."""
    data = np.frombuffer(text, np.uint8)
    inside = ((data != 0x20) & ((data < 0x09) | (data > 0x0D))).astype(np.int8)
    edges = np.flatnonzero(np.diff(inside, prepend=0, append=0))
    return edges[::2], edges[1::2]


# --- anchors ---------------------------------------------------------------------------------------


def _anchor_keys(data: bytes) -> np.ndarray:
    """For every position a hash of its eight bytes, with the position below as tie-break."""
    n = len(data)
    padded = np.frombuffer(data + b"\0" * 16, np.uint8)
    words = np.empty(n + 8, np.uint64)
    for r in range(8):
        part = padded[r : r + 8 * ((n + 15 - r) // 8)].view(np.uint64)
        words[r::8] = part[: len(words[r::8])]
    h = words[:n] * _FACTORS[0]
    h ^= h >> np.uint64(32)
    h *= _FACTORS[1]
    return (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)


def _window_minima(keys: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` neighbours, by doubling."""
    size, minima = 1, keys
    while size * 2 <= width:
        minima = np.minimum(minima[:-size], minima[size:])
        size *= 2
    count = len(keys) - width + 1
    return np.minimum(minima[:count], minima[width - size : width - size + count])


def anchors(text: bytes, length: int) -> np.ndarray:
    """Anchor positions of one text, ascending."""
    return _anchors_of([text], length)[0]


def _anchors_of(texts: Sequence[bytes], length: int) -> list[np.ndarray]:
    """Anchors of many texts; short texts share a chunk, a long text is cut into overlapping ones."""
    width = length - length // 2 + 1
    found: list[list[np.ndarray]] = [[] for _ in texts]
    chunk: list[tuple[int, int, bytes]] = []
    size = 0

    def flush() -> None:
        data = b"".join(part for _, _, part in chunk)
        if not data:
            return
        minima = _window_minima(_anchor_keys(data), width)
        start = 0
        for number, offset, part in chunk:
            own = minima[start : start + len(part) - length + 1] & np.uint64(0xFFFFFFFF)
            changed = np.concatenate([[True], own[1:] != own[:-1]])
            found[number].append(np.unique(own[changed].astype(np.int64)) - start + offset)
            start += len(part)

    for number, text in enumerate(texts):
        for offset in range(0, len(text) - length + 1, _CHUNK):
            part = text[offset : offset + _CHUNK + length - 1]
            chunk.append((number, offset, part))
            size += len(part)
            if size >= _CHUNK:
                flush()
                chunk, size = [], 0
    flush()
    return [np.unique(np.concatenate(f)) if f else np.empty(0, np.int64) for f in found]


def _context(text: bytes, at: int, length: int) -> tuple[bytes, bytes]:
    """The bytes left and right of an anchor that any string through it can reach."""
    reach = length - length // 2
    return text[max(0, at - reach) : at], text[at : at + length]


# --- deep-shallow sorting --------------------------------------------------------------------------


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return n - ((int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")).bit_length() + 7) // 8


class BlindTrie:
    """Orders strings by the bytes at which they branch. An insertion goes down blindly, compares the string
    with the one leaf it reaches, and branches off where they part."""

    def __init__(self, strings: Sequence[bytes]):
        self.strings = strings
        #: an inner node is [depth, {byte: child}], a leaf the list of equal strings
        self.root: list | None = None

    def insert(self, number: int) -> None:
        s = self.strings[number]
        if self.root is None:
            self.root = [-1, [number]]
            return
        node = self.root
        while node[0] >= 0:
            depth, children = node
            byte = s[depth] if depth < len(s) else -1
            node = children.get(byte) or next(iter(children.values()))
        other = self.strings[node[1][0]]
        if s == other:
            node[1].append(number)
            return
        common = _common(s, other)
        parent, byte, node = None, None, self.root
        while 0 <= node[0] < common:
            parent, byte = node, s[node[0]] if node[0] < len(s) else -1
            node = parent[1][byte]
        if node[0] == common:
            node[1][s[common] if common < len(s) else -1] = [-1, [number]]
        else:
            old = other[common] if common < len(other) else -1
            new = [common, {old: node, s[common] if common < len(s) else -1: [-1, [number]]}]
            if parent is None:
                self.root = new
            else:
                parent[1][byte] = new

    def ordered(self) -> tuple[list[int], list[int]]:
        """The strings in order and what each has in common with the one before (the first: 0)."""
        order: list[int] = []
        common: list[int] = []
        stack: list[tuple[list, int]] = [(self.root, 0)] if self.root else []
        while stack:
            node, before = stack.pop()
            if node[0] < 0:
                same_text = len(self.strings[node[1][0]])
                common += [before] + [same_text] * (len(node[1]) - 1)
                order += node[1]
            else:
                children = sorted(node[1].items())
                stack += [(child, node[0] if i else before) for i, (_, child) in reversed(list(enumerate(children)))]
        return order, common


def _multikey(fixed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, group): rows of letters in order; rows that agree in all letters have one group number.

    Multikey quicksort of all groups side by side: each group that is not settled takes the letter of its middle row as pivot and
    falls into three parts, smaller, equal and larger; the equal part goes on with the next letter.
    """
    n, letters = fixed.shape
    order, group, depth = np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
    while True:
        size = np.bincount(group)[group]
        at = np.flatnonzero((size > 1) & (depth < letters))
        if not len(at):
            return order, group
        own, mine = order[at], group[at]
        letter = fixed[own, depth[at]]
        first = np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1]]))
        rank = np.cumsum(np.concatenate([[0], mine[1:] != mine[:-1]]))
        middle = first + np.diff(np.append(first, len(at))) // 2
        pivot = letter[middle][rank]
        part = (letter > pivot).astype(np.int8) - (letter < pivot)
        by = np.lexsort((part, rank))
        order[at], depth[at] = own[by], (depth[at] + (part == 0))[by]
        fresh = np.zeros(n, np.int64)
        fresh[at] = part[by]
        group = np.cumsum(np.concatenate([[0], (group[1:] != group[:-1]) | ((group[1:] == group[:-1]) & (fresh[1:] != fresh[:-1]))]))


def deep_shallow_sort(strings: Sequence[bytes], shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """The order of ``strings`` and the length of the prefix that each has in common with the one before it.

    Shallow: a multikey quicksort, eight bytes to a letter, splits the strings to the depth ``shallow``. Deep: a blind trie orders
    each group that is left.
    """
    n = len(strings)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    fixed = np.frombuffer(b"".join([s[:shallow].ljust(shallow, b"\0") for s in strings]), ">u8").reshape(n, shallow // 8).astype(np.uint64)
    order, group = _multikey(fixed)
    common = np.zeros(n, np.int64)
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    for start, stop in zip(starts.tolist(), [*starts[1:].tolist(), n]):
        if stop - start > 1:
            trie = BlindTrie(strings)
            for number in order[start:stop].tolist():
                trie.insert(number)
            order[start:stop], common[start:stop] = trie.ordered()
    for at in starts[1:].tolist():
        common[at] = _common(strings[order[at - 1]], strings[order[at]])
    return order, common


def repeated_offsets(
    groups: np.ndarray, lefts: Sequence[bytes], rights: Sequence[bytes], counts: np.ndarray, length: int,
    lows: np.ndarray | None = None, highs: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray]:
    """For distinct contexts around anchors of the given ``groups`` (equal key bytes), the least and the largest
    distance before the anchor at which a string of ``length`` bytes begins that occurs elsewhere (least > largest:
    none does). ``counts`` says how often a context occurs; only distances from ``lows`` to ``highs`` are looked at.

    A string that begins o bytes before the anchor agrees with that of another context if they share ``length - o``
    bytes to the right and o bytes to the left. Neighbours in the sorted orders tell classes of such contexts. The key bytes,
    which a group shares, are compared once and left out of the strings that are sorted.
    """
    n, reach, key_size = len(lefts), length - length // 2, length // 2
    least, largest = np.full(n, reach + 1), np.full(n, -1)
    if not n:
        return least, largest
    known: dict[tuple[int, bytes], int] = {}
    group = np.array([known.setdefault((g, r[:key_size]), len(known)) for g, r in zip(groups.tolist(), rights)], np.int64)
    marks = [int(g).to_bytes(8, "big") for g in group]
    orders = []
    for strings, shared in (([m + r[key_size:] for m, r in zip(marks, rights)], key_size), ([m + s[::-1] for m, s in zip(marks, lefts)], 0)):
        order, common = deep_shallow_sort(strings)
        common = np.where(np.concatenate([[False], group[order[1:]] == group[order[:-1]]]), common - 8 + shared, -1)
        orders.append((order, common))
    right_size = np.fromiter(map(len, rights), np.int64, n)
    left_size = np.fromiter(map(len, lefts), np.int64, n)

    def classes(order: np.ndarray, common: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        new = common < depth
        label, shared = np.empty(n, np.int64), np.empty(n, bool)
        label[order] = np.cumsum(new)
        shared[order] = ~new | np.append(~new[1:], False)
        return label, shared

    for o in range(reach + 1):
        right_label, a = classes(*orders[0], length - o)
        left_label, b = classes(*orders[1], o)
        hit = (counts > 1) & (left_size >= o) & (right_size >= length - o)
        both = np.flatnonzero(a & b)
        if len(both):
            _, at, times = np.unique(right_label[both] * (n + 1) + left_label[both], return_inverse=True, return_counts=True)
            hit[both[times[at] > 1]] = True
        if lows is not None and highs is not None:
            hit &= (lows <= o) & (o <= highs)
        least[hit] = np.minimum(least[hit], o)
        largest[hit] = o
    return least, largest


# --- the operator ----------------------------------------------------------------------------------

_KEY = ("doc_id", "__th")


def _texts(column: pa.Array, coded: bool) -> list[bytes]:
    """The texts of a column of texts or of rows that hold one, as they are or as the codes of their words."""
    texts = byte_list(column.field("text") if pa.types.is_struct(column.type) else column)
    return list(map(word_codes, texts)) if coded else texts


def _find_anchors(docs: DataFrame, length: int, coded: bool) -> DataFrame:
    """A row for every anchor: its place, the hash of its key bytes and that of its whole context."""
    kind = dict(docs.dtypes)["doc_id"]
    key_size = length // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in slices(batches, 256):
            texts = _texts(batch.column("text"), coded)
            found = _anchors_of(texts, length)
            keys, contexts = [], []
            for text, own in zip(texts, found):
                for at in own.tolist():
                    left, right = _context(text, at, length)
                    keys.append(digest(right[:key_size]))
                    contexts.append(digest(left + right, len(left)))
            row = np.repeat(np.arange(len(texts)), list(map(len, found)))
            sizes = np.array(list(map(len, texts)), np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(row)), batch.column("__th").take(pa.array(row)),
                    pa.array(np.concatenate(found)), pa.array(sizes[row]),
                    pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(np.array(contexts, np.uint64).view(np.int64)),
                ],
                ["doc_id", "__th", "pos", "n", "key", "ctx"],
            )

    return docs.mapInArrow(run, f"doc_id {kind}, __th long, pos long, n long, key long, ctx long")


def _fetch_contexts(docs: DataFrame, wanted: DataFrame, length: int, coded: bool) -> DataFrame:
    """(key, ctx, c, left, right) for one occurrence of every wanted context."""
    lists = wanted.groupBy("doc_id", "__th").agg(F.collect_list(F.struct("pos", "key", "ctx", "c")).alias("places"))
    met = docs.join(lists, same(docs, lists, *_KEY)).select(docs[docs.columns[-1]], lists["places"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            rows = []
            for text, places in zip(_texts(batch.column(0), coded), batch.column("places").to_pylist()):
                for p in places:
                    left, right = _context(text, p["pos"], length)
                    rows.append((p["key"], p["ctx"], p["c"], left, right))
            columns = list(zip(*rows)) if rows else [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], ["key", "ctx", "c", "left", "right"])

    return met.mapInArrow(run, "key long, ctx long, c long, left binary, right binary")


_OFFSETS = "root long, ctx long, least int, largest int"


def _sort_contexts(contexts: DataFrame, length: int) -> DataFrame:
    """The repeated offsets of contexts (root, key, ctx, c, left, right, low, high) whose groups fit a batch: each group
    lies whole in one partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solved(parts: list[pa.Table]) -> pa.RecordBatch:
            whole = pa.concat_tables(parts)
            key = whole.column("key").to_numpy()
            ctx = whole.column("ctx").to_numpy()
            # copies of one document row fetch a context more than once
            once = np.unique(np.stack([key, ctx]), axis=1, return_index=True)[1]
            left, right = whole.column("left").to_pylist(), whole.column("right").to_pylist()
            c, low, high = (whole.column(x).to_numpy()[once] for x in ("c", "low", "high"))
            least, largest = repeated_offsets(key[once], [left[i] for i in once], [right[i] for i in once], c, length, low, high)
            hit = least <= largest
            return pa.RecordBatch.from_arrays(
                [pa.array(whole.column("root").to_numpy()[once][hit]), pa.array(ctx[once][hit]), pa.array(least[hit].astype(np.int32)), pa.array(largest[hit].astype(np.int32))],
                ["root", "ctx", "least", "largest"],
            )

        waiting: list[pa.Table] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            waiting.append(pa.Table.from_batches([batch]))
            rows += batch.num_rows
            if rows >= _BATCH:
                whole = pa.concat_tables(waiting)
                keys = whole.column("key").to_numpy()
                cut = int(np.searchsorted(keys, keys[-1]))  # the last group may go on in the next batch
                if cut:
                    yield solved([whole.slice(0, cut)])
                waiting, rows = [whole.slice(cut)], whole.num_rows - cut
        if waiting:
            yield solved(waiting)

    return contexts.repartition("key").sortWithinPartitions("key").mapInArrow(run, _OFFSETS)


def _parted(contexts: DataFrame, length: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Contexts of large groups in groups of at most ``GROUP``, those that are left with one distance to look at, and
    repeated offsets found on the way.

    Two contexts repeat a string at a distance of low to high before the anchor only if they agree in ``length - high`` bytes to the
    right and ``low`` bytes to the left. So a large group is looked at in two halves of its distances, each parted by the
    further bytes that its contexts must share, and so on while a part is large. Contexts of a part that agree in all bytes which its
    distances reach repeat at all of them; one of them goes on for the others. So a round at most doubles what has no
    equal, and after eight rounds every distance stands alone.
    """
    reach = length - length // 2
    todo = contexts.select(F.col("key").alias("root"), "key", "ctx", "c", "left", "right", F.lit(0).alias("low"), F.lit(reach).alias("high"))
    todo = todo.dropDuplicates(["root", "ctx"])
    small: list[DataFrame] = []
    found: list[DataFrame] = []
    for _ in range(reach.bit_length() + 1):
        todo = settle(todo)
        large = settle(todo.where("low < high").groupBy("key").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > GROUP).select("key"))
        small.append(todo.join(large, "key", "left_anti"))
        if large.isEmpty():
            break
        middle = F.expr("(low + high) div 2").cast("int")
        halves = F.array(F.struct(F.col("low").alias("a"), middle.alias("b")), F.struct((middle + 1).alias("a"), F.col("high").alias("b")))
        parts = todo.join(large, "key", "left_semi").withColumn("half", F.explode(halves)).select("root", "key", "ctx", "c", "left", "right", "half.*")
        least, largest = F.greatest(F.col("a"), F.lit(length) - F.octet_length("right")), F.least(F.col("b"), F.octet_length("left"))
        further = F.xxhash64("key", "a", F.expr(f"substring(right, 1, {length} - b)"), F.expr("substring(left, octet_length(left) - a + 1, a)"))
        near = F.struct(
            F.expr("substring(left, greatest(octet_length(left) - b, 0) + 1, b)").alias("l"), F.expr(f"substring(right, 1, {length} - a)").alias("r")
        )
        parts = settle(parts.where(least <= largest).select(
            "root", further.alias("key"), "ctx", "c", "left", "right", F.col("a").alias("low"), F.col("b").alias("high"),
            least.cast("int").alias("least"), largest.cast("int").alias("largest"), near.alias("near"),
        ))
        classes = parts.groupBy("root", "key", "low", "near").agg(F.sum("c").alias("all"), F.min("ctx").alias("first"))
        met = settle(parts.join(classes, ["root", "key", "low", "near"]))
        found.append(met.where(F.col("all") > 1).select("root", "ctx", "least", "largest"))
        todo = met.where("ctx = first").select("root", "key", "ctx", F.col("all").alias("c"), "left", "right", "low", "high")
    every = reduce(DataFrame.unionByName, small)
    early = reduce(DataFrame.unionByName, found) if found else every.select("root", "ctx", F.col("low").alias("least"), F.col("high").alias("largest")).limit(0)
    return every.where("low < high"), every.where("low = high"), early


def _equal_windows(contexts: DataFrame, length: int) -> DataFrame:
    """The repeated offsets of contexts with one distance to look at: those whose string occurs more than once."""
    window = F.concat(F.expr("substring(left, octet_length(left) - low + 1, low)"), F.expr(f"substring(right, 1, {length} - low)"))
    once = contexts.dropDuplicates(["root", "ctx", "low"]).withColumn("window", window).where(F.octet_length("window") == length)
    again = once.groupBy("root", "low", "window").agg(F.sum("c").alias("times")).where("times > 1").drop("times")
    hits = once.join(again, ["root", "low", "window"], "left_semi")
    return hits.select("root", "ctx", F.col("low").alias("least"), F.col("low").alias("largest"))


def _merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for start, stop in sorted((s["start"], s["stop"]) for s in spans or []):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([start, stop])
    return [(a, b) for a, b in out]


def _span_rows(docs: DataFrame, rows: DataFrame, length: int, coded: bool = False) -> DataFrame:
    """(doc_id, __th, s): byte ranges that repeated strings cover, overlapping, of the texts or of their words' codes.

    ``docs`` holds doc_id, text and ``__th``, a hash of the text; ``rows`` ends with the text or a struct that holds it, so that
    a caller who meets whole rows with the spans deals out texts once for both.
    """
    reach, key_size = length - length // 2, length // 2
    found = settle(_find_anchors(docs, length, coded))
    keys = found.groupBy("key").agg(F.count(F.lit(1)).alias("times"), F.min("ctx").alias("lo"), F.max("ctx").alias("hi"))
    # written, so that both sides of the join are plain exchanges and a hot key is split at run time
    again = settle(keys.where("times > 1").select("key", (F.col("lo") != F.col("hi")).alias("several")))
    seen = settle(found.join(again, "key"))

    place = F.struct("doc_id", "__th", "pos")
    contexts = settle(
        seen.where("several").groupBy("key", "ctx").agg(F.count(F.lit(1)).alias("c"), F.min(place).alias("at"))
        .select("key", "ctx", "c", "at.*")
    )
    large = settle(contexts.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > GROUP).select("key"))
    usual = _fetch_contexts(rows, contexts.join(large, "key", "left_anti"), length, coded)
    usual = usual.select(F.col("key").alias("root"), "key", "ctx", "c", "left", "right", F.lit(0).alias("low"), F.lit(reach).alias("high"))
    if large.isEmpty():
        offsets = _sort_contexts(usual, length)
    else:
        parts, single, early = _parted(_fetch_contexts(rows, contexts.join(large, "key", "left_semi"), length, coded), length)
        offsets = _sort_contexts(usual.unionByName(parts), length).unionByName(_equal_windows(single, length)).unionByName(early)
        offsets = offsets.groupBy("root", "ctx").agg(F.min("least").alias("least"), F.max("largest").alias("largest"))
    offsets = offsets.withColumnRenamed("root", "key")

    alone = seen.where("NOT several").select(
        "doc_id", "__th", "pos", F.greatest(F.lit(0), length - F.least(F.lit(length), F.col("n") - F.col("pos"))).alias("least"),
        F.least(F.lit(reach), F.col("pos")).alias("largest"),
    ).where("least <= largest")
    shared = seen.where("several").join(offsets, ["key", "ctx"]).select("doc_id", "__th", "pos", "least", "largest")
    spans = alone.union(shared).select(
        "doc_id", "__th", F.struct((F.col("pos") - F.col("largest")).alias("start"), (F.col("pos") - F.col("least") + length).alias("stop")).alias("s")
    )
    # rows that repeat in full have the same spans
    return spans.distinct()


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, __th, spans): byte ranges that repeated strings cover, overlapping, for documents that have any.

    ``docs`` holds doc_id, ``__th``, a hash of the text, and text.
    """
    return _span_rows(docs, docs, length).groupBy("doc_id", "__th").agg(F.collect_list("s").alias("spans"))


def _with_hash(df: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return df.select("doc_id", F.xxhash64(text).alias("__th"), text.alias("text"))


def remove_repeats(df: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row per row of ``df`` (doc_id, text): ``doc_id``, ``n_bytes``, ``spans`` (start, stop: the maximal runs of
    bytes covered by a string of ``length`` bytes that also starts anywhere else) and ``kept``, the other bytes.

    Texts are judged whole, as UTF-8; matches stay within a document, may overlap, and are found on the input, not on
    what is left. All occurrences go, the first one too. Copies of a text are one context each, so a group of
    copies of any size is one aggregated row; a key whose contexts are too many for a task is parted by further bytes. Null texts are empty, texts below ``length`` bytes have no string, repeated
    rows are copies of each other, a null doc_id is kept, an empty table gives an empty result, and other
    columns are not read. A run may end inside a character: ``kept`` is binary.
    """
    docs = _with_hash(df)
    lists = repeated_spans(docs, length)
    met = docs.join(lists, same(docs, lists, *_KEY), "left").select(docs["doc_id"], docs["text"], lists["spans"])
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        for batch in slices(batches, 256):
            texts = byte_list(batch.column("text"))
            spans = [_merged(s) for s in batch.column("spans").to_pylist()]
            kept = []
            for text, own in zip(texts, spans):
                edges = [0, *(x for s in own for x in s), len(text)]
                kept.append(b"".join([text[a:b] for a, b in zip(edges[::2], edges[1::2])]) if own else text)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(list(map(len, texts)), pa.int64()), pa.array([[{"start": a, "stop": b} for a, b in s] for s in spans], span), pa.array(kept, pa.binary())],
                ["doc_id", "n_bytes", "spans", "kept"],
            )

    return met.mapInArrow(run, f"doc_id {kind}, n_bytes long, spans array<struct<start:long,stop:long>>, kept binary")


def _removed(text: bytes, spans: list[dict] | None, passages: list[dict] | None) -> list[tuple[int, int]]:
    """The maximal byte ranges of spans of bytes and of passages, spans of word codes."""
    own = list(spans or [])
    if passages:
        starts, stops = _word_bounds(text)
        for p in passages:
            first, last = -(-p["start"] // CODE), p["stop"] // CODE - 1  # a word is in a passage with all of its code
            own.append({"start": int(starts[first]), "stop": int(stops[last])})
    return _merged(own)


def without_repeats(df: DataFrame, length: int = LENGTH, words: int | None = None) -> DataFrame:
    """``df`` with repeated strings taken out of ``text`` and ``n_chars`` counted anew; no row is dropped. What is left of a
    character that was cut is left out. Rows are told apart by doc_id and a hash of their text.

    Strings of ``length`` bytes go that also start anywhere else. If ``words`` is given, so do passages of that many words that also
    start anywhere else, from their first word to their last, whatever blanks stand between words and however few bytes
    they have. Both are judged on the input."""
    docs = _with_hash(df)
    # whole rows are dealt out once, for the contexts and for the cut
    wide = df.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("__th"), F.struct(*[df[c] for c in df.columns]).alias("__row"))
    found = _span_rows(docs, wide, length).select(*_KEY, "s", F.lit(False).alias("passage"))
    if words is not None:
        found = found.unionByName(_span_rows(docs, wide, words * CODE, coded=True).select(*_KEY, "s", F.lit(True).alias("passage")))
    lists = found.groupBy(*_KEY).agg(
        F.collect_list(F.when(~F.col("passage"), F.col("s"))).alias("spans"), F.collect_list(F.when(F.col("passage"), F.col("s"))).alias("passages")
    )

    @F.arrow_udf("string")
    def cut(rows: pa.Array, spans: pa.Array, passages: pa.Array) -> pa.Array:
        out = []
        for text, own, others in zip(_texts(rows, False), spans.to_pylist(), passages.to_pylist()):
            edges = [0, *(x for s in _removed(text, own, others) for x in s), len(text)]
            out.append(b"".join([text[a:b] for a, b in zip(edges[::2], edges[1::2])]).decode("utf-8", "ignore"))
        return pa.array(out, pa.string())

    met = wide.join(lists, same(wide, lists, *_KEY), "left").select(wide["__row"], lists["spans"].alias("__spans"), lists["passages"].alias("__passages"))
    text = F.when(F.col("__spans").isNotNull(), cut("__row", "__spans", "__passages")).otherwise(F.col("__row.text"))
    done = met.select(*[text.alias(c) if c == "text" else F.col("__row").getField(c).alias(c) for c in df.columns])
    if "n_chars" in df.columns:
        done = done.withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast("long"))
    return done.select(*df.columns)
