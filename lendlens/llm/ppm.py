"""Language identification by prediction by partial matching: code lengths of a text under byte context trees."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lendlens.session import settle

ORDER = 4  # bytes of the longest context
ENTRIES = 1 << 19  # (context, byte) entries of all trees together; 12 bytes each
_LEAST = 256  # entries that a tree gets at least
_PIECE = 1 << 20  # bytes counted or scored at a time
_CACHE = 1 << 20  # grams whose code lengths a worker keeps
_PAD = b"\n" * ORDER  # what stands before a text: it begins like a line


def _pieces(texts: Sequence[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(owner, gram) of every byte of the texts, about ``_PIECE`` at a time: a gram is the ``ORDER`` bytes before and the byte
    itself as one number, the owner its text's place."""
    held: list[tuple[int, bytes]] = []
    size = 0

    def grams() -> tuple[np.ndarray, np.ndarray]:
        lengths = np.array([len(b) for _, b in held], np.int64)
        data = np.frombuffer(b"".join(b for _, b in held), np.uint8)
        whole = np.zeros(max(0, len(data) - ORDER), np.int64)
        for i in range(ORDER + 1):
            whole = (whole << 8) | data[i : len(data) - ORDER + i]
        own = np.ones(len(data), bool)
        own[((np.cumsum(lengths) - lengths)[:, None] + np.arange(ORDER)).ravel()] = False
        return np.repeat(np.array([k for k, _ in held], np.int64), lengths - ORDER), whole[own[ORDER:]]

    for k, text in enumerate(texts):
        padded = _PAD + text
        for at in range(0, len(text), _PIECE):
            held.append((k, padded[at : at + _PIECE + ORDER]))
            size += len(held[-1][1])
            if size >= _PIECE:
                yield grams()
                held, size = [], 0
    if held:
        yield grams()


def gram_counts(df: DataFrame, label: str, text: str) -> DataFrame:
    """(label, gram, n) over all bytes of all labelled texts; grams are counted per label and piece before they are shuffled."""
    rows = df.select(df[label].cast("string").alias("label"), df[text].alias("text")).where("label IS NOT NULL AND text <> ''")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = batch.column(0).to_pylist()
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            for one in sorted(set(labels)):
                for _, grams in _pieces([t for t, own in zip(texts, labels) if own == one]):
                    found, n = np.unique(grams, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([one] * len(found)), pa.array(found), pa.array(n)], ["label", "gram", "n"])

    return rows.mapInArrow(run, "label string, gram long, n long").groupBy("label", "gram").agg(F.sum("n").alias("n"))


def tree_entries(counts: DataFrame, entries: int = ENTRIES) -> DataFrame:
    """(label, k, entry, n): how often a byte follows a context of k bytes, entry = context * 256 + byte.

    The counts of shorter contexts are sums of those of longer ones. A label keeps its most frequent entries, as many as
    its share of ``entries`` holds without parting entries of one frequency. An entry is never more frequent
    than the one a byte shorter, so every context in the tree has all its shorter ones there, with all their bytes.
    """
    orders = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col("gram").bitwiseAND(F.lit((1 << 8 * (k + 1)) - 1)).alias("entry")) for k in range(ORDER + 1)]))
    cells = counts.select("label", orders.alias("o"), "n").select("label", "o.k", "o.entry", "n")
    known = settle(cells.groupBy("label", "k", "entry").agg(F.sum("n").alias("n")))
    sizes = settle(known.groupBy("label", "n").agg(F.count(F.lit(1)).alias("m")))
    labels = sizes.select("label").distinct().count()
    if labels and entries // labels < _LEAST:
        raise ValueError(f"{labels} labels need at least {labels * _LEAST} entries")
    more = Window.partitionBy("label").orderBy(F.col("n").desc())  # one row per frequency
    fits = sizes.withColumn("m", F.sum("m").over(more)).where(F.col("m") <= entries // max(labels, 1))
    cut = fits.groupBy("label").agg(F.min("n").alias("least"))
    return known.join(cut, "label").where("n >= least").select("label", "k", "entry", "n")


@dataclass
class Level:
    """The contexts of one length: their entries, and per context the sums of its counts (``total``), its number of
    bytes (``kinds``) and what these bytes count in the context a byte shorter (``above``)."""

    entries: np.ndarray
    counts: np.ndarray
    contexts: np.ndarray
    total: np.ndarray
    kinds: np.ndarray
    above: np.ndarray


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the wanted numbers among sorted keys, and whether they are there."""
    at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
    return at, keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool)


class Tree:
    """A context tree with frozen counts. A byte is coded in the longest known context; where that has not seen it, an
    escape leads to the next shorter one, in which all bytes of the longer are left out. An escape weighs as many
    counts as the context has different bytes left; behind the empty context all remaining bytes are alike."""

    def __init__(self, k: np.ndarray, entries: np.ndarray, counts: np.ndarray):
        self.levels: list[Level] = []
        for order in range(ORDER + 1):
            mine = k == order
            sort = np.argsort(entries[mine])
            own, n = entries[mine][sort], counts[mine][sort].astype(np.float64)
            contexts, start, kinds = np.unique(own >> 8, return_index=True, return_counts=True)
            above = np.zeros(len(contexts))
            if order and len(own):
                shorter = self.levels[-1]
                at, _ = _find(shorter.entries, own & ((1 << 8 * order) - 1))
                above = np.add.reduceat(shorter.counts[at], start)
            total = np.add.reduceat(n, start) if len(own) else np.zeros(0)
            self.levels.append(Level(own, n, contexts, total, kinds.astype(np.float64), above))

    def bits(self, grams: np.ndarray) -> np.ndarray:
        """The exact code length of the last byte of each gram after the bytes before it."""
        out = np.zeros(len(grams))
        open_ = np.arange(len(grams))
        left_sum, left_kinds = np.zeros(len(grams)), np.zeros(len(grams))  # what the longer context leaves out
        for order in range(ORDER, -1, -1):
            level = self.levels[order]
            own = grams[open_] & ((1 << 8 * (order + 1)) - 1)
            at, there = _find(level.contexts, own >> 8)
            if not there.any():
                continue
            who, at, own = open_[there], at[there], own[there]
            kinds = level.kinds[at] - left_kinds[who]
            space = level.total[at] - left_sum[who] + kinds
            place, seen = _find(level.entries, own)
            out[who[seen]] += np.log2(space[seen]) - np.log2(level.counts[place[seen]])
            escape = ~seen & (kinds > 0)  # without a byte left to code, the escape is certain
            out[who[escape]] += np.log2(space[escape]) - np.log2(kinds[escape])
            left_sum[who], left_kinds[who] = level.above[at], level.kinds[at]
            coded = np.zeros(len(grams), bool)
            coded[who[seen]] = True
            open_ = open_[~coded[open_]]
        rest = 256 - (self.levels[0].kinds[0] if len(self.levels[0].kinds) else 0)
        out[open_] += np.log2(max(rest, 1))
        return out


class Scorer:
    """Code lengths of texts under several trees; those of grams met before are kept, up to ``_CACHE`` of them."""

    def __init__(self, trees: Sequence[Tree]):
        self.trees = trees
        self._clear()

    def _clear(self) -> None:
        self.grams, self.known = np.zeros(0, np.int64), np.zeros((0, len(self.trees)))

    def _places(self, grams: np.ndarray) -> np.ndarray:
        at, there = _find(self.grams, grams)
        if there.all():
            return at
        if len(self.grams) > _CACHE:
            self._clear()
            there[:] = False
        new = grams[~there]
        both = np.concatenate([self.grams, new])
        lengths = np.vstack([self.known, np.stack([t.bits(new) for t in self.trees], axis=1)])
        sort = np.argsort(both)
        self.grams, self.known = both[sort], lengths[sort]
        return np.searchsorted(self.grams, grams)

    def bits(self, texts: Sequence[bytes]) -> np.ndarray:
        """Bits per text and tree. A text's grams are summed in sorted order within its pieces, so the result does not depend on other texts."""
        out = np.zeros((len(texts), len(self.trees)))
        if not self.trees:
            return out
        shift = 8 * (ORDER + 1)
        for owner, grams in _whole_pieces(texts):
            low = owner[0]
            keys, n = np.unique(((owner - low) << shift) | grams, return_counts=True)
            who, own = low + (keys >> shift), keys & ((1 << shift) - 1)
            distinct, back = np.unique(own, return_inverse=True)
            at = self._places(distinct)[back]
            for j in range(len(self.trees)):
                out[:, j] += np.bincount(who, n * self.known[at, j], len(texts))
        return out


def _whole_pieces(texts: Sequence[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """As ``_pieces``, but a text longer than a piece starts one of its own."""
    held: list[bytes] = []
    first = size = 0
    for k, text in enumerate(texts):
        if held and size + len(text) > _PIECE:
            for owner, grams in _pieces(held):
                yield owner + first, grams
            held, size, first = [], 0, k
        held.append(text)
        size += len(text)
    for owner, grams in _pieces(held):
        yield owner + first, grams


@dataclass
class Model:
    languages: list[str]
    trees: list[Tree]


def train(df: DataFrame, label: str = "lang", text: str = "text", entries: int = ENTRIES) -> Model:
    """One tree per label, from the counts of all labelled texts; ``entries`` bounds what reaches the driver and the tasks."""
    table = tree_entries(gram_counts(df, label, text), entries).toArrow()
    labels = np.array(table.column("label").to_pylist(), object)
    k, entry, n = (table.column(c).to_numpy() for c in ("k", "entry", "n"))
    languages = sorted(set(labels.tolist()))
    return Model(languages, [Tree(k[labels == x], entry[labels == x], n[labels == x]) for x in languages])


def predict(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``df``: ``key``, ``lang_pred`` and ``score``.

    The language whose tree codes the whole text in the fewest bits wins, on a tie the first by name; ``score`` is
    the probability that the code lengths give it among the languages, all alike beforehand. A null text and one without a letter
    are ``und`` with score 0, as is every text if no language was learned. Texts of any length are scored whole, in pieces, where they are read; nothing is
    shuffled. Repeated rows get equal results, an empty table an empty one, and no other column is read.
    """
    rows = df.select(df[key].alias("__key"), df[text].alias("__text"))
    kind = dict(rows.dtypes)["__key"]
    shared = df.sparkSession.sparkContext.broadcast(model)  # at most ``entries`` entries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, names = Scorer(shared.value.trees), shared.value.languages
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                texts = part.column(1).to_pylist()
                known = [t is not None and bool(names) and any(map(str.isalpha, t)) for t in texts]
                bits = scorer.bits([t.encode() if k else b"" for t, k in zip(texts, known)])
                best = bits.argmin(axis=1) if names else np.zeros(len(texts), int)
                score = 1 / np.exp2(np.maximum(bits.min(axis=1, keepdims=True) - bits, -2000)).sum(axis=1) if names else np.zeros(len(texts))
                said = [names[b] if k else "und" for b, k in zip(best.tolist(), known)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(said, pa.string()), pa.array(np.where(known, score, 0.0))], [key, "lang_pred", "score"])

    return rows.mapInArrow(run, f"`{key}` {kind}, lang_pred string, score double")


def held_out(key: Column) -> Column:
    """Whether a row is kept from learning: crc32 of its id as text leaves 2 when divided by 4. A null id is not kept."""
    return F.coalesce(F.crc32(key.cast("string")) % 4 == 2, F.lit(False))
