"""BPE encoding and decoding: a segment tree over the ranks of adjacent pairs yields each merge."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from lendlens.llm.common import slices

_ROWS = 2048  # rows encoded at a time
_NONE = 1 << 62
_NO_LEAF = (1 << 31) - 1  # in trees of short words, whose leaves fit 32 bits
#: Control characters that str.split() takes for white space, but Unicode's White_Space does not.
_ODD_SPACES = regex.compile("[\x1c-\x1f]")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where it is one, else the next
    free code point from 256 on."""
    plain = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of every run, one run after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


class PairTree:
    """A segment tree over the pairs (symbol i, next symbol), each leaf ``rank * n + i``.

    The minimum at the root is the lowest rank and, among equal ranks, the leftmost pair. A merge
    changes at most three leaves; each update climbs one path.
    """

    def __init__(self, leaves: list[int]):
        self.n = len(leaves)
        self.width = 1 << max(0, self.n - 1).bit_length()
        self.nodes = nodes = [_NONE] * self.width + leaves + [_NONE] * (self.width - self.n)
        for i in range(self.width - 1, 0, -1):
            a, b = nodes[2 * i], nodes[2 * i + 1]
            nodes[i] = a if a < b else b

    def root(self) -> int:
        return self.nodes[1]

    def update(self, i: int, value: int) -> None:
        nodes = self.nodes
        i += self.width
        nodes[i] = value
        while i > 1:
            other = nodes[i ^ 1]
            if other < value:
                value = other
            i >>= 1
            if nodes[i] == value:
                return
            nodes[i] = value


class Bpe:
    """A byte-level BPE with word ends, read from a tokenizers file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        suffix = spec["model"].get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token_count = max([*vocab.values(), *self.special.values()]) + 1
        tokens = [""] * self.token_count
        for token, number in [*vocab.items(), *self.special.items()]:
            tokens[number] = token
        self.token_array = pa.array(tokens, pa.string())
        pairs = [p.split(" ") if isinstance(p, str) else p for p in spec["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        #: by rank: the id that a merge makes
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        #: sorted pairs (left id above, right id below) and their ranks, with one end mark
        keys = left << 32 | right
        order = np.argsort(keys)
        self.pair_keys = np.append(keys[order], np.iinfo(np.int64).max)
        self.pair_ranks = np.append(order, _NONE)
        self.ranks = dict(zip(keys.tolist(), range(len(keys))))
        symbols = byte_symbols()
        self.inner = np.array([vocab.get(s, -1) for s in symbols], np.int64)
        self.last = np.array([vocab.get(s + suffix, -1) for s in symbols], np.int64)
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(split["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}"))
        self.specials = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        #: short words can be merged together if every byte has a symbol and a leaf fits 32 bits
        self.together = bool((self.inner >= 0).all() and (self.last >= 0).all()) and len(self.merged) < _NO_LEAF // 64

    def symbols(self, data: np.ndarray) -> list[int]:
        """The ids of the bytes; those that the vocabulary lacks are left out."""
        ids = [*self.inner[data[:-1]].tolist(), int(self.last[data[-1]])]
        return [i for i in ids if i >= 0]

    def merge(self, ids: list[int]) -> list[int]:
        """Applies the lowest-rank, leftmost merge until no pair can be merged."""
        n, ranks, merged = len(ids), self.ranks, self.merged
        if n < 2:
            return ids

        def leaf(i: int, a: int, b: int) -> int:
            rank = ranks.get(a << 32 | b)
            return _NONE if rank is None else rank * n + i

        tree = PairTree([leaf(i, a, b) for i, (a, b) in enumerate(zip(ids, ids[1:]))])
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ids = list(ids)
        while (best := tree.root()) < _NONE:
            rank, i = divmod(best, n)
            j = after[i]
            ids[i], ids[j] = int(merged[rank]), -1
            k = after[i] = after[j]
            if j < n - 1:
                tree.update(j, _NONE)
            if k < n:
                before[k] = i
                tree.update(i, leaf(i, ids[i], ids[k]))
            else:
                tree.update(i, _NONE)
            if (h := before[i]) >= 0:
                tree.update(h, leaf(h, ids[h], ids[i]))
        return [x for x in ids if x >= 0]

    def _leaves(self, left: np.ndarray, right: np.ndarray, place: np.ndarray, width: int) -> np.ndarray:
        keys = left << 32 | right
        at = np.searchsorted(self.pair_keys, keys)
        ranks = np.where((self.pair_keys[at] == keys) & (left >= 0) & (right >= 0), self.pair_ranks[at], _NONE)
        return np.where(ranks < _NONE, ranks * width + place, _NO_LEAF).astype(np.int32)

    def merge_together(self, ids: np.ndarray) -> np.ndarray:
        """``merge`` for many short words at once: a row of ``ids`` each, as wide as a power of two, -1 behind the
        end. The trees of all words stand side by side and every step makes one merge in each word
        that has one."""
        n, width = ids.shape
        ids = np.concatenate([ids, np.full((n, 1), -1)], axis=1)
        place = np.arange(width)
        nodes = np.full((n, 2 * width), _NO_LEAF, np.int32)
        nodes[:, width:] = self._leaves(ids[:, :-1], ids[:, 1:], place[None, :], width)
        level = width
        while level > 1:
            level //= 2
            nodes[:, level : 2 * level] = np.minimum(nodes[:, 2 * level : 4 * level : 2], nodes[:, 2 * level + 1 : 4 * level : 2])
        after = np.tile(np.arange(1, width + 2), (n, 1))
        after[:, width - 1 :] = width
        before = np.tile(np.arange(-1, width), (n, 1))
        rows = np.arange(n)

        def update(rows: np.ndarray, at: np.ndarray, leaves: np.ndarray | int) -> None:
            at = at + width
            nodes[rows, at] = leaves
            while len(at) and at[0] > 1:
                at >>= 1
                nodes[rows, at] = np.minimum(nodes[rows, 2 * at], nodes[rows, 2 * at + 1])

        while len(rows := rows[nodes[rows, 1] < _NO_LEAF]):
            best = nodes[rows, 1]
            i = best & (width - 1)
            j = after[rows, i]
            k = after[rows, j]
            ids[rows, i] = self.merged[best >> (width.bit_length() - 1)]
            ids[rows, j] = -1
            after[rows, i] = k
            before[rows, k] = i
            update(rows, j, _NO_LEAF)
            update(rows, i, self._leaves(ids[rows, i], ids[rows, k], i, width))
            h = before[rows, i]
            some = h >= 0
            held, h = rows[some], h[some]
            update(held, h, self._leaves(ids[held, h], ids[held, i[some]], h, width))
        return ids[:, :-1]

    def encode_pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces one after the other, and where the ids of each piece begin and end."""
        offsets = np.frombuffer(pieces.buffers()[1], np.int32)[pieces.offset : pieces.offset + len(pieces) + 1].astype(np.int64)
        data = np.frombuffer(pieces.buffers()[2] or b"", np.uint8)
        sizes = np.diff(offsets)
        counts = np.zeros(len(pieces), np.int64)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        for width in (1, 2, 4, 8, 16, 32, 64) if self.together else ():
            own = np.flatnonzero((sizes <= width) & (sizes > width // 2))
            for at in range(0, len(own), 4096):
                part = own[at : at + 4096]
                n = sizes[part]
                ends = np.cumsum(n)
                column = np.arange(ends[-1]) - np.repeat(ends - n, n)
                codes = data[np.repeat(offsets[part], n) + column]
                symbols = self.inner[codes]
                symbols[ends - 1] = self.last[codes[ends - 1]]
                ids = np.full((len(part), width), -1, np.int64)
                ids[np.repeat(np.arange(len(part)), n), column] = symbols
                if width > 1:
                    ids = self.merge_together(ids)
                kept = ids >= 0
                counts[part] = kept.sum(axis=1)
                done.append((part, ids[kept]))
        for i in np.flatnonzero(sizes > (64 if self.together else 0)).tolist():
            ids = np.array(self.merge(self.symbols(data[offsets[i] : offsets[i + 1]])), np.int64)
            counts[i] = len(ids)
            done.append((np.array([i]), ids))
        ends = np.concatenate([[0], np.cumsum(counts)])
        out = np.empty(ends[-1], np.int32)
        for part, ids in done:
            out[_runs(ends[part], counts[part])] = ids
        return out, ends

    def split_words(self, words: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """The distinct pieces of distinct words; the pieces of all words as numbers, and where those of
        each word begin and end. Text without white space is one piece if it holds letters only."""
        plain = pc.utf8_is_alpha(words).to_numpy(zero_copy_only=False)
        mixed = [self.pieces.findall(w) for w in words.filter(pa.array(~plain)).to_pylist()]
        counts = np.ones(len(words), np.int64)
        counts[~plain] = list(map(len, mixed))
        ends = np.concatenate([[0], np.cumsum(counts)])
        letters = words.filter(pa.array(plain))
        others = pa.array([p for own in mixed for p in own], pa.string())
        pieces = pa.concat_arrays([letters, others]).dictionary_encode()
        numbers = pieces.indices.to_numpy()
        at = np.empty(ends[-1], np.int64)
        at[ends[:-1][plain]] = numbers[: len(letters)]
        at[_runs(ends[:-1][~plain], counts[~plain])] = numbers[len(letters) :]
        return pieces.dictionary, at, ends

    def normal(self, text: str) -> str:
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        # a capital sigma is lower-cased without regard to its place in the word
        return text.replace("Σ", "σ").lower()

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of whole texts one after the other, and where the ids of each text end.

        Texts are cut at special tokens into stretches; the stretches' words are collected into a dictionary,
        so that every distinct word of the batch is encoded once.
        """
        stretches: list[str] = []
        places: list[tuple[int, int]] = []  # stretches with a special token behind them, and its id
        stops = []
        for text in texts:
            end = 0
            if self.specials is not None:
                for found in self.specials.finditer(text):
                    places.append((len(stretches), self.special[found.group()]))
                    stretches.append(self.normal(text[end : found.start()]))
                    end = found.end()
            stretches.append(self.normal(text[end:] if end else text))
            stops.append(len(stretches))
        # Arrow takes the separators x1c to x1f for white space, which they are not here
        odd = {i: [w for w in regex.split(r"\p{White_Space}+", t) if w] for i, t in enumerate(stretches) if _ODD_SPACES.search(t)}
        split = pc.utf8_split_whitespace(pa.array([("" if i in odd else t) for i, t in enumerate(stretches)] if odd else stretches, pa.string()))
        if odd:
            split = pa.array([odd.get(i, own) for i, own in enumerate(split.to_pylist())], pa.list_(pa.string()))
        words = split.flatten().dictionary_encode()
        pieces, piece, word_ends = self.split_words(words.dictionary)
        flat, piece_ends = self.encode_pieces(pieces)
        # from words to their pieces, from pieces to their ids
        at = words.indices.to_numpy()
        size = word_ends[at + 1] - word_ends[at]
        piece = piece[_runs(word_ends[at], size)]
        piece_size = piece_ends[piece + 1] - piece_ends[piece]
        ids = flat[_runs(piece_ends[piece], piece_size)]
        ends = np.concatenate([[0], np.cumsum(piece_size)])[np.concatenate([[0], np.cumsum(size)])]
        stretch_ends = ends[split.offsets.to_numpy()[1:] - split.offsets[0].as_py()]
        doc_ends = stretch_ends[np.array(stops, np.int64) - 1] if stops else np.empty(0, np.int64)
        if places:
            behind = np.array([i for i, _ in places])
            ids = np.insert(ids, stretch_ends[behind], [t for _, t in places]).astype(np.int32)
            doc_ends = doc_ends + np.searchsorted(behind, stops)
        return ids, doc_ends

    def encode(self, text: str) -> list[int]:
        return self.encode_batch([text])[0].tolist()

    def decode_batch(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """The tokens of each text, joined by spaces, as the library does for files without a decoder;
        unknown ids are left out."""
        fine = (ids >= 0) & (ids < self.token_count)
        if not fine.all():
            ends = np.concatenate([[0], np.cumsum(fine)])[ends]
            ids = ids[fine]
        tokens = self.token_array.take(pa.array(ids))
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), tokens)
        return pc.binary_join(lists, " ")

    def decode(self, ids: list[int]) -> str:
        known = np.array([i for i in ids if i is not None], np.int32)
        return self.decode_batch(known, np.array([len(known)]))[0].as_py()


@lru_cache(maxsize=2)
def loaded(path: str) -> Bpe:
    """Read once per Python worker."""
    return Bpe(path)


def encode(df: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", decoded: bool = False) -> DataFrame:
    """One row per row of ``df``: ``key``, ``ids`` and, on request, ``decoded``, the text of the ids.

    ``tokenizer`` is the path of a tokenizers file that every executor can read. Encoding adds no
    special tokens; their strings in a text become their ids. Whole texts are encoded in the tasks
    that read them, without a shuffle. Null and empty texts have no ids. Repeated rows are encoded
    alike, an empty table gives an empty result, and no other column is read.
    """
    rows = df.select(df[key].alias("_key"), df[text].alias("_text"))
    kind = dict(rows.dtypes)["_key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(tokenizer)
        for batch in slices(batches, _ROWS):
            ids, ends = bpe.encode_batch([t or "" for t in batch.column(1).to_pylist()])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids))
            columns = [batch.column(0), lists]
            if decoded:
                columns.append(bpe.decode_batch(ids, ends))
            yield pa.RecordBatch.from_arrays(columns, [key, "ids", "decoded"][: len(columns)])

    return rows.mapInArrow(run, f"`{key}` {kind}, ids array<int>" + ", decoded string" * decoded)


def decode(df: DataFrame, tokenizer: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """One row per row of ``df``: ``key`` and ``decoded``; null ids give an empty text."""
    rows = df.select(df[key].alias("_key"), df[ids].alias("_ids"))
    kind = dict(rows.dtypes)["_key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(tokenizer)
        for batch in slices(batches, _ROWS):
            lists = [[i for i in own or [] if i is not None] for own in batch.column(1).to_pylist()]
            ends = np.cumsum(list(map(len, lists)))
            flat = np.array([i for own in lists for i in own], np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), bpe.decode_batch(flat, ends)], [key, "decoded"])

    return rows.mapInArrow(run, f"`{key}` {kind}, decoded string")
