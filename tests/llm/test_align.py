import hashlib
from bisect import bisect_right
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lendlens.llm import align as module
from lendlens.llm.align import SPLIT, ByteLevel, Pieces, align, links_of, slices_of
from lendlens.llm.queries import QUERIES, tokenizer_path

ODD = [
    "", " ", "a", "<|endoftext|> <s>x</s>", "a▁b", "日本語 🙂🙂 naïve Ça", "x\x00y\x1c\x85 z", "\n\n  \t a  b ", "½²٣ 123", "é" * 9, "'ll it'S", "​﻿",
    "<0x41>", "a" * 3000 + " " * 500, "ﬁ ß İ é",
]


@pytest.fixture(scope="module")
def paths(tokenizer_file):
    return tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries(paths):
    import sentencepiece
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(paths[0])
    first.encode_special_tokens = True
    return first, sentencepiece.SentencePieceProcessor(model_file=paths[1])


def brute(texts, libraries):
    """Every byte of a text is looked at: the tokens it lies in are linked."""
    first, second = libraries
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in plain)}
    out, counts = [], Counter()
    for text in texts:
        if not text:
            out.append(None)
            continue
        data = (" " + text).encode()
        a = first.encode(" " + text, add_special_tokens=False).ids
        b = second.encode(text)
        bytes_a = [bytes(letter[c] for c in first.id_to_token(i)) for i in a]
        bytes_b = [bytes([int(second.id_to_piece(i)[3:5], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if b"".join(bytes_a) != data or b"".join(bytes_b) != data:
            out.append(None)
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
        owners = [[i for i, own in enumerate(tokens) for _ in own] for tokens in (bytes_a, bytes_b)]
        links = [(a[i], b[j]) for i, j in dict.fromkeys(zip(*owners))]
        counts.update(links)
        common = sorted(set(ends_a) & set(ends_b))
        groups, low = [], 0
        for e in common:
            parts = [[str(t) for t in ids[bisect_right(ends, low) : bisect_right(ends, e)]] for ids, ends in ((a, ends_a), (b, ends_b))]
            groups.append("|".join(map(",".join, parts)))
            low = e
        out.append((len(a), len(b), len(common), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    top = defaultdict(int)
    for (_, b), n in counts.items():
        top[b] = max(top[b], n)
    rows = []
    for own in out:
        if own is None:
            rows.append((0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, n_groups, links, digest = own
            rows.append((n_a, n_b, n_groups, len(links), sum(counts[p] == top[p[1]] for p in links), sum(counts[p] for p in links), digest))
    return rows, counts, top


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_query_against_brute_force(spark, small, documents, libraries):
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in QUERIES["op12_alignment"](spark, small).collect()}
    rows = [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]
    short = [(k, t) for k, t in rows if len(t or "") < 1 << 20]
    want, _, _ = brute([t for _, t in short], libraries)
    assert len(got) == len(rows) == len(short) and got == {k: w for (k, _), w in zip(short, want)}


def test_odd_texts_in_several_blocks(spark, paths, libraries, monkeypatch):
    monkeypatch.setattr(module, "BLOCK", 1)
    texts = ODD + [None, None, ODD[5], ODD[5]]
    rows = [(None if t == ODD[3] else i, t, "x", "x", "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, block string, n_a string, pairs string")
    documents, pairs = align(df, *paths)
    want, counts, top = brute(texts, libraries)
    assert Counter(map(tuple, documents.collect())) == Counter((r[0], *w) for r, w in zip(rows, want))
    found = {(r["a"], r["b"]): (r["links"], r["best"]) for r in pairs.collect()}
    assert found == {p: (n, n == top[p[1]]) for p, n in counts.items()}
    assert want[4] == (0, 0, 0, 0, 0, 0, "")  # its mark reads back as a space
    documents, pairs = align(df.limit(0), *paths)
    assert documents.count() == 0 and pairs.count() == 0
    nothing = df.where(F.col("text").isNull())
    documents, pairs = align(nothing, *paths)
    assert documents.count() == 2 and pairs.count() == 0


def test_very_long_text(spark, paths, libraries):
    text = "The worthless Änderung " * 40_000
    documents, _ = align(spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string"), *paths)
    row = {r["doc_id"]: r for r in documents.collect()}[1]
    first, second = libraries
    assert row["n_a"] == len(first.encode(" " + text, add_special_tokens=False).ids) and row["n_b"] == len(second.encode(text))


def test_links_of_a_crossing_slice():
    ends_a, ends_b = np.array([2, 4, 9, 10]), np.array([3, 5, 9, 10])
    stops_a, stops_b = slices_of(ends_a.tolist(), ends_b.tolist())
    assert stops_a == [3, 4] and stops_b == [3, 4]
    left, right = links_of(ends_a, ends_b, np.array(stops_a), np.array(stops_b))
    assert sorted(zip(left.tolist(), right.tolist())) == [(0, 0), (1, 0), (1, 1), (2, 1), (2, 2), (3, 3)]


def test_quick_encoding_is_the_library_s(paths, libraries):
    own = ByteLevel(paths[0])
    assert own._quick is not None and own.encode([" " + t for t in ODD]) == [libraries[0].encode(" " + t, add_special_tokens=False).ids for t in ODD]
    import public_tokenizers

    assert SPLIT == public_tokenizers.PATTERN
    assert Pieces(paths[1]).bytes_of[3] == b"\x00"
