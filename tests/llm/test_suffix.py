import random
import re
from collections import Counter

import numpy as np
import pytest

from lendlens.llm import suffix
from lendlens.llm.suffix import anchors, deep_shallow_sort, remove_repeats, without_repeats


def brute(texts, length):
    """What is left of each text, and its removed runs."""
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        covered = np.zeros(len(t) + 2, bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                covered[i + 1 : i + length + 1] = True
        edges = np.flatnonzero(covered[1:] != covered[:-1])
        out.append((bytes(np.frombuffer(t, np.uint8)[~covered[1:-1]]), [(int(a), int(b)) for a, b in zip(edges[::2], edges[1::2])]))
    return out


def made_texts(seed, letters):
    rng = random.Random(seed)

    def run(n):
        return "".join(rng.choice(letters) for _ in range(n))

    passages = [run(rng.randint(5, 70)) for _ in range(6)]
    texts = ["".join(rng.choice([rng.choice(passages), run(rng.randint(0, 30))]) for _ in range(rng.randint(0, 7))) for _ in range(60)]
    return texts + texts[:4] * 3 + ["", letters[0] * 500, run(3000)]


def check(spark, texts, length):
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(None, None, 1), (0, texts[0], 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept int")
    got = Counter((r["doc_id"], r["n_bytes"], bytes(r["kept"]), tuple((s["start"], s["stop"]) for s in r["spans"])) for r in remove_repeats(df, length).collect())
    data = [(t or "").encode() for _, t, _ in rows]
    want = Counter((k, len(d), kept, tuple(spans)) for (k, _, _), d, (kept, spans) in zip(rows, data, brute(data, length)))
    assert got == want


@pytest.mark.parametrize("letters, length", [("ab", 20), ("abcdefgh", 21), ("aéü🙂 ", 40)])
def test_equals_brute_force(spark, letters, length):
    check(spark, made_texts(length, letters), length)


def test_large_groups_are_parted(spark, monkeypatch):
    monkeypatch.setattr(suffix, "GROUP", 3)
    check(spark, made_texts(9, "abc"), 20)


def test_a_key_with_very_many_contexts(spark):
    """One passage in 50,000 different surroundings, some of which share more than the passage."""
    rng = random.Random(2)
    passage = "the common passage"  # 18 of 20 bytes
    texts = ["".join(rng.choice("abcdefgh") for _ in range(6)) + passage + "".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(50_000)]
    got = {r["doc_id"]: (bytes(r["kept"]), [(s["start"], s["stop"]) for s in r["spans"]]) for r in remove_repeats(
        spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 20).collect()}
    assert got == dict(enumerate(brute([t.encode() for t in texts], 20)))


def test_multikey_groups_rows_of_equal_letters():
    rng = np.random.default_rng(6)
    fixed = rng.integers(0, 4, (500, 3)).astype(np.uint64)
    order, group = suffix._multikey(fixed)
    rows = [tuple(r) for r in fixed[order].tolist()]
    assert rows == sorted(map(tuple, fixed.tolist()))
    assert all((rows[i] == rows[i - 1]) == (group[i] == group[i - 1]) for i in range(1, 500))


def test_small_batches_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(suffix, "_BATCH", 5)
    monkeypatch.setattr(suffix, "_CHUNK", 64)
    check(spark, made_texts(4, "abcd"), 20)


def test_documents(spark, documents):
    rows = [(r["doc_id"], r["text"] or "") for r in documents.collect()]
    want = dict(zip([k for k, _ in rows], brute([t.encode() for _, t in rows], 400)))
    for r in remove_repeats(documents).collect():
        assert (bytes(r["kept"]), [(s["start"], s["stop"]) for s in r["spans"]]) == want[r["doc_id"]]


def test_texts_without_repeats(spark):
    shared = "é" * 30
    df = spark.createDataFrame([(1, f"one {shared} x", 0, 9), (2, f"two{shared}", 0, 9), (3, None, 0, 9), (3, "short", 0, 9)], "doc_id long, text string, spans int, n_chars long")
    got = {(r["doc_id"], r["text"], r["n_chars"]) for r in without_repeats(df, 40).collect()}
    assert got == {(1, "one  x", 6), (2, "two", 3), (3, None, 0), (3, "short", 5)}
    assert without_repeats(df.limit(0)).columns == df.columns and remove_repeats(df.limit(0)).count() == 0


def word_runs_cut(texts, words):
    """Texts without their passages of ``words`` words that also start elsewhere."""
    places = [[m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", t)] for t in texts]
    runs = [[tuple(t[a:b] for a, b in own[i : i + words]) for i in range(len(own) - words + 1)] for t, own in zip(texts, places)]
    seen = Counter(r for own in runs for r in own)
    out = []
    for t, own, mine in zip(texts, places, runs):
        gone = np.zeros(len(t), bool)
        for i, r in enumerate(mine):
            if seen[r] > 1:
                gone[own[i][0] : own[i + words - 1][1]] = True
        out.append(bytes(np.frombuffer(t, np.uint8)[~gone]))
    return out


def test_short_passages_of_many_words(spark):
    """Passages of 51 words and more go though they are under 400 bytes; passages of 50 words stay."""
    rng = random.Random(5)

    def prose(n, blank=" "):
        return blank.join("".join(rng.choice("abcdé") for _ in range(rng.randint(1, 7))) for _ in range(n))

    long, short, least = prose(55), prose(50), prose(51)
    texts = [f"{prose(rng.randint(0, 40))} {p} {prose(rng.randint(0, 40))}" for p in (long, short, least) for _ in range(4)]
    texts += [f"{prose(9)} {long.replace(' ', chr(10) + chr(9))}", f"{least} {least}", " and" * 60, prose(30), "", f"{prose(5)} {long[2:]}", texts[0], f"{long}\x1c"]
    data = [t.encode() for t in texts]
    assert max(len(p.encode()) for p in (long, short, least)) < 400
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[1])]
    got = {r["doc_id"]: r["text"] for r in without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 100_000, words=51).collect()}
    want = word_runs_cut([*data, data[1]], 51)
    assert got == {i: t.decode() for (i, _), t in zip(rows, want)}
    assert long not in got[1] and short in got[4] and least not in got[8]


def test_clashing_names_pass_through(spark):
    df = spark.createDataFrame([(1, "x" * 90, 5, "a", 7)], "doc_id long, text string, _th int, _text string, _spans int")
    assert [tuple(r) for r in without_repeats(df, 40).collect()] == [(1, "", 5, "a", 7)]


def test_deep_shallow_sort():
    rng = random.Random(1)
    for _ in range(100):
        letters = rng.choice([b"ab", b"abc", bytes(range(256))])
        strings = [b"x" * rng.choice([0, 8, 17, 30]) + bytes(rng.choice(letters) for _ in range(rng.choice([0, 1, 9, 40]))) for _ in range(rng.randint(0, 40))]
        order, common = deep_shallow_sort(strings)
        assert [strings[i] for i in order] == sorted(strings)
        for i in range(1, len(strings)):
            a, b = strings[order[i - 1]], strings[order[i]]
            assert a[: common[i]] == b[: common[i]] and a[common[i] : common[i] + 1] != b[common[i] : common[i] + 1] or a == b and common[i] == len(a)


def test_every_string_holds_an_anchor_that_its_own_bytes_decide():
    rng = random.Random(8)
    text = bytes(rng.choice(b"abcd") for _ in range(2000))
    found = anchors(text, 50)
    for start in range(0, 1950, 7):
        own = anchors(text[start : start + 50], 50)
        assert len(own) == 1 and start + own[0] in found
