import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lendlens.llm import ppm
from lendlens.llm.ppm import ORDER, Scorer, Tree, gram_counts, predict, train, tree_entries
from lendlens.llm.queries import QUERIES
from lendlens.llm.common import table


def brute_counts(texts):
    """{context: {byte: n}} for all context lengths."""
    out = defaultdict(Counter)
    for t in texts:
        data = b"\n" * ORDER + t.encode()
        for i in range(ORDER, len(data)):
            for k in range(ORDER + 1):
                out[data[i - k : i]][data[i]] += 1
    return out


def pruned(counts, limit):
    """The most frequent entries, frequency by frequency, while they fit."""
    sizes = Counter(n for own in counts.values() for n in own.values())
    least, total = None, 0
    for n in sorted(sizes, reverse=True):
        total += sizes[n]
        if total > limit:
            break
        least = n
    kept = {c: {s: n for s, n in own.items() if least is not None and n >= least} for c, own in counts.items()}
    return {c: own for c, own in kept.items() if own}


def brute_bits(tree, context, byte):
    """Walks from the longest known context to shorter ones and leaves out what the longer ones have."""
    bits, out = 0.0, set()
    for k in range(ORDER, -1, -1):
        own = tree.get(context[ORDER - k :])
        if own is None:
            continue
        left = {s: n for s, n in own.items() if s not in out}
        space = sum(left.values()) + len(left)
        if byte in left:
            return bits - math.log2(left[byte] / space)
        if left:
            bits -= math.log2(len(left) / space)
        out |= set(own)
    return bits + math.log2(256 - len(out))


def text_bits(tree, text, known):
    data = b"\n" * ORDER + text.encode()
    total = 0.0
    for i in range(ORDER, len(data)):
        key = data[i - ORDER : i + 1]
        if key not in known:
            known[key] = brute_bits(tree, key[:-1], key[-1])
        total += known[key]
    return total


def tree_of(counts):
    cells = [(len(c), int.from_bytes(c + bytes([s]), "big"), n) for c, own in counts.items() for s, n in own.items()]
    k, entry, n = np.array(cells, np.int64).reshape(-1, 3).T
    return Tree(k, entry, n)


def test_code_lengths_and_probabilities():
    counts = brute_counts(["abracadabra", "abrabra é", "\n\nab"])
    for limit in (10**9, 40, 5):
        tree = pruned(counts, limit)
        fast = tree_of(tree)
        for context in (b"abra", b"zzzz", b"\n\n\n\n", b"\xc3abr", b"cada"):
            grams = np.array([int.from_bytes(context + bytes([s]), "big") for s in range(256)])
            bits = fast.bits(grams)
            assert bits == pytest.approx([brute_bits(tree, context, s) for s in range(256)])
            assert np.exp2(-bits).sum() == pytest.approx(1.0)  # with exclusions nothing is lost
    assert Tree(*np.zeros((3, 0), np.int64)).bits(np.array([0])) == pytest.approx([8.0])


def test_counts_and_pruned_trees(spark):
    texts = {"x": ["abracadabra", "abra é"], "y": ["lorem ipsum lorem", ""], None: ["not read"]}
    rows = [(lang, t) for lang, own in texts.items() for t in [*own, None]]
    counts = gram_counts(spark.createDataFrame(rows, "lang string, text string"), "lang", "text")
    for limit in (1 << 19, 512):
        got = defaultdict(lambda: defaultdict(dict))
        for r in tree_entries(counts, limit).collect():
            entry = r["entry"].to_bytes(r["k"] + 1, "big")
            got[r["label"]][entry[:-1]][entry[-1]] = r["n"]
        assert got == {lang: pruned(brute_counts(texts[lang]), limit // 2) for lang in ("x", "y")}
    with pytest.raises(ValueError):
        tree_entries(counts, 100)


def test_query_against_brute_force(spark, small, documents):
    rows = documents.select("doc_id", "text", "lang").collect()
    kept = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2]
    languages = sorted({r["lang"] for r in kept if r["lang"] is not None})
    trees = {x: pruned(brute_counts([r["text"] or "" for r in kept if r["lang"] == x]), ppm.ENTRIES // len(languages)) for x in languages}
    known = {x: {} for x in languages}
    got = {r["doc_id"]: r for r in QUERIES["op13_language"](spark, small).collect()}
    assert len(got) == len(rows)
    for r in rows:
        bits = [text_bits(trees[x], r["text"] or "", known[x]) for x in languages]
        mine = got[r["doc_id"]]
        assert mine["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert mine["lang_pred"] == languages[bits.index(min(bits))]
        assert mine["score"] == pytest.approx(1 / sum(2 ** max(min(bits) - b, -1000) for b in bits), abs=1e-9)


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    truth = table(spark, folder, "documents").select("doc_id", "lang")
    found = QUERIES["op13_language"](spark, folder).where("held_out").join(truth, "doc_id")
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).collect()[0][0] >= 0.97


def test_edge_cases(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "der Hund und die Katze", "de"), (3, None, "en"), (4, "", "de"), (5, "123 !?", "en"), (None, "und der", None), (1, "the cat and the dog", "en")]
    df = spark.createDataFrame(rows, "doc_id int, text string, lang string").withColumns({"score": F.lit(9), "label": F.lit("x"), "__n": F.lit(0)})
    model = train(df)
    got = predict(df, model).collect()
    assert sorted((r["doc_id"] or 0, r["lang_pred"]) for r in got) == [(0, "de"), (1, "en"), (1, "en"), (2, "de"), (3, "und"), (4, "und"), (5, "und")]
    assert all((r["score"] == 0) == (r["lang_pred"] == "und") for r in got)
    assert predict(df.limit(0), model).count() == 0
    untaught = train(df.where("lang IS NULL"))
    assert untaught.languages == [] and {r["lang_pred"] for r in predict(df, untaught).collect()} == {"und"}


def test_long_texts_are_scored_whole_and_alone(monkeypatch):
    tree = tree_of(brute_counts(["abracadabra " * 5]))
    texts = [b"abra", b"cadabra abra " * 200, b"", b"zebra" * 30, b"abra"]
    alone = np.vstack([Scorer([tree]).bits([t]) for t in texts])
    assert np.array_equal(Scorer([tree]).bits(texts), alone)
    monkeypatch.setattr(ppm, "_PIECE", 64)
    assert Scorer([tree]).bits(texts) == pytest.approx(alone)
    monkeypatch.setattr(ppm, "_CACHE", 3)
    assert Scorer([tree]).bits(texts) == pytest.approx(alone)
