"""Every stage of the corpus pipeline against a plain version, on a small table of planted cases."""

import math
import random
from collections import Counter, defaultdict
from hashlib import md5, sha256

import pytest
import xxhash

import corpus_pipeline
from lendlens.llm import toxicity
from lendlens.llm.common import table

from .test_mixing import brute_targets
from .test_simhash import brute_fingerprint
from .test_suffix import brute as brute_repeats

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def planted(real, toxic):
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(400)]

    def prose(n):
        return " ".join(rng.choice(words) for _ in range(n))

    passage, base = prose(90), [prose(60) for _ in range(8)]
    texts = [(i, t) for i, t in enumerate([*base, *real, *toxic])]
    texts += [(100 + i, b) for i, b in enumerate(base[:4])]  # exact copies
    texts += [(200 + i, b.replace(" ", "  ").upper()) for i, b in enumerate(base[2:5])]  # copies but for case and blanks
    texts += [(300 + i, f"{prose(30)} {passage} {prose(20)}") for i in range(5)]  # a passage over 400 bytes
    texts += [(None, base[0]), (None, prose(20)), (None, None), (7, prose(25)), (7, prose(25)), (400, ""), (401, "é" * 500), (402, "é" * 500 + "x")]
    rows = [(k, t, rng.choice(["en", None]), rng.choice(["a", "b", "c", None]), len(t or "")) for k, t in texts]
    return rows + [rows[30], rows[30]]


@pytest.fixture(scope="module")
def stages(spark, documents, small):
    labels = {r["doc_id"] for r in table(spark, small, "labels").where("toxic = 1").collect()}
    texts = [(r["doc_id"], r["text"]) for r in documents.where("length(text) < 3000").orderBy("doc_id").collect()]
    rows = planted([t for k, t in texts if k not in labels][:15], [t for k, t in texts if k in labels][:8])
    docs, out = spark.createDataFrame(rows, SCHEMA), []
    for name, stage in corpus_pipeline.STAGES:
        done = stage(spark, docs, small)
        before, docs = docs, spark.createDataFrame(done.collect(), done.schema)
        out.append((name, [tuple(r) for r in before.collect()], [tuple(r) for r in docs.collect()]))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == before.columns
    return {name: (before, after) for name, before, after in out}


def test_toxicity(spark, small, stages):
    before, after = stages["toxicity"]
    model = toxicity.train(spark.createDataFrame(before, SCHEMA), table(spark, small, "labels"))
    assert Counter(after) == Counter(r for r in before if model.score(r[1] or "") < 0.3)


def test_near_duplicates(stages):
    before, after = stages["simhash_near_dedup"]
    root = list(range(len(before)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    fps = [brute_fingerprint(r[1]) for r in before]
    for i in range(len(before)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i, r in enumerate(before):
        groups[find(i)].append(r)

    def order(r):
        h = 42 if r[1] is None else xxhash.xxh64_intdigest(r[1].encode(), 42)
        return (r[0] is None, r[0] or 0, h - (1 << 64) if h >> 63 else h)

    want = Counter(min(map(order, own)) for own in groups.values())
    assert Counter(map(order, after)) == want and len(after) < len(before) and set(after) <= set(before)


def test_repeats(stages):
    before, after = stages["suffix_array_dedup"]
    left = [kept.decode("utf-8", "ignore") for kept, _ in brute_repeats([(r[1] or "").encode() for r in before], 400)]
    want = Counter((r[0], None if r[1] is None else t, r[2], r[3], len(t)) for r, t in zip(before, left))
    assert Counter(after) == want
    assert any(len(t) < len(r[1] or "") for r, t in zip(before, left))


def test_repeated_passages_of_over_fifty_words(spark):
    """Under 400 bytes, so only the number of words tells them."""
    rng = random.Random(3)

    def prose(n):
        return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(n))

    passage, heads = prose(54), [prose(20) for _ in range(4)]
    rows = [(i, f"{h} {passage}" if i else h, "en", "a", 0) for i, h in enumerate(heads)]
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.repeat_stage(spark, spark.createDataFrame(rows, SCHEMA), "").collect()}
    assert len(passage) < 400 and got == {0: heads[0]} | {i: f"{heads[i]} " for i in (1, 2, 3)}


def test_mixing(stages):
    before, after = stages["source_mixing"]
    size = {r: len((r[1] or "").encode().split()) for r in before}  # bytes.split knows the six ASCII blanks only
    sizes, own = Counter(), defaultdict(list)
    for r in before:
        sizes[r[3]] += size[r]
        own[r[3]].append(r)
    targets, want = brute_targets(sizes), Counter()
    for source, rows in own.items():
        start = int(md5(f"17:{source or ''}".encode()).hexdigest()[:8], 16) / 2**32
        rate = targets[source] / sizes[source] if sizes[source] else 0.0
        rows = sorted(rows, key=lambda r: (size[r], r[0] is not None, r[0] or 0))
        for i, r in enumerate(rows):
            want[r[0], source, size[r]] += math.floor((i + 1) * rate + start) - math.floor(i * rate + start)
    assert Counter((r[0], r[3], len((r[1] or "").encode().split())) for r in after) == +want and set(after) <= set(before)


def test_encoding(stages, tokenizer_file):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_file)
    before, after = stages["bpe_encoding"]
    want = Counter()
    for r in before:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        want[r[0], len(ids), tuple(ids), sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert Counter((k, n, tuple(ids), h) for k, n, ids, h in after) == want
