import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lendlens.llm.bpe import Bpe, PairTree, decode, encode

TEXTS = [
    "", " ", "Hello, World's it'LL", "Σίσυφος ΟΔΟΣ", "a<|endoftext|>b <|startoftext|>", "<|endoftext|><|endoftext", "İ ǅ ß ﬁ Å é",
    "x\x1cy \x1d \x1fz", "q\x85w\u00a0e\u2003r", "½ ² ٣ 123 a1b2", "a" * 700 + "bc" * 90, "\x00\x01 zero​width", "한국어 日本語 🙂🙂 👩‍👩‍👧", "!!!???...",
]


@pytest.fixture(scope="module")
def library(tokenizer_file):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_file)


def test_like_the_library(tokenizer_file, library):
    bpe = Bpe(tokenizer_file)
    want = [library.encode(t, add_special_tokens=False).ids for t in TEXTS]
    ids, ends = bpe.encode_batch(TEXTS)
    assert [x.tolist() for x in np.split(ids, ends[:-1])] == want
    assert bpe.decode_batch(ids, ends).to_pylist() == [library.decode(w, skip_special_tokens=False) for w in want]
    rng = random.Random(3)
    letters = "abcdeéüñß'. ,!1<|σΣ\u0301\u3000"
    for _ in range(300):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 60)))
        assert bpe.encode(text) == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_trees_one_by_one_and_together_agree(tokenizer_file):
    bpe = Bpe(tokenizer_file)
    words = ["thereafter", "a", "ingingtionre", "éèê", "internationalisation"]
    for w in words:
        data = np.frombuffer(w.encode(), np.uint8)
        assert bpe.merge(bpe.symbols(data)) == bpe.encode(w)


def test_pair_tree_yields_leftmost_lowest():
    tree = PairTree([5 * 3 + 0, 2 * 3 + 1, 2 * 3 + 2])
    assert tree.root() % 3 == 1
    tree.update(1, 1 << 62)
    assert tree.root() % 3 == 2


def test_rows(spark, tokenizer_file, library):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "a b", "x"), (3, None, "x"), (3, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = encode(df, tokenizer_file, decoded=True).collect()
    assert len(out) == len(rows)
    assert sorted(r["ids"] for r in out) == sorted(library.encode(t or "", add_special_tokens=False).ids for _, t, _ in rows)
    back = decode(encode(df, tokenizer_file), tokenizer_file).collect()
    assert sorted(r["decoded"] for r in back) == sorted(r["decoded"] for r in out)
    odd = spark.createDataFrame([(1, [0, None, 99999999]), (2, None)], "doc_id long, ids array<int>")
    assert {r["doc_id"]: r["decoded"] for r in decode(odd, tokenizer_file).collect()} == {1: "!", 2: ""}
    assert encode(df.where(F.lit(False)), tokenizer_file).count() == 0


def test_whole_documents(spark, documents, tokenizer_file, library):
    got = {r["doc_id"]: r["ids"] for r in encode(documents, tokenizer_file).collect()}
    for r in documents.collect():
        assert got[r["doc_id"]] == library.encode(r["text"] or "", add_special_tokens=False).ids
