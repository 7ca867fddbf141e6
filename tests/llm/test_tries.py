import hashlib
import random
import zlib
from collections import Counter, defaultdict

import xxhash
from pyspark.sql import functions as F

from lendlens.llm import tries
from lendlens.llm.tries import prefix_trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string"


def h(c):
    return zlib.crc32(str(c).encode()) % 9


def base(c):
    return c - (abs(c) % 5) * (1 if c > 0 else -1)


def tie(role, text):
    return xxhash.xxh64_intdigest(text.encode(), xxhash.xxh64_intdigest(role.encode(), 42))


def brute(rows):
    stored = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            t = tie(role, text)
            stored[c].append(((turn is not None, turn or 0), t - (1 << 64) if t >> 63 else t, (role, text)))
    seqs = {c: [x[2] for x in sorted(own)] for c, own in stored.items()}
    rebuilt = {c: tuple(seqs.get(base(c), [])[: h(c)] + seqs[c][h(c) :]) for c in seqs}
    nodes = defaultdict(list)
    for c, seq in rebuilt.items():
        for d in range(len(seq) + 1):
            nodes[seq[:d]].append(c)
    children, leaves, saved = Counter(), Counter(), Counter()
    parents_with = {seq[:-1] for seq in nodes if seq}
    for seq, members in nodes.items():
        own = (len(members) - 1) * len(seq[-1][1].encode()) if seq else 0
        if seq:
            children[seq[:-1]] += 1
        for d in range(len(seq) + 1):
            saved[seq[:d]] += own
            leaves[seq[:d]] += seq not in parents_with
    out = Counter()
    for seq, members in nodes.items():
        ends = ",".join(map(str, sorted(c for c in members if len(rebuilt[c]) == len(seq))))
        parent = min(nodes[seq[:-1]]) if seq else None
        out[(min(members), len(seq), parent, len(members), children[seq], leaves[seq], saved[seq], hashlib.sha256(ends.encode()).hexdigest())] += 1
    return out


def run(df):
    got = prefix_trie(df, base=lambda c: c - c % 5, head=lambda c: F.crc32(c.cast("string")) % 9, most=8)
    assert got.columns == COLUMNS
    return Counter(map(tuple, got.collect()))


def random_rows(seed, conversations, most_turns, words):
    rng = random.Random(seed)
    rows = []
    for _ in range(conversations):
        c = rng.randint(-40, 60)
        rows += [(c, t, rng.choice(["user", "bot", None]), rng.choice(words)) for t in range(rng.randint(1, most_turns))]
    rng.shuffle(rows)
    return rows


def test_against_brute_force(spark):
    for seed, words in enumerate((["a"], ["a", "bb", None, "", "é" * 40])):
        rows = random_rows(seed, 40, 14, words)
        assert run(spark.createDataFrame(rows, SCHEMA)) == brute(rows), seed


def test_repeats_nulls_and_names(spark):
    rows = [
        (1, None, "u", "first"), (1, 0, None, None), (1, 0, "u", "tie"), (1, 0, "u", "tie"), (None, 0, "u", "lost"),
        (5, 0, "u", "x"), (6, 0, "u", "x"), (6, 0, "u", "x"), (-3, 2, "", ""), (2, 7, "u", "é" * 70_000), (3, 7, "u", "é" * 70_000),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows)
    clashing = df.select("*", *[F.lit("x").alias(n) for n in ("depth", "id", "block", "pos", "base", "h", "taken", "own", "any", "c", "p0")])
    assert run(clashing) == want
    assert run(df.where("conv_id IS NULL")) == Counter()
    turnless = next(c for c in range(1, 200) if h(c) > 1 and c % 5)
    alone = [(turnless, 0, "u", "left out")]  # its base does not exist and its own turn is among the first h
    assert run(spark.createDataFrame(alone, SCHEMA)) == brute(alone) == Counter([(turnless, 0, None, 1, 0, 1, 0, hashlib.sha256(str(turnless).encode()).hexdigest())])


def test_long_conversation_spreads_over_blocks(spark):
    rng = random.Random(4)
    rows = [(c, t, "u", rng.choice("ab")) for c in (10, 11, 14) for t in range(1500 if c == 10 else 5)]
    rows += [(12, 0, "u", "same")] * 600  # repeated rows of one conversation
    df = spark.createDataFrame(rows, SCHEMA).repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small sort partitions stay apart, as large ones would
    try:
        placed = tries._products(tries._letters(df, 0), 0)
        assert placed.where("conv_id = 10").agg(F.max("pos")).collect()[0][0] == 1500
        assert run(df) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_a_collision_starts_another_attempt(spark, monkeypatch):
    real, used = tries.lanes, []

    def weak(attempt):
        used.append(attempt)
        return [(3, 2), (5, 2)] if attempt == 0 else real(attempt)

    rows = random_rows(9, 30, 6, list("abcdefgh"))
    df = spark.createDataFrame(rows, SCHEMA)
    monkeypatch.setattr(tries, "lanes", weak)
    assert run(df) == brute(rows) and max(used) == 1
