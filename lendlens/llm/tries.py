"""Prefix trie of conversations that are rebuilt from the head of one and the tail of another, without rebuilding any text.

The fingerprint of a sequence of turns is an element (value, length) of a monoid: (u, m) * (v, n) =
(u + B^m v, m + n) modulo a prime, with one random letter per turn. The fingerprint of a rebuilt prefix is
the product of its base's head and a piece of its own turns, a piece is a quotient of two prefixes, and all prefixes of
stored conversations come from one sorted pass, so only numbers are combined. Texts are read twice: to make letters, and to prove
that turns which share a fingerprint are equal.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import count, groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lendlens.session import settle

_BLOCK_BITS = 33  # monotonically_increasing_id keeps the partition above, the row below
_DIGIT = 6  # bits of an exponent that one table of powers covers
_DIGITS = 7
_BUCKET = 4096  # consecutive ids whose list is one text
_KEY = ["depth", "f0", "f1"]


def lanes(attempt: int) -> list[tuple[int, int]]:
    """(prime, base) of the two lanes of a fingerprint; every attempt has bases of its own."""
    digest = hashlib.sha256(f"lanes {attempt}".encode()).digest()
    return [(p, int.from_bytes(digest[8 * i : 8 * i + 8], "big") % (p - 3) + 2) for i, p in enumerate((2147483647, 2147483629))]


def _table(numbers: list[int]) -> str:
    return "array(" + ",".join(f"{x}L" for x in numbers) + ")"


def _power(prime: int, base: int, exponent: str) -> Column:
    """base ** exponent modulo the prime, from tables of the powers of its digits."""
    out = None
    for d in range(_DIGITS):
        step = pow(base, 1 << (_DIGIT * d), prime)
        powers = _table([pow(step, x, prime) for x in range(1 << _DIGIT)])
        part = F.get(F.expr(powers), F.shiftright(exponent, _DIGIT * d).bitwiseAND(F.lit((1 << _DIGIT) - 1)).cast("int"))
        out = part if out is None else out * part % prime
    return out


def _letters(rows: DataFrame, attempt: int) -> DataFrame:
    """One narrow row per turn: its letters, its UTF-8 bytes and ``tie``, which orders equal turn numbers."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    h = F.xxhash64(F.lit(attempt), role, text)
    (p0, _), (p1, _) = lanes(attempt)
    return rows.select(
        "conv_id", "turn", F.xxhash64(role, text).alias("tie"), F.octet_length(text).cast("long").alias("bytes"),
        (h.bitwiseAND(F.lit((1 << 31) - 1)) % p0).alias("l0"), (F.shiftrightunsigned(h, 32) % p1).alias("l1"),
    )


def _products(letters: DataFrame, attempt: int) -> DataFrame:
    """Every stored turn with its place ``pos`` (from 1) in its conversation and the product ``p0``, ``p1`` of all turns up to it.

    Turns are sorted once over the whole table, so that a conversation of any length spreads over blocks; products are
    made inside a block and multiplied by the product of the conversation's earlier blocks, of which there is at
    most one row per block.
    """
    rows = settle(letters.withColumn("any", F.monotonically_increasing_id()))  # rows equal in everything else are spread by it
    order = ["conv_id", F.col("turn").asc_nulls_first(), "tie", "l0", "l1", "any"]
    numbered = settle(rows.orderBy(*order).withColumn("id", F.monotonically_increasing_id()).drop("any"))
    placed = numbered.withColumn("block", F.shiftright("id", _BLOCK_BITS))
    run = Window.partitionBy("conv_id", "block").orderBy("id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = placed.withColumn("i", F.row_number().over(Window.partitionBy("conv_id", "block").orderBy("id")).cast("long"))
    for k, (p, b) in enumerate(lanes(attempt)):
        placed = placed.withColumn(f"s{k}", F.sum(F.col(f"l{k}") * _power(p, b, "i") % p).over(run) % p)
    inner = settle(placed.withColumn("c", F.sum("bytes").over(run)).drop("l0", "l1"))

    ends = inner.groupBy("conv_id", "block").agg(F.min("id").alias("first"), F.max("i").alias("n"), *[F.max_by(x, "i").alias(x) for x in ("s0", "s1", "c")])
    goes_on = ends.where(F.col("first") == F.shiftleft("block", _BLOCK_BITS)).select("conv_id").distinct()  # one row per block at most
    parts = ends.join(F.broadcast(goes_on), "conv_id")
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("off", F.coalesce(F.sum("n").over(before), F.lit(0)))
    for k, (p, b) in enumerate(lanes(attempt)):
        parts = parts.withColumn(f"b{k}", _power(p, b, "off"))
        parts = parts.withColumn(f"o{k}", F.coalesce(F.sum(F.col(f"s{k}") * F.col(f"b{k}") % p).over(before), F.lit(0)) % p)
    carry = parts.withColumn("oc", F.coalesce(F.sum("c").over(before), F.lit(0))).where("off > 0")
    carry = carry.select("conv_id", "block", "off", "b0", "b1", "o0", "o1", "oc")
    met = inner.join(F.broadcast(carry), ["conv_id", "block"], "left")  # one row per block at most
    return met.select(
        "conv_id", "turn", "tie", "bytes", (F.col("i") + F.coalesce("off", F.lit(0))).alias("pos"),
        *[((F.coalesce(f"o{k}", F.lit(0)) + F.coalesce(f"b{k}", F.lit(1)) * F.col(f"s{k}")) % p).alias(f"p{k}") for k, (p, _) in enumerate(lanes(attempt))],
        (F.col("c") + F.coalesce("oc", F.lit(0))).alias("c"),
    )


def _plans(turns: DataFrame, base: Callable[[Column], Column], head: Callable[[Column], Column], most: int) -> DataFrame:
    """One row per conversation: ``k`` turns of its base's head (``taken``), then its own turns behind the first ``h``; ``total``
    turns in all; the products of the head (``a0``, ``a1``, ``ac``) and of the own turns left out (``z0``, ``z1``, ``zc``)."""
    early = F.when(F.col("pos") <= most, F.struct("pos", "p0", "p1", "c", "bytes"))
    whole = settle(turns.groupBy("conv_id").agg(F.max("pos").alias("n"), F.array_sort(F.collect_list(early)).alias("own")))
    named = whole.withColumns({"base": base(F.col("conv_id")), "h": head(F.col("conv_id")).cast("long")})
    bases = whole.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"), F.col("own").alias("taken"))
    met = named.join(bases, "base", "left").withColumn("k", F.least("h", F.coalesce("n_base", F.lit(0))))
    met = met.withColumn("taken", F.when(F.col("k") > 0, F.slice("taken", F.lit(1), F.col("k").cast("int"))))
    total = F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))
    last, left_out = F.try_element_at("taken", F.lit(-1)), F.get("own", F.col("h").cast("int") - 1)
    zero = F.lit(0).cast("long")
    return met.select(
        "conv_id", "h", "k", "taken", total.alias("total"),
        *[F.coalesce(last[x], zero).alias(y) for x, y in (("p0", "a0"), ("p1", "a1"), ("c", "ac"))],
        *[F.coalesce(left_out[x], zero).alias(y) for x, y in (("p0", "z0"), ("p1", "z1"), ("c", "zc"))],
    )


def _members(turns: DataFrame, plans: DataFrame, most: int, attempt: int) -> DataFrame:
    """One row per prefix of a rebuilt conversation, but the empty one: its fingerprint, the bytes ``c`` of all its turns,
    and the stored turn (``src``, ``pos``) it ends with."""
    of_head = plans.select("conv_id", "total", F.col("base_id").alias("src"), F.explode("taken").alias("t"))
    of_head = of_head.select(
        "conv_id", "total", F.col("t.pos").alias("depth"), F.col("t.p0").alias("f0"), F.col("t.p1").alias("f1"), F.col("t.c").alias("c"),
        F.col("t.bytes").alias("bytes"), "src", F.col("t.pos").alias("pos"),
    )
    met = turns.join(plans.drop("taken"), "conv_id").where("pos > h")

    def product(k: int) -> Column:
        p, b = lanes(attempt)[k]
        back = _table([pow(b, -x, p) for x in range(most + 1)])  # own turns move up by h - k places
        own = F.pmod(F.col(f"p{k}") - F.col(f"z{k}"), F.lit(p))
        return (F.col(f"a{k}") + own * F.expr(f"{back}[int(h - k)]")) % p

    of_tail = met.select(
        "conv_id", "total", F.expr("k + pos - h").alias("depth"), product(0).alias("f0"), product(1).alias("f1"),
        F.expr("ac + c - zc").alias("c"), "bytes", F.col("conv_id").alias("src"), "pos",
    )
    return of_head.unionByName(of_tail)


def _conflicts(rows: DataFrame, turns: DataFrame, members: DataFrame, shared: DataFrame) -> int:
    """The number of nodes whose members end with different texts, as the stored turns they refer to say.

    Members that refer to the same stored turn need no look. Where no node has a conflict, its members are equal as a
    whole: with equal last turns and fingerprints they also agree in the fingerprint one turn shorter.
    """
    mixed = shared.where("mixed").select(*_KEY)
    refs = members.select(*_KEY, F.col("src").alias("conv_id"), "pos").join(mixed, _KEY).distinct()
    named = refs.join(turns.select("conv_id", "pos", "turn", "tie"), ["conv_id", "pos"]).select(*_KEY, "conv_id", "turn", "tie")
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    texts = rows.select(F.col("conv_id").alias("of"), F.col("turn").alias("at"), F.xxhash64(role, text).alias("by"), role.alias("role"), text.alias("text"))
    met = named.join(texts, (named["conv_id"] == texts["of"]) & named["turn"].eqNullSafe(texts["at"]) & (named["tie"] == texts["by"]))
    ends = met.groupBy(*_KEY).agg(*[f(x).alias(f"{n}_{x}") for x in ("role", "text") for n, f in (("low", F.min), ("high", F.max))])
    return ends.where("low_role <> high_role OR low_text <> high_text").count()


def _ends(members: DataFrame, plans: DataFrame) -> DataFrame:
    """Per node the SHA-256 of the ids of the conversations that end there.

    Ids are listed in text per node and ``_BUCKET`` consecutive numbers; a digest has to read its input in order, so a task
    streams the texts of its nodes, sorted, through it and holds a batch of them.
    """
    ended = members.where("depth = total").select(*_KEY, "conv_id")
    none = plans.where("total = 0").select(*[F.lit(0).cast("long").alias(x) for x in _KEY], "conv_id")
    lists = ended.unionByName(none).groupBy(*_KEY, F.floor(F.col("conv_id") / _BUCKET).alias("bucket")).agg(F.array_sort(F.collect_list("conv_id")).alias("ids"))
    texts = lists.select(*_KEY, "bucket", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))
    ordered = texts.repartition(*_KEY).sortWithinPartitions(*_KEY, "bucket")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def stream() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(batch.column(x).to_pylist() for x in (*_KEY, "ids")))

        done: list[tuple] = []
        for key, parts in groupby(stream(), key=lambda r: r[:3]):
            sha = hashlib.sha256(next(parts)[3].encode())
            for part in parts:
                sha.update(b"," + part[3].encode())
            done.append((*key, sha.hexdigest()))
            if len(done) == 10_000:
                yield pa.RecordBatch.from_arrays([*map(pa.array, zip(*done))], [*_KEY, "sha"])
                done = []
        if done:
            yield pa.RecordBatch.from_arrays([*map(pa.array, zip(*done))], [*_KEY, "sha"])

    return ordered.mapInArrow(digest, ", ".join(f"{x} long" for x in _KEY) + ", sha string")


def _nodes(members: DataFrame, plans: DataFrame, shared: DataFrame) -> DataFrame:
    """All nodes but the root's row last: every sum over a subtree is a sum over the members of its top.

    A conversation is the smallest member of its nodes from some depth on; ``x`` is the last depth at which it is not
    (the root's smallest member has -1 there), ``y`` the smallest member there and ``cx`` the bytes up to it. Every member but
    the smallest adds its bytes to ``saved_tokens``, hence a member adds those from the node's depth to ``x``. A leaf is
    counted by its smallest member.
    """
    met = members.select(*_KEY, "conv_id", "c", "total").join(shared.select(*_KEY, "low", "deepest"), _KEY)
    other = F.col("low") != F.col("conv_id")
    at = F.when(other, F.col("depth"))
    known = met.groupBy("conv_id").agg(
        F.max(at).alias("x"), F.max_by("low", at).alias("y"), F.max_by("c", at).alias("cx"),
        F.max(F.when(F.col("depth") == F.col("total"), (~other & (F.col("deepest") == F.col("total"))).cast("int"))).alias("leaf"),
    )
    least, longest = plans.agg(F.min("conv_id"), F.max("total")).collect()[0]
    if least is None:
        least, longest = 0, 0
    own = settle(plans.select("conv_id", "total").join(known, "conv_id", "left").select(
        "conv_id", "total",
        F.coalesce("x", F.when(F.col("conv_id") == least, -1).otherwise(0)).cast("long").alias("x"),
        F.coalesce("y", F.lit(least)).cast("long").alias("y"), F.coalesce("cx", F.lit(0)).cast("long").alias("cx"),
        F.when(F.col("total") == 0, 0).otherwise(F.coalesce("leaf", F.lit(1))).cast("long").alias("leaf"),
    ))
    sums = [
        F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"),
        F.max(F.when(F.col("x") < F.col("depth"), F.when(F.col("x") < F.col("depth") - 1, F.col("conv_id")).otherwise(F.col("y")))).alias("parent_conv_id"),
        F.sum(((F.col("x") <= F.col("depth")) & (F.col("depth") < F.col("total"))).cast("long")).alias("n_children"),
        F.sum("leaf").alias("n_leaves"),
        F.sum(F.when(F.col("x") >= F.col("depth"), F.col("cx") - F.col("c") + F.col("bytes")).otherwise(0)).alias("saved_tokens"),
    ]
    below = members.select(*_KEY, "conv_id", "c", "bytes").join(own, "conv_id").groupBy(*_KEY).agg(*sums)
    top = own.withColumns({x: F.lit(0).cast("long") for x in (*_KEY, "c", "bytes")}).groupBy(*_KEY).agg(*sums)
    top = top.withColumns({"parent_conv_id": F.lit(None).cast("long"), "n_leaves": F.lit(1).cast("long") if longest == 0 else F.col("n_leaves")})
    return below.unionByName(top)


def prefix_trie(
    df: DataFrame, base: Callable[[Column], Column], head: Callable[[Column], Column], most: int, conv_id: str = "conv_id",
    turn: str = "turn", role: str = "role", text: str = "text",
) -> DataFrame:
    """One row per node of the trie of rebuilt conversations, the root included.

    Conversation c becomes the first ``head(c)`` turns of conversation ``base(c)`` (fewer if it has fewer, none if there is
    none) and its own turns behind the first ``head(c)``; ``head`` gives 0 to ``most``. Columns: ``conv_id`` (smallest
    member) and ``depth``, which name the node, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves`` and
    ``saved_tokens`` of the subtree, ``ends_sha256``. Fingerprints group the prefixes; a node whose members end with different
    stored turns has their roles and texts compared in full, and if any differ, all is done again with other letters. So the result is exact.

    Work and rows grow with the turns, whatever the shape of the trie: no pairs of nodes and ancestors are made, and neither a
    conversation nor a node with a third of all rows is gathered in a task. Texts are shuffled only for the
    comparison, and only those of turns in question.

    Turns are ordered by ``turn`` (null first), equal turns by the xxhash64 of role and text; repeated rows are repeated
    turns. Null roles and texts are empty; rows without ``conv_id`` take no part; other columns are not read. An empty table gives an
    empty result.
    """
    rows = df.select(df[conv_id].cast("long").alias("conv_id"), df[turn].alias("turn"), df[role].alias("role"), df[text].alias("text"))
    rows = rows.where("conv_id IS NOT NULL")
    for attempt in count():
        turns = settle(_products(_letters(rows, attempt), attempt))
        plans = settle(_plans(turns, base, head, most).withColumn("base_id", base(F.col("conv_id"))))
        members = settle(_members(turns, plans, most, attempt))
        nodes = members.groupBy(*_KEY).agg(
            F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("low"), F.max("total").alias("deepest"),
            *[F.min(x).alias(f"min_{x}") for x in ("src", "pos")], *[F.max(x).alias(f"max_{x}") for x in ("src", "pos")],
        )
        shared = settle(nodes.where("n > 1").select(*_KEY, "low", "deepest", F.expr("min_src < max_src OR min_pos < max_pos").alias("mixed")))
        if not _conflicts(rows, turns, members, shared):
            break
    named = _nodes(members, plans, shared).join(_ends(members, plans), _KEY, "left")
    return named.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("sha", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
