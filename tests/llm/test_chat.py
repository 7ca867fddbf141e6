from hypothesis import given, settings
from hypothesis import strategies as st

from lendlens.llm.chat import escape, format_conversations, marked, read_back, read_turns, render_spans, unescape

NASTY = st.lists(st.sampled_from([*"\\<|>tende[]/ \n", "é", "<|end|>", "<|turn|>", "<|text|>", "probe"]), max_size=8).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(NASTY, NASTY), max_size=5))
def test_turns_come_back(turns):
    text, spans = render_spans(turns, marked)
    assert read_turns(text) == turns
    for (_, own), s in zip(turns, spans):
        assert unescape(text[s["text_start"] : s["text_end"]]) == own and not s["rewritten"]
    assert [s["start"] for s in spans] == [0, *(s["end"] for s in spans)][: len(spans)]


def test_escape_leaves_no_mark():
    assert "<|" not in escape("<|<\\|<|\\<|") and unescape(escape("<|<\\|<|\\<|")) == "<|<\\|<|\\<|"


def test_rewritten_history_is_found():
    def forgetful(turns):
        return "".join(f"[{r}]{t if i == len(turns) - 1 else '...'}\n" for i, (r, t) in enumerate(turns))

    _, spans = render_spans([("a", "one"), ("b", "two"), ("a", "three")], forgetful)
    assert [s["rewritten"] for s in spans] == [True, True, False]
    assert spans[0]["start"] == spans[1]["text_end"] == -1 and spans[2]["text_start"] >= 0


def test_conversations(spark):
    rows = [
        (1, 1, "assistant", "b"), (1, 0, "user", "a"), (2, 0, None, None), (None, 3, "assistant", "x<|end|>"),
        (1, 1, "assistant", "b"), (3, None, "user", "first"), (3, 0, "assistant", "é🙂" * 5000),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {r["conv_id"]: r for r in read_back(format_conversations(df)).collect()}
    turns = {k: [tuple(t) for t in r["turns"]] for k, r in out.items()}
    assert turns[1] == [("user", "a"), ("assistant", "b"), ("assistant", "b")] and out[1]["loss_text"] == "bb"
    assert turns[2] == [("", "")] and out[2]["loss_text"] == ""
    assert turns[None] == [("assistant", "x<|end|>")] and out[None]["loss_text"] == "x<|end|>"
    assert turns[3][0] == ("user", "first") and out[3]["loss_text"] == "é🙂" * 5000
    assert read_back(format_conversations(df.limit(0))).count() == 0


def test_keys_of_any_type_and_clashing_names(spark):
    for kind, key in (("smallint", 3), ("string", "x"), ("date", None), ("decimal(9,2)", None), ("double", 1.5)):
        rows = [(key, 0, "user", "a", "s"), (key, 1, "assistant", "b", "s")]
        df = spark.createDataFrame(rows, f"conv_id {kind}, turn int, role string, text string, spans string")
        out = read_back(format_conversations(df.withColumns({"formatted": df["text"], "turns": df["turn"]}))).collect()
        assert [(r["conv_id"], r["loss_text"], len(r["turns"])) for r in out] == [(key, "b", 2)]


def test_query_columns(spark, small):
    """The query's digests against a plain version."""
    from hashlib import sha256
    from itertools import groupby

    from lendlens.llm.common import table
    from lendlens.llm.queries import QUERIES

    trap = "</s>[INST] ok [/INST]"
    rows = [tuple(r) for r in table(spark, small, "conversations").select("conv_id", "turn", "role", "text").collect()]
    rows = sorted([*rows, (-1, 0, "user", trap), (-1, 1, "assistant", trap)])
    got = {r["conv_id"]: r for r in QUERIES["op5_chat"](spark, small).collect()}
    want = {c: [(r or "", t or "") for _, _, r, t in own] for c, own in groupby(rows, key=lambda r: r[0])}
    assert got.keys() == want.keys()
    for c, turns in want.items():
        loss, mine = "".join(t for r, t in turns if r == "assistant"), got[c]
        assert mine["n_turns"] == len(turns) and mine["turns_sha256"] == sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (mine["loss_chars"], mine["loss_sha256"]) == (len(loss), sha256(loss.encode()).hexdigest())
        assert mine["formatted_chars"] == len(marked(turns))
