import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from passagework.llm import chat

BITS = st.lists(st.sampled_from(["<s>", "</s>", "[INST]", "[/INST]", " ", "\\", "<", "[", "/", "s>", "INST]", "\n", "x", "é"]), max_size=8).map("".join)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.tuples(BITS, BITS), max_size=4))
def test_round_trip(turns):
    output = "".join(map(chat.render, turns))
    assert [t[:2] for t in chat.parse(output)] == turns
    assert [chat.unescape(output[a:b]) for _, _, a, b in chat.parse(output)] == [t for _, t in turns]


def test_plain_text_is_not_escaped():
    assert chat.render(("user", "a \\ < b")) == "<s>[INST] user [/INST]a \\ < b</s>"


def test_operator(spark):
    rows = [(1, 1, "assistant", "</s>[INST] ok [/INST]"), (1, 0, "user", None), (2, None, None, "x"), (2, 0, "assistant", "y"), (None, 0, "assistant", "z"), (3, 0, "assistant", "s"), (3, 0, "assistant", "s")]
    rows += [(9, i, "assistant" if i % 2 else "user", f"turn {i} é") for i in range(1000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df = df.selectExpr("*", "'clash' as formatted", "1 as segment", "2 as n_turns", "array(1) as loss_spans", "'x' as turns_sha256")
    got = {r["conv_id"]: r for r in chat.read_back(chat.formatted(df)).collect()}
    want = {}
    for c, t, r, x in sorted(rows, key=lambda r: (str(r[0]), -1 if r[1] is None else r[1])):
        want.setdefault(c, []).append((r or "", x or ""))
    assert got.keys() == want.keys()
    for c, turns in want.items():
        loss = "".join(x for r, x in turns if r == "assistant")
        assert got[c]["n_turns"] == len(turns) and got[c]["loss_chars"] == len(loss)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()
        assert got[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.formatted(df).where("conv_id = 9").count() > 1  # segments of bounded size
    assert chat.read_back(chat.formatted(df.limit(0))).count() == 0
