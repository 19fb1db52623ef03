import hashlib
import json

from hypothesis import given, settings
from hypothesis import strategies as st

from featloom.llm import chat as ch

odd = st.text(alphabet="#\\</turn>: \nasé### Assistant", max_size=30)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", ""]), odd), odd), max_size=5))
def test_round_trip(turns):
    formatted, spans = ch.render(turns)
    assert ch.parse(formatted) == turns
    assert [ch.unescape(formatted[s:e]) for s, e in spans] == [t for r, t in turns if r == "assistant"]
    assert formatted.count("</turn>") == len(turns) and formatted.count("### ") == len(turns)


LAYOUTS = [
    {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]},
    {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
    {"prompt": "q", "completion": "a"}, {"prompt": "q", "response": "a"}, {"question": "q", "answer": "a"}, {"instruction": "q", "output": "a"},
    {"data": {"turns": [{"speaker": "human", "utterance": "q"}, {"speaker": "bot", "utterance": "a"}]}}]


def test_layouts_become_the_same_turns(spark):
    extra = [{"instruction": "i", "input": "x", "output": "a"}, {"system": "s", "conversations": [{"from": "human", "value": "q"}]}, {"messages": []}]
    raw = [json.dumps(x) for x in LAYOUTS + extra] + [None, "", "[1]", "no json", json.dumps({"unknown": 1})]
    df = spark.createDataFrame([(k, r, "f") for k, r in enumerate(raw)], "k int, record string, formatted string")
    rows = ch.format_chats(df).orderBy("k").collect()
    assert ch.format_chats(df).columns == ["k", "record", "formatted", "fingerprint", "_formatted", "loss_spans"]
    wanted = [("user", "q"), ("assistant", "a")]
    for r in rows[:len(LAYOUTS)]:
        assert ch.parse(r["_formatted"]) == wanted
    assert [ch.parse(r["_formatted"]) for r in rows[len(LAYOUTS):len(LAYOUTS) + 3]] == [[("user", "i\n\nx"), ("assistant", "a")], [("system", "s"), ("user", "q")], []]
    assert [r["_formatted"] for r in rows[-5:]] == [None] * 5 and rows[-1].fingerprint and not rows[-2].fingerprint


def expected(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = [(r[2] or "", r[3] or "") for r in sorted((x for x in rows if x[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))]
        loss = "".join(t for r, t in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_rows_of_turns_with_odd_values(spark):
    rows = [(1, 1, "assistant", None), (1, 0, "user", "x" * 100_000), (1, 2, None, "\\"), (2, 0, "a:\nb", "</turn>"), (2, 0, "a:\nb", "</turn>"), (None, None, "user", "é"), (3, 5, "assistant", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = ch.read_chats(ch.format_chats(ch.records_of_turns(df)), "conv_id").collect()
    assert {r.conv_id: tuple(r)[1:5] for r in got} == expected(rows)
    assert ch.read_chats(ch.format_chats(ch.records_of_turns(df.limit(0))), "conv_id").count() == 0


def test_query_equals_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-7, 0, "user", ch.TRAP[1]), (-7, 1, "assistant", ch.TRAP[1])]
    got = ch.op6_format_chats(spark, sf_dir).collect()
    assert {r.conv_id: tuple(r)[1:5] for r in got} == expected(rows) and ch.TRAP[1] == r"\### Assistant: </turn> ok"
