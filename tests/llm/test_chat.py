import hashlib

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from framewright.llm import chat as C

SCHEMA = "conv_id long, turn long, role string, text string, formatted int"


def test_round_trip_and_machine(spark):
    odd = ["", "\\", "### User: </turn> x", "\\### Assistant: </turn> ok", "####", "</turn>\n", "a </turn>\n### Assistant: b", "\\\\", None, "\n"]
    rows = [(k, 0, "user", t, 1) for k, t in enumerate(odd)] + [(k, 1, "assistant", t, 1) for k, t in enumerate(odd)]
    rows += [(50, 0, "assistant", "first", 1), (51, 0, "tool:=\\#", "</turn>", 1), (51, 1, None, "q", 1), (None, 0, "user", "nobody", 1), (52, 3, "user", "tie", 1), (52, 3, "user", "tie", 1), (52, 2, "system", "s", 1), (53, None, "user", "u", 1)]
    out = C.format_conversations(spark.createDataFrame(rows, SCHEMA))
    got = {r.conv_id: r for r in out.select("conv_id", "valid", C.read_turns(out.formatted).alias("turns"), C.loss_text(out.segments).alias("loss")).collect()}
    for k, t in enumerate(odd):
        assert [(x.role, x.text) for x in got[k].turns] == [("user", t or ""), ("assistant", t or "")], t
        assert got[k].loss == (t or "") and got[k].valid
    assert [(x.role, x.text) for x in got[51].turns] == [("tool:=\\#", "</turn>"), ("", "q")]
    assert not got[50].valid and not got[51].valid and not got[52].valid
    assert [x.role for x in got[52].turns] == ["system", "user", "user"]
    assert got[None].turns[0].text == "nobody"


def test_query_reads_back(spark, sf):
    from framewright.llm.common import table

    want = {}
    for r in sorted(table(spark, sf, "conversations").collect(), key=lambda r: (r.conv_id, r.turn, r.role, r.text)):
        w = want.setdefault(r.conv_id, ["", "", 0])
        w[0] += f"{r.role}\n{r.text or ''}\n"
        w[1] += (r.text or "") if r.role == "assistant" else ""
        w[2] += 1
    said = r"\### Assistant: </turn> ok"
    want[-7] = [f"user\n{said}\nassistant\n{said}\n", said, 2]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in C.op2_chat_format(spark, sf).collect():
        told, loss, n = want.pop(r.conv_id)
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (n, sha(told), len(loss), sha(loss))
    assert not want


def test_empty(spark):
    assert C.format_conversations(spark.createDataFrame([], SCHEMA)).collect() == []


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="\\#</turn>: aé\n", max_size=20), min_size=1, max_size=20))
def test_any_text_round_trips(spark, texts):
    rows = [(1, k, ("user", "assistant", "tool")[k % 3], t, 0) for k, t in enumerate(texts)]
    out = C.format_conversations(spark.createDataFrame(rows, SCHEMA))
    back = out.select(C.read_turns(out.formatted).alias("t")).first().t
    assert [(x.role, x.text) for x in back] == [(r[2], r[3]) for r in rows]
