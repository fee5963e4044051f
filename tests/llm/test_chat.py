import hashlib

import pyspark.sql.functions as F
import pytest
from hypothesis import given, settings, strategies as st

from crosstally.llm import chat

SAID = r"\### Assistant: </turn> ok"
HARD = st.text(alphabet=st.sampled_from(list("\\#<>/turn: \né😀a")), max_size=40)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(HARD, HARD), max_size=5))
def test_template_is_reversible(turns):
    pieces = [chat.render(r, t) for r, t in turns]
    assert list(chat.parse("".join(p[0] for p in pieces))) == turns
    assert all(chat.unescape(p[a:b]) == t for (p, a, b), (_, t) in zip(pieces, turns))


def test_fold():
    e = [("open", "assistant", "a"), ("delta", None, "b"), ("regenerate", None, None), ("delta", None, "c"), ("delta", "user", None), ("delta", None, "d")]
    assert chat.fold(e) == ("assistant", "cd")
    assert chat.fold(e + [("edit", None, "E"), ("delta", None, "!")]) == ("assistant", "E!")
    assert chat.fold(e + [("delete", None, None)]) is None
    assert chat.fold([("delta", None, "x")]) == ("", "x")
    with pytest.raises(ValueError):
        chat.fold([("other", None, None)])


def brute(rows):
    out = {}
    for c, _, r, t in sorted(rows, key=lambda x: (repr(x[0]), x[1] is not None, x[1] or 0)):
        out.setdefault(c, []).append((r or "", t or ""))
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return sorted(((c, len(m), digest("".join(f"{r}\n{t}\n" for r, t in m)), sum(len(t) for r, t in m if r == "assistant"),
                    digest("".join(t for r, t in m if r == "assistant")), sum(len(chat.render(r, t)[0]) for r, t in m)) for c, m in out.items()), key=repr)


def run(spark, rows):
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, seq int, message string")
    return sorted(map(tuple, chat.read_back(chat.format_log(chat.events_of(frame))).collect()), key=repr)


def test_conversations(spark):
    rows = [(-7, 0, "user", SAID), (-7, 1, "assistant", SAID), (1, 5, "assistant", "é😀" * 10000), (1, 2, "user", None), (1, 3, None, "x"), (2, 0, "system", ""),
            (None, 0, "user", "n"), (None, 1, "assistant", "m"), (3, None, "user", "first"), (3, 0, "assistant", "####"), (4, 1, "assistant", "same"), (4, 1, "assistant", "same")]
    rows += [(9, i, ["user", "assistant"][i % 2], f"t{i} \\ # <") for i in range(700)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_ties_in_a_turn_are_separate_messages(spark):
    (got,) = run(spark, [(1, 0, "user", "b" * 9000), (1, 0, "user", "a"), (1, 0, "assistant", "c")])
    assert got[1] == 3 and got[3] == 1


def test_log_with_edits(spark):
    log = [(1, 0, "m", 0, "open", "user", "q"), (1, 1, "m", 3, "delta", None, "wor"), (1, 1, "m", 1, "open", "assistant", "bad"), (1, 1, "m", 2, "regenerate", None, None),
           (1, 1, "m", 4, "delta", None, "ld"), (1, 0, "m", 9, "edit", None, "Q"), (1, 2, "m", 1, "open", "user", "gone"), (1, 2, "m", 2, "delete", None, None)]
    df = spark.createDataFrame(log, "conv_id long, turn long, message string, seq long, kind string, role string, text string")
    got = chat.format_log(df).orderBy("turn").collect()
    assert [r.formatted for r in got] == ["### user: Q</turn>\n", "### assistant: world</turn>\n"]
    assert got[0].loss_begin is None and got[1].formatted[got[1].loss_begin:got[1].loss_end] == "world"


def test_detours_are_folded_away(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b" * 9000), (1, 2, "assistant", None), (2, 0, None, ""), (None, None, "user", "x"), (2, 1, "assistant", SAID)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    log = chat.events_of(frame)
    longer = chat.with_detours(log)
    assert {r.kind for r in longer.select("kind").distinct().collect()} == {"open", "delta", "edit", "regenerate", "delete"}
    assert longer.count() == log.count() + 5 * len(rows)
    plain, undone = (sorted((tuple(r) for r in chat.read_back(chat.format_log(x)).collect()), key=repr) for x in (log, longer))
    assert plain == undone == brute(rows)
    assert chat.with_detours(log.limit(0)).count() == 0
