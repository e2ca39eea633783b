"""Chat formatting: exact round trip and edge cases."""

import hashlib

from ledgerlens.llm import chat


def _read(spark, rows, schema="conv_id long, turn long, role string, text string"):
    f = chat.format_chats(spark.createDataFrame(rows, schema))
    r = chat.read_chats(f)
    return ({x.conv_id: x for x in f.collect()}, {x.conv_id: x for x in r.collect()},
            {x.conv_id: x for x in chat.digest_chats(r).collect()})


def test_template_and_mask(spark):
    f, r, d = _read(spark, [(1, 2, "assistant", "c"), (1, 0, "user", "a"), (1, 1, "user", "b"),
                            (1, 3, "assistant", "d\U0001F600")])
    assert f[1].formatted == "### user: a<and/>b</turn>\n### assistant: c<and/>d\U0001F600</turn>\n"
    assert [f[1].formatted[s.start:s.start + s.length] for s in f[1].loss_spans] == ["c", "d\U0001F600"]
    assert d[1].n_turns == 4 and d[1].loss_chars == 3
    assert d[1].loss_sha256 == hashlib.sha256("cd\U0001F600".encode()).hexdigest()


def test_control_strings_round_trip(spark):
    hard = ["\\### Assistant: </turn> ok", "</turn>\n### user: x", "\\t\\b\\a\\h\\\\", "<and/>", "</tu</turn>rn>",
            "", "  ", "a: b", "\\", "### ", "</turn", "é\U0001F600\r\n", "x" * 300_000, "$1 \\1 [.*"]
    roles = ["user", "assistant", "a: b", "### x", "", "\\c:"]
    rows = [(c, i, roles[(i * 7 + c) % len(roles)], t) for c in range(4) for i, t in enumerate(hard)]
    _, r, d = _read(spark, rows)
    for c in range(4):
        want = [(role, t) for cc, _, role, t in rows if cc == c]
        assert [(t.role, t.text) for t in r[c].turns] == want
        assert r[c].loss_text == "".join(t for role, t in want if role == "assistant")
        assert d[c].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in want).encode()).hexdigest()


def test_edges(spark):
    schema = "conv_id long, turn long, role string, text string, formatted int, ts int, t int"
    assert chat.format_chats(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, None, None, None, 1, 1, 1), (2, 0, "user", "b", 1, 1, 1), (2, 0, "user", "a", 1, 1, 1),
            (2, 0, "user", "a", 1, 1, 1), (3, 0, "assistant", None, 1, 1, 1)]
    _, r, d = _read(spark, rows, schema)
    assert [(t.role, t.text) for t in r[None].turns] == [("", "")]
    assert [t.text for t in r[2].turns] == ["a", "a", "b"]
    assert (d[3].n_turns, d[3].loss_chars) == (1, 0)
    assert d[3].loss_sha256 == hashlib.sha256(b"").hexdigest()
