import datetime as dt

import pytest
from pyspark.sql import functions as F

from weft.operators.agent_log import (
    classify_commands,
    command_decision,
    default_block_rules,
    event_line,
    flag_allowed,
    match_approvals,
    session_summary,
    tool_payload,
    with_tool_call,
)
from weft.operators import agent_log


def _calls(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i INT, t STRING")
    return [(r.call_status, r.cmd) for r in with_tool_call(df, "t").orderBy("i").collect()]


def test_tool_call_extraction(spark):
    ok = '<tool_call>{"name":"shell","args":{"cmd":"ls"}}</tool_call>'
    got = _calls(spark, [
        "no call here",
        ok + ' then <tool_call>{"name":"shell","args":{"cmd":"rm -rf /"}}</tool_call>',
        '<tool_call>\n{"name": "shell",\n "args": {"cmd": "echo {a}"}}\n</tool_call>',
        '<tool_call>{"name":"shell","args":{"cmd":"a\nb"}}</tool_call>',
        "<tool_call>{'name':'shell','args':{'cmd':'id'}}</tool_call>",
        '<tool_call>{"name":"shell","args":{"cmd":"x"}} trailing</tool_call>',
        '<tool_call>{"name":"shell","args":{"cmd":"x"}} junk}</tool_call>',
        '<tool_call>{"name":"shell","args":{"cmd":"x"}}{"a":1}</tool_call>',
        '<tool_call>{"name":"shell"}</tool_call>',
        '<tool_call>{"name":"shell","args":{"cmd":null}}</tool_call>',
        '<tool_call>{"name":"other","args":{"cmd":"whoami"}}</tool_call>',
        '<tool_call>{"args":{"cmd":"é ü"}}</tool_call>',
    ])
    # no closing brace right before the tag: the pattern does not match at all
    assert got == [("none", None), ("ok", "ls"), ("ok", "echo {a}"), ("malformed", None),
                   ("malformed", None), ("none", None), ("malformed", None), ("malformed", None),
                   ("malformed", None),
                   ("malformed", None), ("ok", "whoami"), ("ok", "é ü")]


def _rules(spark, cmds):
    rules = spark.createDataFrame(default_block_rules(), "rule_id INT, pattern STRING")
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cmds)], "i INT, cmd STRING")
    return [r.block_rule for r in classify_commands(df, "cmd", rules).orderBy("i").collect()]


BLOCKED = ["rm -rf /", "rm -rfv /\n", "mkfs.ext4 x", "dd if=a of=/dev/b", "sudo reboot", "chmod -R 0777 /"]
FREE = ["rm -rf /etc", "rm -r -f /", "asphalt", "chmod 777 /tmp", "dd if=a\nof=/dev/b"]


def test_hard_block_rules(spark):
    assert _rules(spark, BLOCKED) == [1, 1, 2, 3, 5, 7]
    assert _rules(spark, FREE) == [None] * 5


def test_hard_block_rules_by_index(spark, monkeypatch):
    monkeypatch.setattr(agent_log, "MAX_INLINE_RULES", 2)
    assert _rules(spark, BLOCKED + FREE) == [1, 1, 2, 3, 5, 7] + [None] * 5


@pytest.mark.parametrize("n", [3, 300, 20_000])
def test_rules_of_any_number_have_one_schema(spark, n):
    rules = [(10 * i + 5, rf"\bcmd{i}\b.*x") for i in range(n - 2)] + [(3, r"^\d+$"), (4, r"cmd1\s")]
    table = spark.createDataFrame(rules, "rule_id BIGINT, pattern STRING")
    cmds = ["cmd1 x", "cmd1 y", "run cmd0 with x", "42", "cmd2", "cmd2 x cmd0 x", "é cmd2 x", None, ""]
    df = spark.createDataFrame(list(enumerate(cmds)), "i INT, cmd STRING")
    out = classify_commands(df, "cmd", table)
    rows = [r.block_rule for r in out.orderBy("i").collect()]
    small = n == 3
    assert out.schema["block_rule"].dataType.simpleString() == "bigint"
    assert rows == [4, 4, 5, 3, None, 5, None if small else 25, None, None]
    flags = [r.allowed for r in flag_allowed(df, "cmd", table.select("pattern")).orderBy("i").collect()]
    assert flags == [r is not None for r in rows]


def test_python_patterns_are_written_for_java(spark):
    import re

    from weft.operators.rules import check_pattern, java_pattern, required_literals

    cases = {  # pattern: texts that match, texts that don't, a string every match holds
        r"(?P<my_name>ls)\s+-l": (["ls -l", "x ls  -l"], ["ls-l"], ["-l", "ls"]),
        r"(?P<q>['\"]).*?(?P=q)1": (["'a'1", '""1'], ["'a\"1"], ["1"]),
        r"a{,2}b$": (["b", "aab"], ["ba"], ["b"]),
        r"end\Z": (["the end"], ["end\n"], ["end"]),
        r"[[a]x": (["[x", "ax"], ["x"], ["x"]),
        r"[]a]b": (["]b", "ab"], ["b"], ["b"]),
        r"[^]a]b": (["xb"], ["]b", "ab"], ["b"]),
        r"[a&&b]c": (["&c", "ac"], ["c"], ["c"]),
        r"foo(?#note)bar": (["foobar"], ["foo bar"], ["foobar"]),
        r"(?i)Rm": (["rm", "RM"], ["r"], []),
        r"rm\b -rf": (["rm -rf"], ["rmx -rf"], ["rm -rf"]),
        r"(abc|xyz)e?": (["abc", "xyze"], ["abe"], []),
        r"(abc|abd)e?": (["abc", "abd"], ["abe"], ["ab"]),
        r"(?:xyz)+q": (["xyzxyzq"], ["xyq"], ["xyz", "q"]),
    }
    for p, (yes, no, literal) in cases.items():
        check_pattern(spark, p)
        df = spark.createDataFrame([(t,) for t in yes + no], "t STRING")
        got = [r[0] for r in df.select(F.rlike("t", F.lit("(?d)" + java_pattern(p)))).collect()]
        assert got == [True] * len(yes) + [False] * len(no), p
        assert got == [re.search(p, t) is not None for t in yes + no], p
        assert required_literals(p) == literal, p
    for bad in ("(", "a{2,1}", r"(a)(?(1)b|c)", "[z-a]"):
        with pytest.raises(ValueError):
            check_pattern(spark, bad)


def test_non_ascii_uses_unicode_classes(spark):
    # U+2003 EM SPACE is \s for Python; the Unicode matcher sees it too.
    assert _rules(spark, ["rm -rf /", "rm -rf / x"]) == [1, 1]


def test_decisions(spark):
    rules = spark.createDataFrame(default_block_rules(), "rule_id INT, pattern STRING")
    allow = spark.createDataFrame([(r"^ls\b",), (r"^rm\b",)], "pattern STRING")
    df = spark.createDataFrame([(0, "rm -rf /"), (1, "ls -la"), (2, "cat x")], "i INT, cmd STRING")
    c = flag_allowed(classify_commands(df, "cmd", rules), "cmd", allow)
    rows = c.select("i", command_decision("block_rule", "allowed", "allow").alias("a"),
                    command_decision("block_rule", "allowed", "dry-run").alias("d"),
                    command_decision("block_rule", "allowed", "approve").alias("p"),
                    command_decision("block_rule", "allowed", "weird").alias("u")).orderBy("i").collect()
    assert [tuple(r)[1:] for r in rows] == [
        ("blocked", "blocked", "blocked", "blocked"),
        ("auto_run", "skipped", "needs_approval", "skipped"),
        ("needs_approval", "skipped", "needs_approval", "skipped")]


def test_approvals_window(spark):
    t0 = dt.datetime(2024, 1, 1, 12, 0, 0)
    calls = spark.createDataFrame([(1, 1, t0), (2, 2, t0), (3, 3, t0), (4, 4, t0), (5, 5, t0)],
                                  "event_id LONG, session_id LONG, ts TIMESTAMP")
    s = lambda k: t0 + dt.timedelta(seconds=k)
    decs = spark.createDataFrame([
        (11, 1, s(299), True), (12, 2, s(300), False), (13, 3, s(301), True),
        (15, 5, s(10), False), (16, 5, s(5), True), (17, 5, s(-1), True)],
        "event_id LONG, session_id LONG, ts TIMESTAMP, decision BOOLEAN")
    out = {r.event_id: (r.decision_id, r.approved, r.outcome)
           for r in match_approvals(calls, decs, timeout_s=300).collect()}
    assert out == {1: (11, True, "approved"), 2: (12, False, "rejected"), 3: (None, False, "timed_out"),
                   4: (None, False, "timed_out"), 5: (16, True, "approved")}


def test_tool_payload(spark):
    df = spark.createDataFrame([("", "", 3), ("", "boom", 1), ("o" * 9000, "", 0)],
                               "so STRING, se STRING, rc INT")
    got = [r.p for r in df.select(tool_payload("so", "se", "rc").alias("p")).collect()]
    assert got[0] == "[exit 3]"
    assert got[1] == "\n[stderr]\nboom"
    assert len(got[2]) == 8000


def test_event_line_and_summary(spark):
    t = dt.datetime(2024, 1, 1)
    ev = spark.createDataFrame([
        (1, 1, t, "model", "hi", None, None, None, None, 1),
        (1, 2, t, "tool_call", None, "ls", None, None, None, 1),
        (1, 3, t, "tool_result", None, "ls", "out", "err", 0, 1),
        (1, 4, t, "done", "bye", None, None, None, None, 1)],
        "session_id LONG, event_id LONG, ts TIMESTAMP, kind STRING, text STRING, cmd STRING, "
        "stdout STRING, stderr STRING, return_code INT, iteration INT")
    lines = [r.l for r in ev.orderBy("event_id").select(event_line(
        "kind", "text", "cmd", "stdout", "stderr", "return_code", "iteration").alias("l")).collect()]
    assert lines == ["[model #1] hi", "[tool_call #1] $ ls", "[tool_result rc=0]\nout\n[stderr]\nerr", "■ bye"]
    s = session_summary(ev).first()
    assert (s.iterations, s.calls, s.results_ok, s.final_kind) == (1, 1, 1, "done")


def test_blocked_is_never_auto_run(spark):
    import random

    rng = random.Random(2)
    parts = ["rm", "-rf", "/", "ls", "mkfs.ext4", "dd", "of=/dev/sda", "reboot", "chmod", "777", "x", "|", ";"]
    cmds = [" ".join(rng.choice(parts) for _ in range(rng.randint(1, 6))) for _ in range(300)]
    rules = spark.createDataFrame(default_block_rules(), "rule_id INT, pattern STRING")
    allow = spark.createDataFrame([(".*",)], "pattern STRING")   # everything allow-listed
    df = spark.createDataFrame([(c,) for c in cmds], "cmd STRING")
    out = flag_allowed(classify_commands(df, "cmd", rules), "cmd", allow).select(
        "block_rule", command_decision("block_rule", "allowed", "allow").alias("d")).collect()
    assert all(r.d == "blocked" for r in out if r.block_rule is not None)
    assert all(r.d == "auto_run" for r in out if r.block_rule is None)


def test_block_rules_match_python_re_on_random_commands(spark):
    import os
    import re

    from hypothesis import HealthCheck, given, settings
    from hypothesis import strategies as st

    from weft.operators.agent_log import HARD_BLOCKED

    parts = ["rm", " ", "-rf", "-r", "-f", "/", "/etc", "\n", "\r", "\t", " ", " ", "mkfs", ".ext4",
             "dd", "if=a", "of=/dev/sda", "reboot", "halt", "chmod", "-R", "777", "0777", ":(){ :|:& };:",
             ">", "/dev/sdb", "x", "é", "_"]

    def py_rule(cmd):
        for i, p in enumerate(HARD_BLOCKED):
            if re.search(p, cmd):
                return i + 1
        return None

    rules = spark.createDataFrame(default_block_rules(), "rule_id INT, pattern STRING")

    @settings(max_examples=int(os.environ.get("WEFT_EXAMPLES", "5")), deadline=None,
              suppress_health_check=list(HealthCheck))
    @given(st.lists(st.lists(st.sampled_from(parts), max_size=8).map("".join), min_size=1, max_size=80))
    def check(cmds):
        df = spark.createDataFrame([(i, c) for i, c in enumerate(cmds)], "i INT, cmd STRING")
        got = [r.block_rule for r in classify_commands(df, "cmd", rules).orderBy("i").collect()]
        assert got == [py_rule(c) for c in cmds]

    check()


@pytest.mark.parametrize("out,err,code,want", [
    (None, None, -2, "[exit -2]"), ("a", "", 0, "a"), ("a", "b", 1, "a\n[stderr]\nb"), ("\n", None, 0, "\n"),
    ("x" * 20000, "e", 0, "x" * 8000), ("", "é" * 20000, 0, "\n[stderr]\n" + "é" * 7990),
    ("😀" * 7995, "bb", 0, "😀" * 7995 + "\n[std"), ("ü" * 8000, "", 0, "ü" * 8000), ("", "", 130, "[exit 130]"),
])
def test_tool_payload_rows(spark, out, err, code, want):
    df = spark.createDataFrame([(out, err, code)], "o STRING, e STRING, rc INT")
    assert df.select(tool_payload("o", "e", "rc").alias("p")).first().p == want


def test_event_lines_by_kind(spark):
    """Hand-written (event, line) pairs; an unknown kind keeps all its fields."""
    rows = [(1, "start", "go", None, None, None, None, 0, "▶ go"),
            (2, "tool_call", None, "ls", None, None, None, 2, "[tool_call #2] $ ls"),
            (3, "tool_result", None, "ls", "a", "", 0, 2, "[tool_result rc=0]\na"),
            (4, "done", "é", None, None, None, None, 3, "■ é"),
            (5, "odd", "t", "ls", None, None, 1, 3, '{"kind":"odd","text":"t","cmd":"ls","return_code":1,"iteration":3}')]
    df = spark.createDataFrame([r[:-1] for r in rows], "i INT, kind STRING, text STRING, cmd STRING, stdout STRING, "
                                                       "stderr STRING, return_code INT, iteration INT")
    got = [r.l for r in df.orderBy("i").select(event_line(
        "kind", "text", "cmd", "stdout", "stderr", "return_code", "iteration").alias("l")).collect()]
    assert got == [r[-1] for r in rows]


def test_null_sessions_approve_nothing(spark):
    from datetime import datetime, timedelta

    from weft.operators.agent_log import match_approvals

    t = datetime(2024, 1, 1)
    calls = spark.createDataFrame([(1, None, t), (2, "a", t)], "event_id long, session_id string, ts timestamp")
    yes = spark.createDataFrame([(3, None, t + timedelta(seconds=1), True), (4, "a", t + timedelta(seconds=1), True)],
                                "event_id long, session_id string, ts timestamp, decision boolean")
    got = {r["event_id"]: r["outcome"] for r in match_approvals(calls, yes).collect()}
    assert got == {1: "timed_out", 2: "approved"}


def test_messages_are_mapped_by_name(spark):
    from weft.operators.records import canonical_json, to_record

    df = spark.sql("SELECT array(named_struct('content', 'hello', 'name', 'n', 'role', 'user')) AS messages")
    line = to_record(df).select(canonical_json().alias("l")).first()["l"]
    assert line == '{"messages":[{"role":"user","content":"hello","name":"n"}]}'


def test_required_words_stand_alone_in_every_match():
    from weft.operators.rules import required_words

    cases = {r"^order\s12\b": ["12", "order"], r"order\s12\b": ["12"], r"^order\s12": ["order"], r"x*foo bar\b": ["bar"],
             r"(?i)^rm\b": [], r"^(rm)\s+-rf(\s|$)": ["rf", "rm"], r"\ba(b|c)\b": [], r"^a\B-": [], r"(?:^|\s)ls(?!x)": [],
             r"(\sfoo bar\s)+": ["bar", "foo"], r"^a\s*b$": [], r"\bé1\b": ["1"], r"^[ -/]b[;]": ["b"], r"^[a ]b\b": []}
    assert {p: required_words(p) for p in cases} == cases


def test_rules_of_few_digits_meet_few_commands(spark):
    """a rule for a number meets the commands with that number, not all that share its digits."""
    from weft.operators.rules import NOT_WORD, read_rules
    from weft.operators.substring_index import candidates

    rules = spark.range(3000).select("id", F.concat(F.lit(r"^order\s"), F.col("id").cast("string"), F.lit(r"\b")).alias("p"))
    cmds = spark.range(3000).select(F.concat(F.lit("order "), F.col("id").cast("string"), F.lit(" at x")).alias("cmd"))
    read = read_rules(rules, "id", "p")
    assert candidates(cmds, read, "cmd", "_parts", [], "_words", NOT_WORD).count() == 3000
    out = classify_commands(cmds, "cmd", rules.withColumnsRenamed({"id": "rule_id", "p": "pattern"}))
    assert out.where(F.split("cmd", " ")[1].cast("long") == F.col("block_rule")).count() == 3000
