import datetime as dt

from mnemora.llm import conversations as c

T = dt.datetime(2025, 1, 1)
MESSAGES = "id string, thread_id string, role string, content string, sent_at timestamp, created_at timestamp, conversation string"


def _run(spark, rows, sessions, partitions=None):
    roles = spark.createDataFrame([("user", "user"), ("bot", "assistant"), ("system", "system")], "alias string, role string")
    s = spark.createDataFrame([(x,) for x in sessions], "thread_id string")
    m = spark.createDataFrame([(*r, "clash") for r in rows], MESSAGES)
    return {r["thread_id"]: r for r in c.conversations(s, m, roles).collect()}, s, m, roles


def _turns(thread, roles, start=0):
    return [(f"{thread}{i}", thread, r, "x", T + dt.timedelta(minutes=start + i), None) for i, r in enumerate(roles)]


def test_automaton_and_edge_cases(spark):
    rows = [
        *_turns("good", ["user", "bot", "system", "user", "bot"]),
        *_turns("twice", ["user", "user", "bot"]),
        *_turns("openend", ["user", "bot", "user"]),
        *_turns("answers", ["bot", "user", "bot"]),
        *_turns("onlysystem", ["system"]),
        ("b0", "blank", "user", "　 ", T, None),
        ("b1", "blank", "bot", "x", T + dt.timedelta(1), None),
        ("n0", "notime", "user", "x", None, None),
        ("n1", "notime", "bot", "x", T, None),
        ("u0", "unknown", "user", "x", T, None),
        ("u1", "unknown", "observer", "x", T + dt.timedelta(1), None),
        ("p0", " padded\n", "user", "x", T, None),
        ("p1", "mem://session/padded/timeline", "bot", "x", None, T + dt.timedelta(1)),
        ("x0", None, "user", "x", T, None),
        ("x1", "  ", "user", "x", T, None),
        *_turns("nosession", ["user", "bot"]),
    ]
    rows += [r for r in rows if r[0] == "good0"]  # redelivered
    got, s, m, roles = _run(spark, rows, ["good", "twice", "openend", "answers", "onlysystem", "blank", "notime", "unknown", "padded", "empty", "good"])
    assert {k for k, v in got.items() if v["kept"]} == {"good", "padded"}
    assert set(got) == {"good", "twice", "openend", "answers", "onlysystem", "blank", "notime", "unknown", "padded", "empty", "nosession"}
    assert got["good"]["n_messages"] == 5 and got["good"]["n_turns"] == 4
    ordered = [(r["thread_id"], r["turn_no"], r["message_id"], r["speaker"]) for r in c.ordered_messages(s, m, roles).collect() if r["thread_id"] == "good"]
    assert sorted(ordered)[0] == ("good", 1, "good0", "user") and len(ordered) == 5


def test_long_conversation_over_several_partitions(spark):
    n = 4000
    rows = _turns("hot", ["user", "bot"] * n) + _turns("hotbad", (["user", "bot"] * n)[:-1] + ["user"])
    got, *_ = _run(spark, rows, ["hot", "hotbad"])
    assert got["hot"]["kept"] and got["hot"]["n_turns"] == 2 * n and not got["hotbad"]["kept"]


def test_empty_tables(spark):
    got, *_ = _run(spark, [], [])
    assert got == {}
