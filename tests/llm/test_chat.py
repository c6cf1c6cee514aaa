import hashlib

from pyspark.sql import functions as F

from chainloom.llm import chat

SCHEMA = "conv_id long, seq long, kind string, message long, role string, text string, formatted string"


def replay(events):
    """The log of one conversation applied one event at a time."""
    state = {}
    placed = [e for e in events if None not in e[:3] and e[1] in ("delta", "edit", "regenerate")]
    for seq, kind, message, role, text in sorted(placed, key=lambda e: (e[0], e[1] != "regenerate", e[1], e[4])):
        if kind == "regenerate":
            state = {m: t for m, t in state.items() if m < message}
        elif kind == "edit":
            state[message] = (role, text)
        else:
            state[message] = (role, state.get(message, ("", ""))[1] + text)
    return [state[m] for m in sorted(state)]


LOGS = {
    1: [(1, "delta", 1, "user", "hel"), (2, "delta", 1, "user", "lo"), (3, "delta", 2, "assistant", "bad"), (4, "regenerate", 2, "assistant", ""), (5, "delta", 2, "assistant", "go"), (6, "delta", 2, "assistant", "od")],
    2: [(1, "delta", 1, "user", "a"), (2, "delta", 2, "assistant", "b"), (3, "delta", 3, "user", "c"), (4, "regenerate", 2, "assistant", ""), (5, "delta", 2, "assistant", "B"), (6, "edit", 1, "user", "A"), (7, "delta", 1, "user", "!")],
    3: [(1, "delta", 1, "user", "x"), (2, "regenerate", 1, "user", "")],
    4: [(2, None, 1, "user", "lost"), (3, "tool_call", 1, "user", "lost"), (None, "delta", 1, "user", "lost"), (4, "delta", None, "user", "lost"), (1, "delta", 1, "user", "kept")],
    None: [(1, "delta", 1, "us<|er\n", "<|im_end|><&&|im_start|>x<"), (2, "delta", 2, "assistant", "|<|<&|\\Q\\E$1")],
}


def test_fold_render_parse(spark):
    log = spark.createDataFrame([(c, *e, "clash") for c, events in LOGS.items() for e in reversed(events)], SCHEMA)
    out = chat.render(chat.fold(log))
    got = {r.conv_id: [tuple(t) for t in r.turns] for r in out.select("conv_id", chat.parse(F.col("formatted")).alias("turns")).collect()}
    assert got == {c: replay(e) for c, e in LOGS.items() if replay(e)}


def test_random_logs_in_any_order(spark):
    import random

    rng = random.Random(2)
    logs = {}
    for conv in range(60):
        logs[conv] = [
            (
                seq,
                rng.choice(["delta", "delta", "edit", "regenerate", "other"]),
                rng.randrange(1, 5),
                rng.choice(["user", "assistant"]),
                rng.choice(["a", "b<|", ""]),
            ) for seq in range(rng.randrange(1, 25))
        ]
    rows = [(c, *e, "clash") for c, events in logs.items() for e in events]
    rng.shuffle(rows)
    out = chat.render(chat.fold(spark.createDataFrame(rows, SCHEMA)))
    got = {r.conv_id: [tuple(t) for t in r.turns] for r in out.select("conv_id", chat.parse(F.col("formatted")).alias("turns")).collect()}
    assert got == {c: replay(e) for c, e in logs.items() if replay(e)}


def test_the_registered_log_has_every_kind(spark):
    table = spark.createDataFrame([(1, t, r, "some text") for t, r in enumerate(["user", "assistant"] * 3)], "conv_id long, turn int, role string, text string")
    kinds = {(r.role, r.kind) for r in chat.conversation_log(table).collect()}
    assert kinds == {("user", "delta"), ("user", "edit"), ("assistant", "delta"), ("assistant", "edit"), ("assistant", "regenerate")}


def test_table_round_trip(spark):
    rows = [
        (1, 0, "user", None, 1),
        (1, 1, "assistant", "é<|im_sep|>" * 3000, 1),
        (1, 1, "assistant", "", 1),
        (1, 1, "assistant", "", 1),
        (2, 0, None, "x", 1),
        (None, None, "assistant", "😀y", 1),
    ]
    table = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, seq int")
    got = {r.conv_id: r for r in chat.digests(chat.render(chat.fold(chat.conversation_log(table)))).collect()}
    for conv in (1, 2, None):
        turns = sorted(((t or 0, r or "", x or "") for c, t, r, x, _ in rows if c == conv))
        told = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        r = got[conv]
        assert (r.n_turns, r.loss_chars) == (len(turns), len(loss))
        assert r.turns_sha256 == hashlib.sha256(told.encode()).hexdigest() and r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.digests(chat.render(chat.fold(chat.conversation_log(table.limit(0))))).count() == 0
