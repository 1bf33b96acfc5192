"""Collapse reasons of trajectories made by hand."""

from trajlake.operators.collapse import collapse_reason

SUBMIT = "echo COMPLETE_TASK_AND_SUBMIT_FINAL_OUTPUT"


def turns(*steps):
    """(content, commands, next user text) of each assistant turn."""
    out = [("user", "task", None)]
    for content, commands, said in steps:
        out += [("assistant", content, commands), ("user", said, None)]
    return out


def reasons(spark, chats, limit=None):
    rows = [(k, i, *m) for k, chat in chats.items() for i, m in enumerate(chat)]
    df = spark.createDataFrame(rows, "k string, i int, role string, content string, commands array<string>")
    return {r.k: r.reason for r in collapse_reason(df, "k", "i", "role", "content", "commands", limit).collect()}


def good(n, first=0):
    return [(f"step {chr(97 + first + i)}", [f"cat {chr(97 + first + i)}"], "ok") for i in range(n)]


BAD = ("hm", None, "Format error: none")


def bad(n):
    return [(f"hm {'x' * i}", None, " Format error: none") for i in range(n)]


def test_rules(spark):
    long = " ".join(f"{'ab'[i // 400 % 1]}w{i % 30}x" for i in range(2_500))
    got = reasons(spark, {
        "clean": turns(*good(9)),
        "errors": turns(*bad(7)),
        "few errors": turns(*bad(6)),
        "recovered": turns(*bad(8), *good(4)),
        "not yet": turns(*bad(8), *good(3)),
        "many": turns(*bad(15), *good(9)),
        "submitted": turns(*bad(8), *good(1), ("done", [SUBMIT], "ok")),
        "only submitted": turns(*bad(8), ("done", [SUBMIT], "ok")),
        "run": turns(*[("again", None, "ok")] * 6),
        "short run": turns(*[("again", None, "ok")] * 5),
        "commands": turns(*[(f"t {chr(97 + i)}", [f"python  test_{i}.py"], "ok") for i in range(6)]),
        "numbers": turns(*[(f"t {chr(97 + i)}", [f"head -n {i} a"], "ok") for i in range(3)]),
        "loop": turns(*[(t, None, "ok") for _ in range(4) for t in ("a", "b", "c")]),
        "loop early": turns(*[(t, None, "ok") for _ in range(4) for t in ("a", "b")], ("c", None, "ok")),
        "checkouts": turns(*[(f"t {'x' * i}", [f"echo {'y' * i}; git checkout -- a.py"], "ok") for i in range(20)], *bad(1)),
        "character": turns(("=" * 9_000, None, "ok")),
        "words": turns((long, None, "ok")),
        "stream": turns(("```mswea_bash_command\nls\n``` " + "".join(chr(97 + i * i % 23) for i in range(39_990)) + " ```mswea_bash_command " * 3, None, "ok")),
        "user only": [("user", "x", None)],
        "empty": turns(("", [], None), (None, None, None)),
    })
    assert got.pop("words").startswith("intra_response_repetition:ratio=1.000:peak=8")
    assert got.pop("stream").endswith(":action_blocks=4")
    assert got == {
        "clean": None, "errors": "format_error_parser_loop:total=7:streak=7", "few errors": None, "recovered": None,
        "not yet": "format_error_parser_loop:total=8:streak=8", "many": "format_error_parser_loop:total=15:streak=15", "submitted": None,
        "only submitted": "format_error_parser_loop:total=8:streak=8", "run": "repeated_counter_normalized_response:6", "short run": None,
        "commands": "repeated_counter_normalized_command:6", "numbers": None, "loop": "periodic_assistant_response_loop:period=3:length=12",
        "loop early": "periodic_assistant_response_loop:period=2:length=8", "checkouts": "repeated_edit_revert_cycle:path=a.py:checkouts=20",
        "character": "intra_response_character_run:character='=':minimum_run=2048", "empty": None,
    }


def test_cut_trajectories(spark):
    got = reasons(spark, {
        "errors": turns(*bad(7)),
        "streak": turns(*bad(8), *good(2)),
        "recovered": turns(*bad(8), *good(3)),
        "density": turns(*(good(1) + bad(1)) * 10),
        "after the cut": turns(*good(24), *bad(20)),
        "checkouts": turns(*[(f"t {'x' * i}", [f"git checkout {'ab'[i % 2]}{'y' * i}"], "ok") for i in range(12)]),
    }, limit=24)
    assert got == {
        "errors": None, "streak": "format_error_parser_loop:total=8:streak=8", "recovered": None,
        "density": "format_error_parser_loop:total=10:streak=1", "after the cut": None,
        "checkouts": "repeated_edit_revert_cycle:paths=12:checkouts=12",
    }
