import random

from wardwise.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, h0 string, at string"


def plainly(rows):
    """Prefixes found by comparing lists."""
    logs = {}
    for conv, turn, role, text in {r[:4] for r in rows if r[0] is not None}:
        logs.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    # nulls and empty texts are the same turn only if the turn number is
    logs = {c: [t[2:] for t in sorted(set(v))] for c, v in logs.items()}
    out = set()
    for c, v in logs.items():
        if any(len(o) > len(v) and o[: len(v)] == v for o in logs.values()):
            continue
        same = [d for d, o in logs.items() if o == v]
        if c == min(same):
            out.add((c, len(v), len(same), "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in v)))
    return out


def test_against_lists(rows):
    draw = random.Random(4)
    made = []
    for conv in range(120):
        for turn in range(draw.randint(1, 5)):
            made.append((conv, turn, draw.choice(["user", "assistant"]), draw.choice(["hi", "yes", "yes"]), "x", "y"))
    made += [(0, 0, None, None, "x", "y"), (500, None, "user", "early", "x", "y"), (500, None, "user", "early", "x", "y"),
             (500, 3, "", "late" * 50_000, "x", "y"), (None, 1, "user", "nobody", "x", "y"), (501, 0, None, None, "x", "y")]
    got = chat.formatted(rows(SCHEMA, *made))
    assert got.columns == ["conv_id", "n_turns", "n_logs", "text"]
    assert sorted(map(tuple, got.collect())) == sorted(plainly(made))


def test_empty(rows):
    df = rows(SCHEMA, (1, 1, "user", "x", "", ""))
    assert chat.formatted(df.limit(0)).collect() == []


def test_a_conversation_many_times(rows):
    made = [(c, t, "user", f"turn {t}", "", "") for c in range(300) for t in range(1 + c % 3)]
    assert [tuple(r)[:3] for r in chat.formatted(rows(SCHEMA, *made)).collect()] == [(2, 3, 100)]


def test_no_python_in_the_plan(rows):
    df = rows(SCHEMA, (1, 1, "user", "x", "", ""))
    plan = chat.formatted(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
