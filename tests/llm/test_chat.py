import random

from fathom.llm.chat import maximal_conversations


def brute(rows):
    chats = {}
    for c, n, role, text in set(rows):
        if c is not None:
            chats.setdefault(c, []).append((n is not None, n or 0, role or "user", text or ""))
    chats = {c: [x[2:] for x in sorted(set(v))] for c, v in chats.items()}
    out = []
    for c, v in chats.items():
        same = [d for d, w in chats.items() if w == v]
        if c == min(same) and not any(len(w) > len(v) and w[: len(v)] == v for w in chats.values()):
            out.append((c, len(v), len(same), "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in v)))
    return sorted(out)


def test_snapshots_collapse(spark):
    r = random.Random(2)
    rows, c = [], 0
    for _ in range(25):
        turns = [(("user", "assistant")[i % 2], r.choice(["hi", "é\n", "", "no", "yes <|im_end|>"])) for i in range(r.randint(1, 6))]
        for _ in range(r.randint(1, 4)):
            rows += [(c, 3 * n, *t) for n, t in enumerate(turns[: r.randint(1, len(turns))])]
            c += 1
    rows += rows[:5] + [(None, 0, "user", "x"), (900, None, None, None), (900, 1, "user", "z"), (901, 1, "user", "same turn"), (901, 1, "user", "another"), (902, 0, "user", None)]
    frame = spark.createDataFrame([(*x, "n") for x in rows], "conv_id long, turn long, role string, text string, n_turns string").repartition(4)
    assert sorted(tuple(x) for x in maximal_conversations(frame).collect()) == brute(rows)
    assert maximal_conversations(frame.limit(0)).collect() == []
