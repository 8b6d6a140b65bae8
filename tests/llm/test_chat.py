import random

from lodeframe.llm import chat


def brute(rows, part=1024):
    convs = {}
    for c, t, r, x in rows:
        convs.setdefault(c, []).append((t, r or "", x or ""))
    seqs = {c: [(r, x) for t, r, x in sorted(v, key=lambda y: y[0])] for c, v in convs.items()}
    out = []
    for c, s in seqs.items():
        if any(len(o) > len(s) and o[: len(s)] == s for o in seqs.values()):
            continue
        same = [d for d, o in seqs.items() if o == s]
        if c != min(same):
            continue
        safe = lambda x: x.replace("<|", "< |")
        pieces = [f"<|{safe(r)}|>\n{safe(x)}\n<|end|>\n" for r, x in s]
        for p in range(0, len(pieces), part):
            out.append((c, p // part, len(s), len(same), "".join(pieces[p : p + part])))
    return sorted(out)


def logged(seed, n=60):
    rng = random.Random(seed)
    rows, full = [], []
    for c in range(n):
        if full and rng.random() < 0.6:
            base = rng.choice(full)
            conv = base[: rng.randrange(1, len(base) + 1)]
            if rng.random() < 0.3:
                conv = conv[:-1] + [("user", f"other {rng.randrange(3)}")]
        else:
            conv = [(rng.choice(["user", "assistant", None]), rng.choice(["hi", "a <|end|> b", None, "ünï", f"t{rng.randrange(5)}"])) for _ in range(rng.randrange(1, 9))]
        full.append(conv)
        rows += [(c, k * 3, r, x) for k, (r, x) in enumerate(conv)]
    rng.shuffle(rows)
    return rows


def test_kept_conversations_equal_brute_force(spark):
    for seed in (0, 1):
        rows = logged(seed)
        got = chat.render(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
        assert sorted((r.conv_id, r.part, r.n_turns, r.copies, r.text) for r in got.collect()) == brute(rows)


def test_conversations_beyond_one_stretch(spark, monkeypatch):
    monkeypatch.setattr(chat, "STRETCH", 4)
    rows = [(1, k, "user", f"t{k}") for k in range(11)] + [(2, k, "user", f"t{k}") for k in range(7)] + [(3, k, "user", f"t{k}" if k != 9 else "x") for k in range(11)]
    got = chat.render(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), part=5)
    assert sorted((r.conv_id, r.part, r.n_turns, r.copies, r.text) for r in got.collect()) == brute(rows, 5)


def test_ties_nulls_repeats_and_clashing_columns(spark):
    rows = [(1, 0, "user", "b", 1), (1, 0, "user", "a", 2), (2, 0, "user", "a", 3), (2, 0, "user", "b", 4), (None, None, None, None, 5), (None, 1, "user", "q", 6), (3, 5, "user", "z", 7), (3, 5, "user", "z", 8)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n int")
    got = {r.conv_id: (r.n_turns, r.copies) for r in chat.render(turns).collect()}
    assert got == {1: (2, 2), None: (2, 1), 3: (2, 1)}
    assert chat.render(turns.limit(0)).count() == 0


def test_long_texts_and_a_shuffled_join(spark, monkeypatch):
    """Texts of a megabyte, and conversations that are too many to broadcast."""
    monkeypatch.setattr(chat, "small", lambda df, rows: df)
    rows = [(c, k, "user", f"{c % 2} {k} " + "long " * 200_000) for c in range(3) for k in range(2)] + [(9, 0, "user", "0 0 " + "long " * 200_000)]
    got = chat.render(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert sorted((r.conv_id, r.part, r.n_turns, r.copies, r.text) for r in got.collect()) == brute(rows)


def test_texts_move_once(spark):
    rows = [(c, k, "user", f"text {c} {k}") for c in range(5) for k in range(3)]
    plan = chat.render(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
