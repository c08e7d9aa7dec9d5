"""Preference pairs against plain Python."""

import random

from listingloom.llm import preference


def brute(chosen, rejected):
    def order(turns):
        unique = {(t or 0, role or "", text or "") for t, role, text in turns}
        return [(role, text) for _, role, text in sorted(unique)]

    c, r = order(chosen), order(rejected)
    n = 0
    while n < min(len(c), len(r)) and c[n] == r[n]:
        n += 1

    def render(turns):
        text, spans = "", []
        for role, body in turns:
            text += f"<|{role}|>\n"
            if role == "assistant":
                spans.append((len(text), len(body) + len("<|end|>")))
            text += f"{body}<|end|>\n"
        return text, spans

    (prompt, _), (good, a), (bad, b) = render(c[:n]), render(c[n:]), render(r[n:])
    return n, prompt, good, bad, a, b


def as_tuple(row):
    spans = [[(s.start, s.length) for s in row[name]] for name in ("chosen_spans", "rejected_spans")]
    return (row.common_turns, row.prompt, row.chosen, row.rejected, *spans)


def test_against_brute_force(spark):
    rnd = random.Random(6)
    told, pairs = {}, []
    for k in range(120):
        turns = [(t, rnd.choice(["user", "assistant"]), rnd.choice("ab")) for t in range(rnd.randrange(0, 6))]
        other = turns[: rnd.randrange(len(turns) + 1)]
        other += [(9 + t, rnd.choice(["user", "assistant"]), rnd.choice("abé")) for t in range(rnd.randrange(3))]
        told[2 * k], told[2 * k + 1] = turns, other
        pairs.append((k, 2 * k, 2 * k + 1))
    told[0] = [(0, None, None), (0, "user", "x"), (0, "user", "x"), (None, "assistant", "y")]
    rows = [(c, *t, 1) for c, turns in told.items() for t in turns] + [(None, 0, "user", "z", 1)]
    turns = spark.createDataFrame(rows, "conv_id LONG, turn LONG, role STRING, text STRING, turns INT")
    frame = spark.createDataFrame(pairs, "pair_id LONG, chosen_id LONG, rejected_id LONG")
    got = {r.pair_id: as_tuple(r) for r in preference.preference_pairs(turns, frame).collect()}
    assert got == {k: brute(told[c], told[r]) for k, c, r in pairs}
    missing = spark.createDataFrame([(1, None, 5), (2, 999, 998)], "pair_id LONG, chosen_id LONG, rejected_id LONG")
    assert preference.preference_pairs(turns, missing).count() == 2
    assert preference.preference_pairs(turns.limit(0), frame.limit(0)).count() == 0


def test_swapped_replies(spark):
    rows = [
        (0, 0, "user", "q"), (0, 1, "assistant", "good"), (0, 2, "user", "more"), (0, 3, "assistant", "better"),
        (1, 0, "user", "other"), (1, 1, "assistant", "theirs"), (2, 0, "user", "alone"), (4, 0, "assistant", None),
    ]
    turns = spark.createDataFrame(rows, "conv_id LONG, turn LONG, role STRING, text STRING")
    got = {r.pair_id: r for r in preference.preference_pairs(*preference.swapped_replies(turns)).collect()}
    assert set(got) == {0, 1, 4}
    assert got[0].common_turns == 3 and "better" in got[0].chosen and "theirs" in got[0].rejected
    assert got[4].common_turns == 1 and got[4].chosen == got[4].rejected == ""
