import duckdb

from fieldloom.llm import preferences

SCHEMA = "conv_id long, turn long, role string, text string"


def render(turns):
    return "".join(f"<|{r or 'unknown'}|>\n{t or ''}<|end|>\n" for _, r, t in turns)


shared = [(0, "system", "be kind"), (1, "user", "hi é"), (2, "assistant", "hello")]
talks = {
    0: [*shared, (3, "user", "more"), (4, "assistant", "yes")],
    1: [*shared, (3, "user", "other"), (4, "assistant", "no"), (5, "user", None), (6, None, "x")],
    2: shared, 3: shared,  # the same talk
    4: shared, 5: shared[:2],  # one is a prefix of the other
    6: [(0, "user", "a")], 7: [(0, "assistant", "a")],  # nothing shared
    8: shared,  # no partner
    10: [(0, "user", None)], 11: [(0, "user", None), (1, "assistant", "n" * 9000)],
    12: [(0, "user", "b"), (0, "user", "a"), (None, "user", "first")], 13: [(0, "user", "a")],
}


def check(out, sides):
    key = lambda t: tuple((v is not None, v) for v in t)
    for pair, r in out.items():
        a, b = (sorted(set(x), key=key) for x in sides(pair))
        n = 0
        while n < min(len(a), len(b)) and a[n][1:] == b[n][1:]:
            n += 1
        assert (r["prefix_turns"], r["prompt"], r["chosen"], r["rejected"]) == (n, render(a[:n]), render(a[n:]), render(b[n:]))
        for side, turns in (("chosen", a[n:]), ("rejected", b[n:])):
            spans = [tuple(map(int, s.split("-"))) for s in r[f"{side}_spans"].split(",") if s]
            assert [r[side][x:y] for x, y in spans] == [(t or "") + "<|end|>" for _, role, t in turns if role == "assistant"]


def test_pairs_equal_brute_force(spark):
    rows = [(c // 2, ("chosen", "rejected")[c % 2], *t) for c, ts in talks.items() for t in ts]
    rows += [rows[0], rows[3], (None, "chosen", 0, "user", "lost"), (1, None, 0, "user", "lost")]
    turns = spark.createDataFrame(rows, "pair_id long, side string, turn long, role string, text string").selectExpr("*", "1 as prompt", "2 as chosen")
    out = {r["pair_id"]: r for r in preferences.format_preferences(turns).collect()}
    assert sorted(out) == [0, 1, 2, 3, 5, 6]
    check(out, lambda pair: (talks[2 * pair], talks[2 * pair + 1]))


def test_pairs_of_conversations_share_a_prefix_and_equal_sql(spark):
    rows = [(c, *t) for c, ts in talks.items() for t in ts]
    rows += [rows[0], rows[3], (None, 0, "user", "lost")]
    conversations = spark.createDataFrame(rows, SCHEMA)
    out = {r["pair_id"]: r for r in preferences.format_preferences(preferences.paired_turns(conversations.selectExpr("*", "1 as answer", "2 as other", "3 as side"))).collect()}
    assert sorted(out) == [0, 1, 2, 3]  # the others lack an assistant turn, or a partner with one
    last = lambda c: max(t for t in talks[c] if t[1] == "assistant")
    check(out, lambda c: (talks[c], [t for t in talks[c] if t[0] < last(c)[0]] + [(last(c)[0], *last(c ^ 1)[1:])]))
    assert [out[c]["prefix_turns"] for c in range(4)] == [4, 4, 3, 3]
    conversations = conversations.toPandas().astype({"conv_id": "Int64", "turn": "Int64"})
    want = duckdb.sql(preferences.ORACLE_SQL)
    assert sorted(want.fetchall()) == sorted(tuple(r[c] for c in want.columns) for r in out.values())


def test_empty(spark):
    assert preferences.format_preferences(preferences.paired_turns(spark.createDataFrame([], SCHEMA))).count() == 0
