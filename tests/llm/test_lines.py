import hashlib
import random

import duckdb
import pytest

from fieldloom.llm import linededup
from tests.llm.helpers import words


def corpus(seed=0):
    rng = random.Random(seed)
    line = lambda n=9: " ".join(words(rng, n))
    notice = "All content is provided as it is"
    passage = line(60)
    texts = []
    for k in range(40):
        parts = [line() for _ in range(5)]
        if k % 4 == 0:
            parts.insert(k % 5, notice)
        if k % 5 == 0:
            parts.insert(k % 6, passage)
        if k % 3 == 0:
            parts.insert(2, f"Page {k} of {k + 7} was printed on day {k}")
        if k % 6 == 1:
            parts.insert(1, f"You are logged in as {words(rng, 1)[0]} since this morning here")
        texts.append("\n".join(parts))
    texts += [texts[1]] * 8  # copies: no recurrence
    near = texts[2].split("\n")
    texts += ["\n".join([*near[:4], line()]) for _ in range(3)]
    texts += [None, "", "\n\n", "short line", " tabs\tand   blanks make five tokens ", "x" * 20000]
    return list(enumerate(texts)), notice, passage


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "s", 1, 2) for i, t in texts], "doc_id long, text string, template string, n_lines int, key int")


def test_recurring_templates_go(spark):
    texts, notice, passage = corpus()
    out = {r["doc_id"]: r for r in linededup.drop_recurring_lines(frame(spark, texts)).collect()}
    assert len(out) == len(texts)
    for i, t in texts:
        kept = (out[i]["text"] or "").split("\n")
        gone = {x for x in (t or "").split("\n") if x in (notice, passage) or x.startswith(("Page ", "You are logged"))}
        assert kept == [x for x in (t or "").split("\n") if x not in gone], i
        assert out[i]["n_dropped"] == sum(x in gone for x in (t or "").split("\n"))
        assert out[i]["template"] == "s" and out[i]["key"] == 2
    assert [out[i]["text"] for i, t in texts if t is None] == [None]


@pytest.mark.parametrize("seed", range(2))
def test_sql_gives_the_same(spark, seed):
    texts, _, _ = corpus(seed)
    docs = frame(spark, texts)
    got = sorted(tuple(r) for r in linededup.drop_recurring_lines(docs).select("doc_id", "text", "n_lines", "n_dropped").fillna({"text": "<null>"}).collect())
    documents = docs.toPandas()  # noqa: F841
    want = sorted((r[0], "<null>" if r[1] is None else r[1], r[2], r[3]) for r in duckdb.sql(linededup.ORACLE_SQL).fetchall())
    assert got == want


def test_no_rows_and_repeated_ids(spark):
    texts, notice, _ = corpus()
    assert linededup.drop_recurring_lines(frame(spark, texts).filter("false")).count() == 0
    twice = frame(spark, [*texts, texts[0], (None, f"a\n{notice}")])
    rows = linededup.drop_recurring_lines(twice).filter("doc_id = 0").collect()
    assert len(rows) == 2 and rows[0] == rows[1] and notice not in rows[0]["text"]
    assert linededup.drop_recurring_lines(twice).filter("doc_id is null").first()["n_dropped"] == 0


def test_no_python_in_any_plan(spark, monkeypatch):
    texts, _, _ = corpus()
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    plans, store = [], linededup.stage
    monkeypatch.setattr(linededup, "stage", lambda df, name: plans.append(plan(df)) or store(df, name))
    plans.append(plan(linededup.drop_recurring_lines(frame(spark, texts))))
    assert len(plans) > 10 and not any("Python" in p or "Arrow" in p for p in plans)


def kept_in(spark, texts, passage):
    """The ids that still hold ``passage`` as a line."""
    out = linededup.drop_recurring_lines(frame(spark, list(enumerate(texts)))).collect()
    return {r["doc_id"] for r in out if passage in (r["text"] or "").split("\n")}


@pytest.mark.parametrize("edited", [False, True])
def test_copies_take_nothing_away(spark, edited):
    rng = random.Random(3)
    line = lambda n=12: " ".join(words(rng, n))
    passage = line(60)
    texts = ["\n".join([line(), line(), passage, line(), line(), line()]) for _ in range(30)]
    first = texts[0].split("\n")
    for k in range(300):
        copy = list(first)
        if edited:
            copy[k % 2] = " ".join([*copy[k % 2].split()[:-1], f"{line(1)}"])
            copy[3 + k % 3] = " ".join([line(1), *copy[3 + k % 3].split()[1:]])
        texts.append("\n".join(copy))
    assert kept_in(spark, texts, passage) == set()
    # the copies alone are one family
    assert len(kept_in(spark, [texts[0], *texts[30:]], passage)) == 301


@pytest.mark.parametrize("own", [1, 2])
def test_a_passage_that_outweighs_the_other_lines_goes(spark, own):
    rng = random.Random(4)
    line = lambda n=10: " ".join(words(rng, n))
    # the longest line, and least under the two hashes that marked documents before
    passage = min((line(120) for _ in range(3000)), key=lambda x: max(hashlib.md5((f + x).encode()).hexdigest() for f in "12"))
    texts = ["\n".join([*(line() for _ in range(own)), passage]) for _ in range(40)]
    assert kept_in(spark, texts, passage) == set()


def test_several_templates_of_a_leaf(spark):
    rng = random.Random(5)
    line = lambda n=12: " ".join(words(rng, n))
    name = lambda: words(rng, 1)[0]
    kinds = [
        lambda: f"You are logged in as {name()} since this morning here",
        lambda: f"You are logged out by {name()} until further notice today",
        lambda: f"You are logged {line(7)}",  # ordinary
        lambda: f"The news of {name()} {line(6)}",  # an ordinary leaf
    ]
    texts = ["\n".join([line(), kinds[k % 4](), line(), line()]) for k in range(80)]
    out = linededup.drop_recurring_lines(frame(spark, list(enumerate(texts)))).collect()
    assert {r["doc_id"] for r in out if r["n_dropped"]} == {k for k in range(80) if k % 4 < 2}
    assert max(r["n_dropped"] for r in out) == 1


def test_two_templates_that_differ_in_single_words(spark):
    rng = random.Random(6)
    line = lambda n=12: " ".join(words(rng, n))
    texts = ["\n".join([line(), f"you are logged {'in as' if k % 2 else 'out of'} {words(rng, 1)[0]}", line(), line()]) for k in range(60)]
    out = linededup.drop_recurring_lines(frame(spark, list(enumerate(texts)))).collect()
    assert all(r["n_dropped"] == 1 and "logged" not in r["text"] for r in out)


def test_short_lines_need_more_documents(spark):
    rng = random.Random(7)
    line = lambda n=12: " ".join(words(rng, n))
    texts = ["\n".join([line(), line(), *(["read more here"] if k < 60 else ["see also"] if k < 66 else []), line()]) for k in range(70)]
    assert kept_in(spark, texts, "read more here") == set()
    assert kept_in(spark, texts, "see also") == set(range(60, 66))


@pytest.mark.parametrize("holders", [2, 3])
def test_few_documents_share_a_long_passage(spark, holders):
    rng = random.Random(8)
    line = lambda n=25: " ".join(words(rng, n))
    passage, short = line(55), line(12)
    texts = ["\n".join([line(), line(), line(), *([passage, short] if k < holders else [])]) for k in range(12)]
    assert kept_in(spark, texts, passage) == set()
    assert kept_in(spark, texts, short) == set(range(holders))
    # near copies are no recurrence
    copy = texts[11].split("\n")
    texts.append("\n".join([copy[0], " ".join(["other", *copy[1].split()[1:]]), copy[2], passage]))
    texts[11] += "\n" + passage
    assert kept_in(spark, texts[11:], passage) == {0, 1}


@pytest.mark.parametrize(("shared", "own"), [(2, 3), (5, 3), (10, 3), (10, 10), (20, 10), (30, 15)])
def test_boilerplate_that_outweighs_own_lines_goes(spark, shared, own):
    rng = random.Random(9)
    line = lambda n=10: " ".join(words(rng, n))
    frame_lines = [line(6) for _ in range(shared)]
    texts = ["\n".join([*frame_lines[: shared // 2], *(line() for _ in range(own)), *frame_lines[shared // 2 :]]) for _ in range(100)]
    out = linededup.drop_recurring_lines(frame(spark, list(enumerate(texts)))).collect()
    assert {r["n_dropped"] for r in out} == {shared}
    assert all(set((r["text"] or "").split("\n")) == set(texts[r["doc_id"]].split("\n")) - set(frame_lines) for r in out)


def test_near_copies_with_a_line_of_their_own_keep_what_they_share(spark):
    rng = random.Random(10)
    line = lambda n=14: " ".join(words(rng, n))
    base = [line() for _ in range(9)]
    texts = ["\n".join([*base, line()]) for _ in range(60)] + ["\n".join(line() for _ in range(6)) for _ in range(30)]
    out = linededup.drop_recurring_lines(frame(spark, list(enumerate(texts)))).collect()
    assert sum(r["n_dropped"] for r in out) == 0
