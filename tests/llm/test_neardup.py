import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fieldloom.llm import neardup
from fieldloom.llm.textvec import Words, shingle_sets, text_slices
from tests.llm.helpers import corpus, documents, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def shingles(text, k=5):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute(texts, percent):
    sets = {i: shingles(t) for i, t in texts}
    ids = sorted(sets)
    label = {i: i for i in ids}

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    label[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_shingle_sets_are_the_sets():
    texts = [t for _, t in corpus()]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
    for limit in (64, 1 << 20):
        got = [len(s) for _, _, data, offsets in text_slices(batch, limit=limit) for s in shingle_sets(Words(data, offsets))]
        assert got == [len(shingles(t)) for t in texts]


@pytest.mark.parametrize("percent", [80, 85])
def test_components_equal_brute_force(spark, percent):
    texts = corpus(3)
    docs = documents(spark, texts + [texts[5]]).withColumnRenamed("lang", "label").withColumnRenamed("source", "n")
    out = neardup.near_duplicates(docs, percent).collect()
    assert len(out) == len(texts) + 1
    want = brute(texts, percent)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in out)


@pytest.mark.parametrize("seed", range(3))
def test_groups_without_their_original(spark, seed):
    """Many edited copies around a text that is missing, some with a shared passage, some copies of copies."""
    rng = random.Random(seed)
    base, passage = words(rng, 90), words(rng, 25)
    texts, made = [], []
    for k in range(150):
        w = list(rng.choice(made)) if made and k % 7 == 0 else list(base)
        for _ in range(1 + k % 4):
            w[rng.randrange(len(w))] = words(rng, 1)[0]
        if k % 5 == 0:
            w += passage
        if k % 11 == 0:
            del w[:6]
        made.append(w)
        texts.append((k, " ".join(w)))
    out = neardup.near_duplicates(documents(spark, texts)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == brute(texts, 85)


def test_empty_and_alone(spark):
    assert neardup.near_duplicates(documents(spark, [(1, "a")]).filter("false")).count() == 0
    out = neardup.near_duplicates(documents(spark, [(4, None), (5, None), (6, "")])).collect()
    assert [(r["n_shingles"], r["component_id"], r["kept"]) for r in sorted(out)] == [(0, i, True) for i in (4, 5, 6)]


def test_components_of_long_chains(spark):
    rng = np.random.default_rng(1)
    order = rng.permutation(300).tolist()
    edges = spark.createDataFrame([(order[i], order[i + 1]) for i in range(299) if i != 150], "a long, b long")
    got = {r["id"]: r["label"] for r in neardup.components(edges).collect()}
    assert set(got.values()) == {min(order[:151]), min(order[151:])} and len(got) == 300


def excerpts(n, seed=0):
    """Windows of one text, of about half its length."""
    rng = random.Random(seed)
    text = words(rng, 1200)
    out = []
    for k in range(n):
        size = rng.randrange(300, 700)
        at = rng.randrange(len(text) - size)
        out.append((k, " ".join(text[at : at + size])))
    return out


def test_pairs_of_excerpts_grow_about_linearly(spark, monkeypatch):
    tried = []
    real = neardup.verified
    monkeypatch.setattr(neardup, "verified", lambda pairs, *a, **b: tried.append(pairs.count()) or real(pairs, *a, **b))
    made = []
    for n in (200, 400, 800):
        tried.clear()
        texts = excerpts(n)
        out = neardup.near_duplicates(documents(spark, texts)).collect()
        made.append(sum(tried))
        if n == 200:
            assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == brute(texts, 85)
    print(made)
    assert made[1] < 3 * made[0] and made[2] < 3 * made[1] and made[2] < 800 * 40


def test_texts_that_share_edits_but_are_unlike_are_not_paired(spark, monkeypatch):
    rng = random.Random(5)
    base = words(rng, 300)
    places = rng.sample(range(300), 60)
    texts = [" ".join(base)] * 2 + [" ".join(base[:-1] + ["end"])]
    for _ in range(60):
        w = list(base)
        for at in rng.sample(places, 10):
            w[at] = f"edit{at}"
        texts.append(" ".join(w))
    texts.append(" ".join(texts[-1].split()[:-6]))
    texts = list(enumerate(texts))
    made, plain = [], neardup.stage

    def counting(df, name):
        out = plain(df, name)
        if name == "cross":
            made.append(out.count())
        return out

    monkeypatch.setattr(neardup, "stage", counting)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(documents(spark, texts), 80).collect()}
    assert got == brute(texts, 80)
    assert made and sum(made) <= 2 * len(texts)  # 561 pairs share one of the rarest edits


def test_members_that_share_too_little_are_in_no_list(spark, monkeypatch):
    """Texts of one text's greater part, each with words of its own and a passage that eight share: that is too little for a link, so no list holds it."""
    rng = random.Random(11)
    base, passages = words(rng, 300), [words(rng, 12) for _ in range(8)]
    texts = [" ".join(base)] * 2 + [" ".join(base[:-1] + ["end"])]
    for k in range(64):
        texts.append(" ".join(base[:210] + words(rng, 80) + passages[k % 8]))
    linked = base[:210] + words(rng, 60) + passages[0]  # these two share more than their passage
    texts += [" ".join([*linked, *words(rng, 30)]), " ".join([*words(rng, 8), *linked, *words(rng, 22)])]
    texts = list(enumerate(texts))
    made, met, plain = [], [], neardup.stage

    def counting(df, name):
        out = plain(df, name)
        if name in ("sub-hubs", "groups"):
            (made if name == "sub-hubs" else met).append(out.count())
        return out

    monkeypatch.setattr(neardup, "stage", counting)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(documents(spark, texts), 80).collect()}
    assert got == brute(texts, 80) and got[67][1] == got[68][1] == 67
    assert met[0] >= 64  # they do meet in groups
    assert made and max(made) < 20  # the passages alone have 64 elements that eight texts each share


def test_no_close_pair_is_left_out(spark):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(120):
        counts = np.zeros(neardup.BLOCKS + 1, int)
        a = rng.integers(0, 16)
        counts[a : a + 14] = 10
        counts += rng.integers(0, 2, len(counts)) * (counts > 0)
        rows.append((1, k, int(counts.sum() + rng.integers(0, 9)), [int(c) for c in counts], int(counts.sum()), k, 0))
    df = spark.createDataFrame(rows, "hub long, id long, n long, counts array<int>, both long, label long, main long")
    got = {(r["id_x"], r["id_y"]) for r in neardup.close_pairs(df.filter("label <> main"), df, 85).collect()}
    want = set()
    for x in rows[1:]:
        for y in rows:
            fits = 185 * sum(map(min, x[3], y[3])) >= 85 * (x[2] + y[2]) and 100 * min(x[2], y[2]) >= 85 * max(x[2], y[2])
            if x[1] != y[1] and fits and (y[1] == 0 or x[1] < y[1]):
                want.add((x[1], y[1]))
    assert want and got == want


def test_ids_that_are_missing_or_have_several_texts(spark):
    rng = random.Random(1)
    a, b, c = (" ".join(words(rng, 40)) for _ in range(3))
    rows = [(1, a), (2, a), (2, b), (3, b), (3, None), (4, c), (None, c), (None, None), (5, "w " * 30_000), (2, a)]
    out = neardup.near_duplicates(documents(spark, rows)).collect()
    assert len(out) == len(rows)
    assert {r["doc_id"]: r["component_id"] for r in out} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, None: None}
    assert sorted(r["n_shingles"] for r in out if r["doc_id"] is None) == [0, 36]
    assert all(r["kept"] == (r["doc_id"] in (1, 4, 5, None)) for r in out)


def test_sql_gives_the_same(spark):
    texts = [*corpus(5), *[(500 + k, t) for k, t in excerpts(30)], (None, "a b c"), (3, "another text of the third document")]
    docs = documents(spark, texts)
    documents_ = docs.toPandas().astype({"doc_id": "Int64"})
    c = duckdb.connect()
    c.register("documents", documents_)
    want = c.sql(neardup.ORACLE_SQL)
    got = neardup.near_duplicates(docs).select(*want.columns)
    assert sorted(map(repr, want.fetchall())) == sorted(repr(tuple(r)) for r in got.collect())


def test_guides_go_once_a_part(spark, monkeypatch):
    monkeypatch.setattr(neardup, "GUIDED", 50)
    placed = spark.createDataFrame([(0, i) for i in range(1, 401)] + [(1000, 1001)], "hub long, id long")
    guides = spark.createDataFrame([(0, 1, 2), (1000, 1001, None)], "hub long, h2 long, h3 long")
    texts = spark.createDataFrame([(i, f"text {i}") for i in [*range(401), 1000, 1001]] + [(0, "a second text")], "doc_id long, text string")
    rows = neardup.guided(placed, guides, texts).withColumn("task", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()).collect()
    members = [r for r in rows if r["slot"] == neardup.GUIDES]
    assert sorted((r["hub"], r["id"]) for r in members) == sorted((r["hub"], r["id"]) for r in placed.collect())
    parts = {}
    for r in sorted(rows, key=lambda r: r["at"]):
        parts.setdefault((r["hub"], r["part"]), []).append(r)
    assert len([p for p in parts if p[0] == 0]) == 8
    for (hub, _), part in parts.items():
        assert len({r["task"] for r in part}) == 1
        assert [(r["slot"], r["id"], r["text"]) for r in part if r["slot"] < neardup.GUIDES] == ([(0, 0, "a second text"), (0, 0, "text 0"), (1, 1, "text 1"), (2, 2, "text 2")] if hub == 0 else [(0, 1000, "text 1000"), (1, 1001, "text 1001")])
        assert [r["slot"] for r in part] == sorted(r["slot"] for r in part) and len([r for r in part if r["slot"] == neardup.GUIDES]) < 100
