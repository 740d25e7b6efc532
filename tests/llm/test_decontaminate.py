import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from fieldloom.llm import decontaminate as dc
from tests.llm.helpers import documents, words


def tokens(text):
    return re.findall(rb"[a-z0-9\x80-\xff]+", text.encode().lower())


def least_distance(item, text):
    row = list(range(len(item) + 1))
    best = row[-1]
    for w in text:
        new = [0]
        for k in range(1, len(item) + 1):
            new.append(min(row[k - 1] + (item[k - 1] != w), row[k] + 1, new[k - 1] + 1))
        row, best = new, min(best, new[-1])
    return best


def edited(rng, w, n):
    w = list(w)
    for _ in range(n):
        kind, at = rng.randrange(3), rng.randrange(len(w))
        if kind == 0:
            w[at] = "zz" + str(rng.randrange(10**6))
        elif kind == 1:
            w.insert(at, "zz" + str(rng.randrange(10**6)))
        elif len(w) > 1:
            w.pop(at)
    return w


def test_edited_items_are_found_and_clean_texts_left(spark):
    rng = random.Random(4)
    items = [(k, " ".join(words(rng, n))) for k, n in enumerate([1, 2, 3, 4, 5, 6, 9, 15, 15, 24, 40, 59, 120])]
    items += [(90, None), (91, ""), (92, "..."), (93, items[8][1])]
    texts = []
    for k, t in items[:13]:
        for d in range(0, dc.most_edits(len(t.split())) + 3, 1 if len(t.split()) < 30 else 3):
            body = words(rng, 40) + edited(rng, t.split(), d) + words(rng, 40)
            texts.append((len(texts), " ".join(body)))
    texts += [(len(texts) + k, " ".join(words(rng, 200))) for k in range(20)]
    texts += [(700, None), (701, ""), (702, items[9][1].upper() + "!"), (703, "the " * 5000), (704, items[10][1] + " " + items[11][1]), (None, items[9][1]), (704, items[10][1] + " " + items[11][1])]
    known = spark.createDataFrame(items + [(None, "a b c")], "item_id long, text string").selectExpr("*", "1 as distance")
    out = {(r["doc_id"], r["item_id"]): r["distance"] for r in dc.matches(documents(spark, texts).withColumnRenamed("lang", "item_id"), known).collect()}
    want = {}
    for d, t in texts:
        for i, x in items:
            item = tokens(x or "")
            if d is not None and item:
                n = least_distance(item, tokens(t or ""))
                if n <= dc.most_edits(len(item)):
                    want[d, i] = n
    missed = set(want) - set(out)
    assert set(out) <= set(want)
    assert len(missed) <= 0.02 * len(want), missed
    assert all(out[k] >= want[k] for k in out) and np.mean([out[k] == want[k] for k in out]) > 0.95


def test_nothing_to_find(spark):
    docs = documents(spark, [(1, "a b c")])
    none = spark.createDataFrame([], "item_id long, text string")
    assert dc.matches(docs, none).count() == 0
    assert dc.matches(docs.filter("false"), spark.createDataFrame([(1, "a b c")], "item_id long, text string")).count() == 0
    assert dc.matches(docs, spark.createDataFrame([(1, "..."), (2, None)], "item_id long, text string")).count() == 0


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(dc, "ITEM_BLOCK", 3)
    rng = random.Random(1)
    items = [(k, " ".join(words(rng, 20))) for k in range(10)]
    docs = documents(spark, [(k, " ".join(words(rng, 9)) + " " + t) for k, t in items])
    got = sorted((r["doc_id"], r["item_id"]) for r in dc.matches(docs, spark.createDataFrame(items, "item_id long, text string")).collect())
    assert got == [(k, k) for k in range(10)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 5), min_size=1, max_size=12), st.lists(st.integers(1, 5), min_size=1, max_size=16), st.integers(0, 4))
def test_prefix_distance(item, window, limit):
    def brute():
        row = list(range(len(window) + 1))
        for k, a in enumerate(item, 1):
            new = [k]
            for j, b in enumerate(window, 1):
                new.append(min(row[j - 1] + (a != b), row[j] + 1, new[j - 1] + 1))
            row = new
        return min(min(row), limit + 1)

    got = dc.prefix_distances(np.array([item], np.uint64), np.array([window], np.uint64), limit)
    assert got[0] == brute()


def test_long_items_with_as_many_edits_as_allowed(spark):
    rng = random.Random(9)
    items, texts = [], []
    for n in (160, 640, 1200, 2400):
        for _ in range(3 if n > 200 else 6):
            item = words(rng, n)
            items.append((len(items), " ".join(item)))
            for d in (dc.most_edits(n), dc.most_edits(n) // 2):
                texts.append((len(texts), " ".join(words(rng, rng.randrange(60)) + edited(rng, item, d) + words(rng, 30))))
    known = spark.createDataFrame(items, "item_id long, text string")
    out = {(r["doc_id"], r["item_id"]): r for r in dc.matches(documents(spark, texts), known).collect()}
    want = {(2 * i + j, i) for i, _ in items for j in (0, 1)}
    assert len(out.keys() & want) >= 0.99 * len(want) - 1 and not out.keys() - want
    assert {i for i, t in items if len(t.split()) > 512} <= {i for _, i in out} and len([k for k in want - set(out) if len(items[k[1]][1].split()) > 512]) == 0
    for (d, i), r in list(out.items())[:6]:  # the shorter ones
        assert r["distance"] == least_distance(tokens(items[i][1]), tokens(texts[d][1]))


def test_starts_of_alignments():
    rng = np.random.default_rng(0)
    items, text = rng.integers(1, 5, (3, 8)).astype(np.uint64), rng.integers(1, 5, 30).astype(np.uint64)
    got = dc.start_distances(items, text, 6)
    for k, item in enumerate(items):
        for s in range(30):
            padded = np.concatenate([text[s : s + 14], np.zeros(14, np.uint64)])[None, :14]
            assert got[k, s] == dc.prefix_distances(item[None], padded, 6)[0]


def test_repetitions_hold_on_other_copies():
    rng = np.random.default_rng(1)
    for n in (20, 59, 160):
        items = rng.integers(1, 1 << 62, (50, n)).astype(np.uint64)
        r = dc.repeats_for(items, np.random.default_rng(2))
        take = np.resize(np.arange(50), 600)
        same = dc.sampled_words(items[take], r) == dc.sampled_words(dc.edited_copies(items[take], np.random.default_rng(77)), r)
        assert r and same.any(axis=1).mean() >= 0.975


def test_blocks_of_items_are_bounded_by_size_as_well(spark, monkeypatch):
    items = spark.createDataFrame([(i, "word " * 200) for i in range(40)], "item_id long, text string")
    assert dc.block_count(items) == 1 and dc.block_count(items.filter("false")) == 1
    monkeypatch.setattr(dc, "ITEM_BYTES", 10_000)
    assert dc.block_count(items) == 4
    monkeypatch.setattr(dc, "ITEM_BLOCK", 5)
    assert dc.block_count(items) == 8


def test_one_way_at_all_lengths():
    rng = random.Random(5)
    lengths = [5, 20, 63, 64, 65, 129, 240, 320, 512, 640, 1200]
    ix = dc.ItemIndex(list(range(len(lengths))), [" ".join(words(rng, n)) for n in lengths])
    assert max(ix.lengths) <= dc.BLOCK and all(dc.LEAST_REPEATS <= r <= 96 for r in ix.repeats.values())
    for i, n in enumerate(lengths):
        blocks = sorted((int(o), b) for b in ix.lengths for k, o in zip(ix.owner[b], ix.offset[b], strict=True) if k == i)
        assert [o for o, _ in blocks] == np.cumsum([0] + [b for _, b in blocks])[:-1].tolist() and sum(b for _, b in blocks) == n
        assert len(blocks) == -(-n // dc.BLOCK) and sum(dc.most_edits(b) + 1 for _, b in blocks) > dc.most_edits(n)
    assert all(member.dtype == np.uint64 and member.ndim == 1 for _, member, _ in ix.grams.values())


def test_recall_through_blocks_at_all_lengths(spark):
    rng = random.Random(8)
    items, texts, want = [], [], set()
    for n in (20, 60, 110, 200, 240, 260, 320, 700, 1200):
        for _ in range(6):
            item = words(rng, n)
            items.append((len(items), " ".join(item)))
            d = dc.most_edits(n)
            part = edited(rng, item[: n // 2], d) + item[n // 2 :]  # all edits in one half
            for copy in (edited(rng, item, d), part, item):
                texts.append((len(texts), " ".join(words(rng, rng.randrange(40)) + copy + words(rng, rng.randrange(40)))))
                want.add((len(texts) - 1, len(items) - 1))
    known = spark.createDataFrame(items, "item_id long, text string")
    out = {(r["doc_id"], r["item_id"]): r["distance"] for r in dc.matches(documents(spark, texts), known).collect()}
    assert not out.keys() - want and len(want - out.keys()) <= 0.01 * len(want)
    assert all(out[k] == 0 for k in out if k[0] % 3 == 2)


def test_long_items_that_share_blocks(spark):
    rng = random.Random(3)
    shared = words(rng, 150)
    items = [(i, " ".join(shared + words(rng, 150))) for i in range(20)]
    items += [(50, " ".join(["again"] * 200)), (51, " ".join(shared * 2))]
    texts = [(0, items[3][1]), (1, " ".join(shared)), (2, " ".join(["again"] * 170)), (3, " ".join(["again"] * 150)), (4, " ".join(shared * 3)), (5, items[21][1] + " x " + items[7][1])]
    known = spark.createDataFrame(items, "item_id long, text string")
    out = {(r["doc_id"], r["item_id"]): (r["distance"], r["first_word"]) for r in dc.matches(documents(spark, texts), known).collect()}
    assert out == {(0, 3): (0, 0), (2, 50): (30, 0), (4, 51): (0, 0), (5, 51): (0, 0), (5, 7): (0, 301)}
