"""Repeated passages against a count of all windows."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.llm import repeats
from tests.llm.helpers import documents, words

W = repeats.WINDOW


def plain(rows):
    split = [(i, (t or "").encode().split()) for i, t in rows]
    seen = Counter(tuple(w[p : p + W]) for _, w in split for p in range(len(w) - W + 1))
    out = []
    for i, w in split:
        gone = {q for p in range(len(w) - W + 1) if seen[tuple(w[p : p + W])] > 1 for q in range(p, p + W)}
        out.append((i, b" ".join(x for k, x in enumerate(w) if k not in gone).decode(), len(w), len(gone)))
    return out


def corpus(seed):
    rng = random.Random(seed)
    fresh = lambda n: words(rng, n)
    shared = {n: fresh(n) for n in (34, 35, 36, 52, 53, 80, 200)}
    rows = [" ".join(fresh(rng.randrange(0, 150))) for _ in range(30)]
    for n, passage in shared.items():
        for _ in range(2 + n % 3):
            rows.append(" ".join([*fresh(rng.randrange(0, 50)), *passage, *fresh(rng.randrange(0, 50))]))
    hot = shared[80]
    rows += [" ".join([*fresh(k % 19), *hot[k % 11 :], *fresh(5)]) for k in range(60)]
    rows += [rows[5]] * 3 + [" ".join(["w"] * n) for n in (34, 35, 36, 90)] + [" ".join((fresh(7) * 30)[:100])]
    twice = fresh(60)
    rows.append(" ".join([*twice, *fresh(21), *twice]))
    rows.append(" ".join(fresh(20000)) + " " + " ".join(shared[200][40:140]))
    near = list(shared[200])
    near[100] = "other"
    rows += [" ".join(near), "\t".join(shared[53]) + "\n", "  " + "\x0b ".join(shared[52]) + "\x1c\x85tail  x", "A" + " ".join(shared[36])[1:], None, "", "  \n ", "é 日本 x"]
    rng.shuffle(rows)
    return [*enumerate(rows), (None, rows[3]), (7, rows[7]), (None, None)]


@pytest.mark.parametrize(("seed", "parts", "pack"), [(0, 4, repeats.PACK_BYTES), (1, 3, 700)])
def test_equals_a_count_of_all_windows(spark, monkeypatch, seed, parts, pack):
    monkeypatch.setattr(repeats, "PACK_BYTES", pack)
    rows = corpus(seed)
    docs = documents(spark, rows).repartition(parts).withColumnRenamed("lang", "run").withColumnRenamed("source", "hits")
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    got = sorted(map(tuple, repeats.drop_repeats(docs).collect()), key=key)
    assert got == sorted(plain(rows), key=key)
    assert sum(r[3] for r in got) > 1000 and any(r[2] > 1000 and 0 < r[3] < 200 for r in got)


def test_empty_tables(spark):
    none = documents(spark, []).filter("false")
    assert repeats.drop_repeats(none).count() == 0
    assert repeats.drop_repeats(documents(spark, [(1, None), (2, "a b")])).count() == 2


def test_texts_are_not_shuffled_after_they_are_packed(spark):
    out = repeats.drop_repeats(documents(spark, corpus(2)))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "texts" not in "".join(line for line in plan.split("\n") if "Exchange" in line)
    assert plan.count("Exchange") == 1 and "Bucketed: true" in plan  # the marks' one


def test_a_passage_in_every_text_costs_one_entry_a_pack():
    bucket, hashes = np.zeros(1000, np.uint64), np.repeat(np.arange(5, dtype=np.uint32), 200)
    sent = list(repeats._sent(0, 0, 4, bucket, hashes, np.arange(1000, dtype=np.uint16)))
    known = [r for b in sent for r in b.to_pylist() if r["kind"] == repeats.KNOWN]
    assert [len(r["hashes"]) for r in known] == [20] and not [r for b in sent for r in b.to_pylist() if r["kind"] == repeats.ASK]


def test_a_bucket_answers_each_place_once_whatever_the_order():
    rng = np.random.default_rng(0)
    state = repeats._Bucket(np.uint64, np.uint32, False)
    got, want = Counter(), Counter()
    sent = [(k, rng.choice(5000, 300, replace=False).astype(np.uint64)) for k in range(40)] + [(99, np.arange(90_000, 160_000, dtype=np.uint64))]
    seen = Counter(h for _, values in sent for h in values.tolist())
    for k, values in sent:
        want.update((k, p) for p, h in enumerate(values.tolist()) if seen[h] > 1)
        for run, _, places in state.take(repeats.ASK, (k, 0), values.tobytes(), np.arange(len(values), dtype=np.uint32).tobytes()):
            got.update((run, p) for p in np.frombuffer(places, np.uint32).tolist())
    for run, _, places in state.answer():
        got.update((run, p) for p in np.frombuffer(places, np.uint32).tolist())
    assert got == want and max(got.values()) == 1


def test_kept_columns(spark):
    assert repeats.drop_repeats(documents(spark, [(1, "a  b")])).select(F.col("text")).first()[0] == "a b"
