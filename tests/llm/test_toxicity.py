import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from fieldloom.llm import textvec, toxicity
from fieldloom.llm.textvec import NON_ALNUM, Words, text_slices
from tests.llm.helpers import documents, words


def labelled(n=500, seed=0):
    rng = random.Random(seed)
    common = words(rng, 150)
    texts, labels = [], []
    for i in range(n):
        w = [rng.choice(common) for _ in range(rng.randint(20, 80))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["grumbly", "snarkish"]))
        texts.append((i, " ".join(w)))
        labels.append((i, i % 2, int(toxic)))
    return texts, labels


def test_held_out_accuracy_and_shape(spark):
    texts, labels = labelled()
    texts += [(900, None), (901, ""), (902, "word " * 4000), (None, "grumbly snarkish grumbly"), (3, texts[3][1])]
    docs = documents(spark, texts).withColumnRenamed("lang", "toxic").withColumnRenamed("source", "x")
    known = spark.createDataFrame(labels + [(3, 0, 0), (7, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    out = toxicity.toxicity(docs, known).collect()
    assert len(out) == len(texts)
    truth = {i: t for i, _, t in labels}
    held = [r for r in out if r["held_out"] and r["doc_id"] in truth]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out if r["doc_id"] is not None)
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in out)
    assert {r["doc_id"]: r["predicted"] for r in out}[900] == 0
    assert [r["predicted"] for r in out if r["doc_id"] is None] == [1]


def test_held_out_labels_are_not_used(spark):
    texts, labels = labelled(200)
    docs = documents(spark, texts)
    schema = "doc_id long, quality int, toxic int"
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels]
    a, b = ({r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, spark.createDataFrame(x, schema)).collect()} for x in (labels, flipped))
    assert a == b


def test_one_class_and_none(spark):
    docs = documents(spark, [(i, f"text {i}") for i in range(20)])
    schema = "doc_id long, toxic int"
    assert {r["predicted"] for r in toxicity.toxicity(docs, spark.createDataFrame([], schema)).collect()} == {0}
    assert {r["predicted"] for r in toxicity.toxicity(docs, spark.createDataFrame([(i, 1) for i in range(20)], schema)).collect()} == {1}
    assert toxicity.toxicity(docs.filter("false"), spark.createDataFrame([], schema)).count() == 0


def test_bigram_probabilities_sum_to_one():
    """Over a closed vocabulary the interpolated model of a class is a distribution after any history."""
    rng = np.random.default_rng(0)
    size = toxicity.VOCABULARY
    low = [0.3, 0.7]
    assert abs(sum(low) - 1) < 1e-9 and size == 1 << 20
    before = np.zeros((2, size), np.int64)
    before[:, :50] = rng.integers(0, 5, (2, 50))
    zero = np.zeros((2, size), np.int64)
    model = toxicity.KneserNey(None, zero, zero, zero, before, before.sum(axis=0), zero)
    for c in range(2):
        total = (model.low[c].astype(np.float64) + model.left[c] * model.stem[c][0]).sum()
        assert abs(total - 1) < 1e-3


def test_counts_of_frequent_bigrams_are_not_clipped(spark):
    key = (5 << toxicity.BITS) | 7
    counts = toxicity.pair_counts(spark.createDataFrame([(key, 70_000, 830_000)], "key long, toxic long, ordinary long"))
    assert [n.max(axis=1).tolist() for _, n in counts] == [[830_000, 70_000]]


def test_every_bigram_keeps_its_own_counts(spark, monkeypatch):
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << (2 * toxicity.BITS), 20_000))
    rows = [(int(k), i % 5, i % 7) for i, k in enumerate(keys)]
    want = np.array([[n if n > 1 else 0 for n in (o, t)] for _, t, o in rows], float).T
    monkeypatch.setattr(toxicity, "BIGRAMS", 4096)  # several parts, some of them not held
    monkeypatch.setattr(toxicity, "HELD_PARTS", 1)
    parts = [spark.sparkContext.broadcast(p) for p in toxicity.pair_counts(spark.createDataFrame(rows, "key long, toxic long, ordinary long"))]
    assert len(parts) > 2
    pairs = toxicity.Pairs(parts)
    for _ in range(2):
        assert (pairs.counts(keys) == want).all()
    absent = np.setdiff1d(rng.integers(0, 1 << (2 * toxicity.BITS), 20_000), keys)
    assert not pairs.counts(absent).any()


def brute_force(texts, labels):
    """Log-likelihood ratios per word from counts in dictionaries: (whole text, words alone) differences of a text."""
    def parts(text):
        batch = pa.RecordBatch.from_arrays([pa.array([text], pa.string())], ["text"])
        for _, _, data, at in text_slices(batch):
            return [x.tolist() for x in toxicity.word_numbers(Words(data, at, NON_ALNUM))]

    bigram, holds, stem = ([Counter(), Counter()] for _ in range(3))
    for i, t in texts:
        if i in labels and zlib.crc32(str(i).encode()) % 5 > 1:
            number, before, stems = parts(t)
            bigram[labels[i]].update(set(zip(before, number)))
            holds[labels[i]].update(set(number))
            stem[labels[i]].update(set(stems))
    d, prior, size = 0.9, 2.0, toxicity.VOCABULARY
    pooled = Counter(w for _, w in set(bigram[0]) | set(bigram[1]))
    every = sum(pooled.values()) + 0.5 * size
    mass = [max(1, sum(stem[c].values())) for c in range(2)]

    def low(c, w, s):
        cont = Counter(x for _, x in bigram[c])
        cont = {x: min(n, holds[c][x]) for x, n in cont.items()}
        n = max(1, sum(cont.values()))
        left = d * len(cont) / n if cont else 1.0
        likely = (stem[c][s] + prior) / ((stem[0][s] + stem[1][s]) * mass[c] / sum(mass) + prior)
        return max(cont.get(w, 0) - d, 0) / n + left * (pooled[w] + 0.5) / every * likely

    def p(c, h, w, s):
        after = {x: n for (b, x), n in bigram[c].items() if b == h}
        total = sum(after.values())
        rest = (sum(n == 1 for n in after.values()) + d * sum(n > 1 for n in after.values())) / total if total else 1.0
        n = after.get(w, 0)
        return max((n if n > 1 else 0) - d, 0) / max(total, 1) + rest * low(c, w, s)

    def differences(text):
        words = list(zip(*parts(text)))
        return [np.mean([np.log(p(1, h, w, s) / p(0, h, w, s)) for w, h, s in words]), np.mean([np.log(low(1, w, s) / low(0, w, s)) for w, h, s in words])]

    return differences


def test_log_likelihoods_equal_brute_force(spark):
    texts, labels = labelled(60, seed=3)
    texts = [(i, " ".join(t.split()[:25])) for i, t in texts]
    known = {i: t for i, _, t in labels}
    model, _ = toxicity.fit(documents(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    differences = brute_force(texts, known)
    batch = pa.RecordBatch.from_arrays([pa.array([t for _, t in texts[:12]] + ["never seen words grumbly"], pa.string())], ["text"])
    for _, _, data, at in text_slices(batch):
        got = toxicity.features(Words(data, at, NON_ALNUM), model.value)
    want = [differences(t) for t in batch.column("text").to_pylist()]
    assert np.allclose(got[:, :2], want, rtol=1e-3, atol=1e-4)


def test_the_whole_text_differences_alone_tell_classes_apart(spark):
    texts, labels = labelled(600, seed=4)
    truth = {i: t for i, _, t in labels}
    docs = documents(spark, texts)
    model, _ = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    batch = pa.RecordBatch.from_arrays([pa.array([t for _, t in texts], pa.string())], ["text"])
    x = np.concatenate([toxicity.features(Words(data, at, NON_ALNUM), model.value) for _, _, data, at in text_slices(batch)])[:, :2]
    fold = np.array([zlib.crc32(str(i).encode()) % 5 for i, _ in texts])
    y = np.array([truth[i] for i, _ in texts])
    curve = toxicity.fit_curve(x[fold == 1], y[fold == 1].astype(float))
    assert np.mean((toxicity.apply_curve(x[fold == 0], curve) >= 0.5) == y[fold == 0]) > 0.95


def test_document_keys_and_slices_against_sets(monkeypatch):
    texts = ["a b a b c", "", None, "a b", "x1 " * 40, "café a", "a b a b c"] * 30
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])

    def keys_by_row(limit):
        out = {}
        for at, end, data, offsets in textvec.text_slices(batch, limit=limit):
            assert end - at <= textvec.SLICE_ROWS
            words = textvec.Words(data, offsets, textvec.NON_ALNUM)
            number, before, stem = toxicity.word_numbers(words)
            for r, *parts in zip(words.row.tolist(), number.tolist(), before.tolist(), stem.tolist(), strict=True):
                n, b, s = parts
                out.setdefault(at + r, set()).update({(b << toxicity.BITS) | n, toxicity._HOLDS | n, toxicity._STEM | s})
            row, keys = toxicity.document_keys(words)
            for r in range(words.rows):
                got = keys[row == r].tolist()
                assert got == sorted(out.get(at + r, ()))
        return out

    whole = keys_by_row(1 << 20)
    monkeypatch.setattr(textvec, "SLICE_ROWS", 4)
    assert keys_by_row(64) == whole == keys_by_row(1)


def test_bigrams_beyond_the_broadcast_reach_texts_by_joins(spark, monkeypatch):
    texts, labels = labelled(300, seed=5)
    texts += [(900, None), (901, ""), (903, texts[6][1]), (903, texts[6][1]), (None, texts[6][1]), (904, "never seen words")]
    docs = documents(spark, texts).withColumnRenamed("lang", "digest").withColumnRenamed("source", "rare")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")

    def scores():
        return sorted((-1 if r["doc_id"] is None else r["doc_id"], r["score"]) for r in toxicity.toxicity(docs, known).collect())

    want = scores()
    monkeypatch.setattr(toxicity, "BIGRAMS", 40)
    for held in (2, 0):  # some broadcast in parts, then none
        monkeypatch.setattr(toxicity, "HELD_PARTS", held)
        got = scores()
        assert [i for i, _ in got] == [i for i, _ in want]
        assert np.allclose([x for _, x in got], [x for _, x in want], rtol=1e-9)  # sums run in another order


def test_the_most_frequent_bigrams_are_broadcast_up_to_a_bound(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "BIGRAMS", 40)
    monkeypatch.setattr(toxicity, "HELD_PARTS", 20)
    rows = [(k, float(k % 40), float(k % 3)) for k in range(1, 2000) if k % 40 > 1]
    held, rare = toxicity.held_and_rare(spark.createDataFrame(rows, "key long, ordinary float, toxic float"))
    assert 0 < held.count() <= 800 and held.count() + rare.count() == len(rows)
    assert held.selectExpr("min(ordinary + toxic)").first()[0] > rare.selectExpr("max(ordinary + toxic)").first()[0]


def test_rows_of_the_curve_are_chosen_before_their_texts_are_read(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "CURVE_ROWS", 25)
    docs = spark.createDataFrame([(i, i % 2, f"t {i}") for i in range(200)] + [(7, 0, "again")], "doc_id long, toxic long, text string")
    got = [r["doc_id"] for r in toxicity.curve_rows(docs).collect()]
    want = [r["doc_id"] for r in docs.selectExpr("doc_id", "xxhash64(doc_id) h").orderBy("h", "doc_id").limit(25).collect()]
    assert set(got) == set(want) and len(got) in (25, 26)
    assert toxicity.curve_rows(docs.filter("false")).count() == 0
