import math
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from fieldloom.llm import resample
from fieldloom.llm.textvec import NON_ALNUM, Words, text_slices
from tests.llm.helpers import documents, words


def test_sample_prefers_target_texts(spark):
    rng = random.Random(0)
    good, bad = words(rng, 80), words(rng, 80)
    texts = [(i, " ".join(rng.choice(good if i % 2 else bad) for _ in range(60))) for i in range(400)]
    texts += [(1000, None), (1001, ""), (1002, "w " * 5000), (None, "text"), (3, texts[3][1])]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(0, 200)] + [(None, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    out = resample.resample(documents(spark, texts).withColumnRenamed("lang", "kept").withColumnRenamed("source", "bucket"), labels, fraction=0.5).collect()
    assert len(out) == len(texts)
    assert abs(sum(r["kept"] for r in out) - np.ceil(0.5 * len(texts))) <= 1  # a repeated row is kept with its twin
    held = [r for r in out if r["doc_id"] is not None and 200 <= r["doc_id"] < 400]
    assert np.mean([r["kept"] for r in held if r["doc_id"] % 2]) > 0.9 > 0.2 > np.mean([r["kept"] for r in held if not r["doc_id"] % 2])
    keys = {r["kept"]: [x["gumbel_key"] for x in out if x["kept"] == r["kept"]] for r in out}
    assert min(keys[True]) >= max(keys[False])
    assert [r["log_weight"] for r in out if r["doc_id"] in (1000, 1001)] == [0, 0]


def test_without_target_and_empty(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    docs = documents(spark, [(i, f"t {i}") for i in range(40)])
    out = resample.resample(docs, none, fraction=0.25).collect()
    assert sum(r["kept"] for r in out) == 10 and {r["log_weight"] for r in out} == {0.0}
    assert resample.resample(docs.filter("false"), none).count() == 0


def test_kth_largest(spark):
    rng = np.random.default_rng(0)
    for values in (rng.normal(size=6000), np.ones(50), np.repeat(rng.normal(size=40), 200), np.array([1e300, -1e300, 0.0] * 20)):
        df = spark.createDataFrame([(float(v),) for v in values], "x double")
        for k in (1, 7, len(values) // 2):
            assert resample.kth_largest(df, "x", k) == np.sort(values)[::-1][k - 1]
        assert resample.kth_largest(df, "x", len(values)) is None
    assert df.agg(F.count("*")).first()[0] == 60


def test_weights_and_sample_equal_brute_force(spark):
    """Models counted n-gram by n-gram in dictionaries, whole sums, and the top k of the keys."""
    rng = random.Random(1)
    pool = words(rng, 60)
    texts = [(i, " ".join(rng.choice(pool[: 20 + i % 40]) for _ in range(rng.randrange(1, 90)))) for i in range(150)] + [(150, None), (151, "...")]
    labels = [(i, int(i % 3 == 0)) for i in range(120)]
    target = {i for i, q in labels if q}
    raw, good, grams = {}, {}, {}
    for i, t in texts:
        batch = pa.RecordBatch.from_arrays([pa.array([t], pa.string())], ["text"])
        grams[i] = [b for _, _, data, at in text_slices(batch) for b in resample.buckets(Words(data, at, NON_ALNUM))[1].tolist()]
        for b in grams[i]:
            raw[b] = raw.get(b, 0) + 1
            good[b] = good.get(b, 0) + (i in target)
    all_raw, all_good = (sum(x.values()) + resample.BUCKETS for x in (raw, good))
    weight = {i: sum(math.log((good[b] + 1) / all_good) - math.log((raw[b] + 1) / all_raw) for b in g) for i, g in grams.items()}
    docs, known = documents(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int")
    plain = {r["doc_id"]: r for r in resample.resample(docs, known, fraction=0.4).collect()}
    assert all(abs(plain[i]["log_weight"] - w) < 1e-6 for i, w in weight.items())
    draw = {i: plain[i]["gumbel_key"] - plain[i]["log_weight"] for i in weight}
    assert {i for i, r in plain.items() if r["kept"]} == set(sorted(weight, key=lambda i: -weight[i] - draw[i])[:61])
    tempered = {r["doc_id"]: r for r in resample.resample(docs, known, fraction=0.4, effective=50.0).collect()}
    assert all(abs(tempered[i]["gumbel_key"] - draw[i] - 50 * weight[i] / max(1, len(grams[i]))) < 1e-6 for i in weight)


def test_ties_go_to_the_smaller_id_exactly(spark):
    big = 1 << 60
    ids = [big + k for k in range(40)] + [-5, 3, None, None, 3]
    df = spark.createDataFrame([(i,) for i in ids], "doc_id long")
    order = sorted((1 << 63) - 1 if i is None else i for i in ids)
    for k in (1, 2, 5, 20, 43):
        assert resample.kth_smallest_id(df, k) == order[k - 1]
    assert resample.kth_smallest_id(df, len(ids)) is None
