import random

import pytest

from fieldloom.llm import decontaminate, linededup, neardup, stages, toxicity
from tests.llm.helpers import SCHEMA, words

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(8)
    common = words(rng, 400)
    line = lambda n: " ".join(rng.choice(common) for _ in range(n))
    texts = ["\n".join(line(25) for _ in range(4)) for _ in range(300)]
    for k in range(0, 300, 10):
        texts[k] += " snarkish grumbly snarkish"
    items = [(k, " ".join(words(rng, 30))) for k in range(5)]
    for k in range(5):
        texts[k + 1] += "\n" + items[k][1]
    passage = line(60)
    for k in range(20, 60):
        texts[k] += "\n" + passage
    texts += [texts[101], texts[102].replace(texts[102].split()[3], "changed"), None, ""]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, int(i % 10 == 0)) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path), passage


def test_stages_take_effect(spark, folder):
    path, passage = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    clean = {d for d in range(300) if d % 10 and not 1 <= d <= 5}
    steps = {"input": docs}
    for name, function in corpus_pipeline.STAGES[:-1]:
        docs = stages.stage(function(spark, docs, path), name)
        assert docs.columns == steps["input"].columns
        steps[name] = docs
    ids = {name: {r["doc_id"] for r in df.select("doc_id").collect()} for name, df in steps.items()}
    gone = {r["doc_id"] for r in toxicity.toxicity(steps["input"], spark.read.parquet(f"{path}/labels.parquet")).filter("predicted = 1").collect()}
    assert ids["toxicity"] == ids["input"] - gone and len(gone & set(range(0, 300, 10))) >= 28
    assert clean <= ids["toxicity"]
    lines = {r["doc_id"]: r["text"] for r in linededup.drop_recurring_lines(steps["toxicity"]).collect()}
    assert {r["doc_id"]: r["text"] for r in steps["line_dedup"].collect()} == lines
    assert not any(passage in (t or "") for t in lines.values())
    assert steps["line_dedup"].filter("n_chars <> length(text)").isEmpty()
    kept = {r["doc_id"] for r in neardup.near_duplicates(steps["line_dedup"], stages.STAGE_PERCENT).filter("kept").collect()}
    assert ids["near_dedup"] == kept and not kept & {300, 301} and {101, 102} <= kept
    found = {r["doc_id"] for r in decontaminate.matches(steps["near_dedup"], spark.read.parquet(f"{path}/benchmark.parquet")).collect()}
    assert ids["decontamination"] == ids["near_dedup"] - found and found == {1, 2, 3, 4, 5}
    assert clean <= ids["decontamination"]
    out = corpus_pipeline.run(spark, path)
    assert {r["doc_id"] for r in out.select("doc_id").collect()} == ids["decontamination"]
    assert out.groupBy("sequence_id").agg({"length": "sum"}).filter("`sum(length)` > 2048").isEmpty()


def test_registered(spark):
    import __spark_entry__ as entry

    assert "pipeline" in entry.queries() and sorted(n.split("_")[0] for n in entry.queries() if n.startswith("op")) == sorted(f"op{k}" for k in range(1, 14))


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Nulls, empties, a long text, repeated rows and ids, and columns that clash with the operators' own."""
    rng = random.Random(9)
    line = lambda n: " ".join(words(rng, n))
    texts = [(k, "\n".join(line(20) for _ in range(3))) for k in range(12)]
    item = line(30)
    texts += [(20, None), (21, ""), (22, " \n "), (23, "\n".join(line(12) for _ in range(1500))), (None, texts[0][1]), (None, None)]
    texts += [texts[1], texts[1], (30, line(30)), (30, line(30) + " " + item), (31, texts[2][1]), (None, item)]
    rows = [(i, t, k, "x", k, 1.5) for k, (i, t) in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pos int, template string, n long, sketch double")
    path = tmp_path_factory.mktemp("odd")
    spark.createDataFrame([(0, item), (1, None), (None, "a b c d e f")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(k, 1, int(k == 5)) for k in range(12)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return docs, str(path)


@pytest.mark.parametrize("name,function", corpus_pipeline.STAGES)
def test_stages_on_odd_rows(spark, odd, name, function):
    docs, path = odd
    out = function(spark, docs, path)
    rows = out.collect()
    if name == "packing":
        assert len({(r["doc_id"], r["piece"], r["sequence_id"], r["offset"]) for r in rows}) == len(rows) and sum(r["piece"] == 0 for r in rows) == docs.count()
    else:
        assert out.columns == docs.columns
        ids = [r["doc_id"] for r in rows]
        assert {20, 21, 22} <= set(ids) and ids.count(None) == 3
        gone = {"near_dedup": {31}, "decontamination": {30}, "toxicity": {5}}.get(name, set())
        assert set(range(12)) | {23} <= set(ids) | gone and (name == "toxicity" or not gone & set(ids))
        # of rows that repeat an id with the same text only those that agree in all columns are one
        assert ids.count(1) == 3
    assert function(spark, docs.filter("false"), path).count() == 0


def test_run_on_an_empty_table(spark, odd):
    docs, path = odd
    docs.filter("false").write.parquet(f"{path}/documents.parquet")
    assert corpus_pipeline.run(spark, path).count() == 0
