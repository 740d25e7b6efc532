import random

from fieldloom.llm import licenses
from tests.llm.helpers import documents, words


def test_templates_are_found_and_clean_texts_left(spark):
    rng = random.Random(0)
    texts, want = [], set()
    for k, (name, template) in enumerate(licenses.TEMPLATES.items()):
        texts.append((k, " ".join(words(rng, 30 + k)) + "\n" + template + "\n" + " ".join(words(rng, 50))))
        want.add((k, name))
    long = licenses.TEMPLATES["MIT-text"].split()
    long[20] = "changed"
    texts += [(100, " ".join(long)), (101, " ".join(words(rng, 500))), (102, None), (103, ""), (104, "MIT"), (105, "licensed UNDER the apache license, version 2.0"), (None, licenses.TEMPLATES["MIT"])]
    texts += [texts[0]]
    out = licenses.scan_licenses(documents(spark, texts).withColumnRenamed("lang", "license")).collect()
    got = {(r["doc_id"], r["license"]) for r in out}
    assert len(out) == len(got) and want <= got
    assert {n for d, n in got if d == 100} == {"MIT-text"} and {n for d, n in got if d == 105} == {"Apache-2.0"}
    assert not {d for d, _ in got} & {101, 102, 103, 104}
    header = next(k for k, n in enumerate(licenses.TEMPLATES) if n == "Apache-2.0-header")
    number = {n: k for k, n in enumerate(licenses.TEMPLATES)}
    inside = {(number["MIT-full"], "MIT-text"), (number["ISC-full"], "ISC"), (number["BSD-3-Clause-full"], "BSD")}
    assert got - want == {(header, "Apache-2.0"), (100, "MIT-text"), (105, "Apache-2.0"), (None, "MIT")} | inside
    assert licenses.scan_licenses(documents(spark, texts).filter("false")).count() == 0


def test_containment_is_exact(spark):
    rng = random.Random(2)
    template = words(rng, 60)
    texts = []
    for cut in (0, 5, 10, 12, 20, 30):
        texts.append((cut, " ".join(words(rng, 37) + template[: 60 - cut] + words(rng, 40))))
    got = {r["doc_id"]: r["containment"] for r in licenses.scan_licenses(documents(spark, texts), {"t": " ".join(template)}).collect()}
    assert got == {cut: (60 - cut - 4) / 56 for cut in (0, 5, 10)}


def shingles(w):
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_scan_equals_brute_force(spark):
    """Every window of every document against every template, by containment alone; templates from a table."""
    rng = random.Random(3)
    templates = [(f"t{k}", " ".join(words(rng, n))) for k, n in enumerate((5, 6, 9, 20, 47, 160))] + [(None, "a b c d e"), ("none", None)]
    texts = []
    for k in range(120):
        w = words(rng, rng.randrange(60))
        for _ in range(rng.randrange(4)):
            t = rng.choice(templates[:6])[1].split()
            for _ in range(rng.randrange(3) if len(t) > 20 else 0):
                t[rng.randrange(len(t))] = "edit"
            w += t[rng.randrange(3) :] + words(rng, rng.randrange(9))
        texts.append((k, " ".join(w)))
    got = {(r["doc_id"], r["license"]): (r["containment"], r["first_word"]) for r in licenses.scan_licenses(documents(spark, texts), spark.createDataFrame(templates, "license string, text string")).collect()}
    want = {}
    for d, text in texts:
        w = text.split()
        for name, template in templates[:6]:
            t, n = shingles(template.split()), len(template.split())
            stride = max(1, n // 8)
            for first in range(0, len(w), stride):
                share = len(shingles(w[first : first + n + stride]) & t) / len(t)
                if share >= licenses.CONTAINMENT and share > want.get((d, name), (0, 0))[0]:
                    want[d, name] = (share, first)
    assert len(want) > 60 and got == want
