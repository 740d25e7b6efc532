"""Small corpora with planted cases."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(n)]


def documents(spark, texts, extra=()):
    rows = [(i if isinstance(i, int) or i is None else None, t, "en", "s", len(t or "")) for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


def corpus(seed=0, n=60):
    """(doc_id, text): random texts, exact and near copies, nulls, empties, short and repeated ones."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        out.append(" ".join(words(rng, rng.randint(30, 120))))
    for k in range(8):
        out.append(out[k])
    for k in range(12):
        w = out[k].split()
        for _ in range(1 + k % 4):
            w[rng.randrange(len(w))] = "edit" + str(k)
        out.append(" ".join(w))
    w = out[20].split()
    for k in range(30):
        v = list(w)
        for _ in range(k % 5):
            v[rng.randrange(len(v))] = rng.choice(["one", "two", "three"])
        out.append(" ".join(v))
    out += [None, "", " ", "a", "A b", "a B", "one two three four", "x" * 5000, "  ".join(["w"] * 3000), "é ñ ß 日本 語"]
    return list(enumerate(out))
