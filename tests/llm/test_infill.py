"""Fill-in-middle against a plain reading of its definition."""

import hashlib
import random
import re

import numpy as np
import pytest

from fieldloom.llm import infill
from tests.llm.helpers import documents

PATTERNS = {"line": r"[^\n]*\n|[^\n]+", "word": r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*|^[\x20\x09-\x0D]+", "character": r"(?s:.)"}


def plain(doc_id, text, unit="line", percent=100, spm=50, seed=7):
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    text = text or ""
    units = re.findall(PATTERNS[unit], text)
    assert "".join(units) == text
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= percent:
        return n, "plain", None, None, text
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def texts(seed=0):
    rng = random.Random(seed)
    made = ["".join(rng.choice(["a", "bc ", "é", "日本", "🙂", "\n", "\n\n", " ", "\t", "\r\n"]) for _ in range(rng.randrange(0, 60))) for _ in range(120)]
    made += [None, "", "\n", "\n\n\n", "no end", "end\n", "has <P> in it\n", "<S>", "<M>\n", "<p>", "x" * 9000 + "\n" + "é" * 9000, "line\n" * 5000, "🙂\n" * 3000]
    return [*enumerate(made), (None, "one\ntwo\nthree"), (3, made[3]), (3, made[3]), (-9, "a\nb"), (1 << 62, "a\nb\nc")]


@pytest.mark.parametrize(("unit", "chunk", "percent"), [("line", infill.CHUNK, 100), ("line", 3, 100), ("word", 5, 60), ("character", 4, 100), ("word", infill.CHUNK, 0)])
def test_equals_plain_reading(spark, unit, chunk, percent):
    rows = texts()
    docs = documents(spark, rows).withColumnRenamed("lang", "n").withColumnRenamed("source", "form")
    made = infill.fill_in_middle(docs, unit=unit, chunk=chunk, percent=percent)
    back = made.withColumn("back", infill.restored(made.output, made.form)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[-1])
    want = sorted(((i, *plain(i, t, unit, percent)) for i, t in rows), key=key)
    assert sorted((tuple(r)[:6] for r in back), key=key) == want
    assert sorted(r["back"] for r in back) == sorted(t or "" for _, t in rows)


def test_chunks_that_own_no_cut_are_not_read_again(monkeypatch):
    data = np.frombuffer(b"ab\ncd\n" * 4000, np.uint8)
    chunks = infill.Chunks(data, np.array([0, len(data)]), "line", 100)
    assert len(chunks.start) == 240 and chunks.units().tolist() == [8000]
    read, found = [], infill._boundaries
    monkeypatch.setattr(infill, "_boundaries", lambda part, unit: read.append(len(part)) or found(part, unit))
    assert chunks.cut(np.array([4321]), np.array([8000])).tolist() == [3 * 4321]
    assert len(read) == 1 and read[0] <= 101


def test_empty_table(spark):
    assert infill.fill_in_middle(documents(spark, []).filter("false")).count() == 0


def test_nothing_is_shuffled(spark):
    plan = infill.fill_in_middle(documents(spark, texts()))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
