import struct
import zlib

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from fieldloom.llm import packing, tokens
from tests.llm.helpers import corpus, documents

BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
ODD = ["don't WE'LL 's", "a_b __ c--d !? ...", "café ² ½ x² Ⅷ", "é foo", "ΑΣ Σ", "İstanbul", "<|endoftext|> hi<|endoftext|>", "\x1c a\x1fb", "日本語 ٣", "한국어 가", "a b   c", "😀👍🏽 ok", "tab\tand\r\nline", " .foo ,bar  . ", "12345 1.5 a1b2", "ǅ ß ẞ", "  a  b \n\n c"]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_pieces_equal_whole_encoding(path):
    cache = tokens.PieceCache(path, tokens.pack_ids)
    t = Tokenizer.from_file(path)
    for text in [x or "" for _, x in corpus()] + ODD:
        assert b"".join(cache.parts(text)) == tokens.pack_ids(t.encode(text, add_special_tokens=False).ids), text[:40]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_pieces_on_any_text(text):
    for path in (BYTE, WORD):
        cache = tokens.piece_cache(path, tokens.pack_ids)
        assert b"".join(cache.parts(text)) == tokens.pack_ids(tokens.load_tokenizer(path).encode(text, add_special_tokens=False).ids)


def test_counts_and_cache(spark, tmp_path):
    texts = corpus() + [(500, "new text"), (1, corpus()[1][1])]
    t = Tokenizer.from_file(BYTE)
    docs = documents(spark, texts).withColumnRenamed("lang", "digest").withColumnRenamed("source", "n_tokens")
    want = sorted((i, len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for i, x in texts)
    path = str(tmp_path / "cache")
    first = tokens.token_counts(docs.filter("doc_id < 40"), BYTE, path)
    assert first.count() == docs.filter("doc_id < 40").count()
    held = spark.read.parquet(path).count()
    got = sorted((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in tokens.token_counts(docs, BYTE, path).collect())
    assert got == want
    after = spark.read.parquet(path).count()
    assert after > held and after == len({x or "" for _, x in texts})  # only distinct misses were added
    tokens.token_counts(docs, BYTE, path).count()
    assert spark.read.parquet(path).count() == after
    assert tokens.token_counts(docs.filter("false"), BYTE).count() == 0


def brute_best_fit(lengths, capacity):
    free = []
    for n in sorted(lengths, reverse=True):
        fits = [k for k, f in enumerate(free) if f >= n]
        if fits:
            k = min(fits, key=lambda k: free[k])
            free[k] -= n
        else:
            free.append(capacity - n)
    return len(free)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=120))
def test_plan_is_best_fit_decreasing(lengths):
    histogram = {n: lengths.count(n) for n in set(lengths)}
    slots = packing.plan_best_fit(histogram, 64)
    place = {}
    for length, first, n, sequence, per, offset in slots:
        for r in range(n):
            place[length, first + r] = (sequence + r // per, offset + r % per * length)
    assert len(place) == len(lengths)
    by_sequence = {}
    for (length, _), (s, o) in place.items():
        by_sequence.setdefault(s, []).append((o, length))
    for parts in by_sequence.values():
        at = 0
        for o, length in sorted(parts):
            assert o == at
            at += length
        assert at <= 64
    assert len(by_sequence) == brute_best_fit(lengths, 64)


def test_packed_documents(spark):
    texts = corpus() + [(1, corpus()[1][1]), (None, "no id")]
    out = packing.pack_documents(documents(spark, texts).withColumnRenamed("lang", "block").withColumnRenamed("source", "rank"), WORD).collect()
    t = Tokenizer.from_file(WORD)
    want = []
    for i, x in texts:
        ids = t.encode(x or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), 2048):
            part = ids[k : k + 2048]
            want.append((i, k // 2048, k, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))))
    key = lambda r: tuple(-1 if v is None else v for v in r)
    assert sorted((key(tuple(r)[:5]) for r in out)) == sorted(map(key, want))
    ends = {}
    for r in sorted(out, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= 2048
    assert packing.pack_documents(documents(spark, texts).filter("false"), WORD).count() == 0


def test_blocks_of_rows_that_are_alike(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANK_BLOCK", 100)
    rows = [(None, 0, 0, 5, 1)] * 3000 + [(4, 0, 0, 5, 2)] * 2000 + [(i, 0, 0, 7, i) for i in range(50)]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    sizes = packing.in_blocks(pieces.selectExpr("*", "monotonically_increasing_id() as row"), {5: 5000, 7: 50}).groupBy("length", "block").count().collect()
    assert len(sizes) == 51 and max(r["count"] for r in sizes) < 200
    ends = {}
    out = packing.pack(pieces, 64).collect()
    for r in sorted(out, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert len(out) == len(rows) and max(ends.values()) <= 64
    assert len(ends) == brute_best_fit([r[3] for r in rows], 64)


def test_only_vocabularies_with_the_known_settings_are_split(tmp_path):
    import json

    import public_tokenizers

    from fieldloom.llm import tokens

    for name, style in (("word_bpe_49k.json", "word"), ("byte_bpe_50k.json", "byte")):
        path = public_tokenizers.path(name)
        assert tokens.style_of(path) == style
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        spec["model"].update(vocab={}, merges=[])
        for change in (lambda s: s["model"].update(dropout=0.1), lambda s: s["model"].update(type="WordLevel"), lambda s: s.update(normalizer={"type": "NFKC"}), lambda s: s["pre_tokenizer"].update(type="Other", pretokenizers=[])):
            other = json.loads(json.dumps(spec))
            change(other)
            (tmp_path / "t.json").write_text(json.dumps(other))
            assert tokens.style_of(str(tmp_path / "t.json")) == ""
