"""Tokenizer access in workers, and token counts through a digest cache.

``token_counts`` joins digests of the contents and of the tokenizer to stored counts,
encodes only the distinct contents that the cache lacks, and appends them to it.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import id_and_text, kept, map_arrow, new_path, path_exists, stage

#: Pre-tokens that one generation of a worker's memory holds.
CACHE_ENTRIES = 300_000


@lru_cache(maxsize=2)
def load_tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


_CONTRACTIONS = r"'s|'t|'re|'ve|'m|'ll|'d|"
_STYLES = {
    "byte": re.compile(_CONTRACTIONS + r" ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"),
    "word": re.compile(_CONTRACTIONS + r"[^\W\d_]+|\d|(?:[^\s\w]|_)+"),
}


#: What the two known pre-tokenizers look like in a vocabulary file.
_BYTE_SPLIT = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
_WORD_BEFORE = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_WORD_SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
_WORD_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}


def style_of(path: str) -> str:
    """Which of the two known pre-tokenizers a vocabulary file has, all settings equal; '' if neither: texts are then encoded whole."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    before, split, model = spec.get("normalizer"), dict(spec.get("pre_tokenizer") or {}), spec.get("model") or {}
    if model.get("type") != "BPE" or model.get("dropout"):
        return ""
    same = lambda found, known: {k: v for k, v in found.items() if k != "trim_offsets"} == known
    if before is None and same(split, _BYTE_SPLIT):
        return "byte"
    parts = split.get("pretokenizers") or []
    if (before or {}).get("normalizers") == _WORD_BEFORE and len(parts) == 2 and parts[0] == _WORD_SPLIT and same(parts[1], _WORD_BYTES):
        return "word"
    return ""


def plain_char(c: str) -> bool:
    """Whether Python's classes agree with the tokenizer's for this character, on its own and beside any other."""
    kind = unicodedata.category(c)
    if kind[0] == "L":
        return c.isalpha() and unicodedata.normalize("NFC", c) == c and len(c.lower()) == 1 and c != "\u03a3" and not 0x1100 <= ord(c) <= 0x11FF
    if kind == "Nd":
        return c.isdecimal()
    return c in " \t\n\r\x0b\x0c" or (kind[0] in "PS" and not c.isalnum() and not c.isspace() and unicodedata.normalize("NFC", c) == c)


class PieceCache:
    """Encodes texts pre-token by pre-token and remembers what each gives.

    The two BPE families here never merge across pre-tokens, so a text's ids are those of
    its pre-tokens in order. Texts with a special token's string, or with a character on
    which Python's classes might differ from the tokenizer's, are encoded as a whole.
    Memory is bounded: two generations of ``CACHE_ENTRIES``; the older one is dropped.
    """

    def __init__(self, path: str, value):
        self.tokenizer, self.value, self.style = load_tokenizer(path), value, style_of(path)
        self.young, self.old = {}, {}
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.plain: set[str] = set()
        self.odd: set[str] = set()

    def _encode(self, texts: list[str]) -> list:
        return [self.value(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _is_plain(self, chars: set[str]) -> bool:
        for c in chars - self.plain:
            if not plain_char(c):
                return False
            self.plain.add(c)
            if not c.isalpha() and c not in " \n.,":
                self.odd.add(c)
        return True

    def _split(self, text: str, chars: set[str]) -> list[str]:
        """The pre-tokens of a plain text."""
        if self.style != "word":
            return _STYLES[self.style].findall(text)
        text = text.lower()
        if chars.isdisjoint(self.odd) and not (".." in text or ",," in text or ".," in text or ",." in text):
            # letters, single stops and commas, blanks: splitting at blanks gives the same as the pattern
            return text.replace(".", " . ").replace(",", " , ").split()
        return _STYLES[self.style].findall(text)

    def parts(self, text: str) -> list:
        """Values of the text's pre-tokens in order, or of the text as a whole."""
        chars = set(text)
        if not self.style or not self._is_plain(chars) or any(s in text for s in self.special):
            return self._encode([text])
        found = self._split(text, chars)
        values = list(map(self.young.get, found))
        if None not in values:
            return values
        young, old = self.young, self.old
        lacking = {p for p, v in zip(found, values, strict=True) if v is None}
        known = {p: old[p] for p in lacking if p in old}
        new = [p for p in lacking if p not in known]
        known.update(zip(new, self._encode(new), strict=True))
        if len(young) + len(known) > CACHE_ENTRIES:
            self.old, self.young = young, dict(known)
        else:
            young.update(known)
        return [known[p] if v is None else v for p, v in zip(found, values, strict=True)]


def piece_cache(path: str, value) -> PieceCache:
    """One memory per worker, kept from task to task until another operator runs there."""
    return kept((path, value.__name__), lambda: PieceCache(path, value))


def _count_batches(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = piece_cache(path, len)
        for batch in batches:
            counts = [sum(cache.parts(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(counts, pa.int64())], ["digest", "n_tokens"])

    return run


def tokenizer_version(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def token_counts(docs: DataFrame, tokenizer_path: str, cache_path: str | None = None, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row of ``docs`` (doc_id, text).

    Contents are normalised by reading null as empty and nothing else, since any further
    change of a text could change its count. The cache is a folder of Parquet files per
    tokenizer version; without ``cache_path`` it starts empty in the shared folder.
    Repeated rows give repeated rows; a null doc_id is kept as it is; whole texts are
    counted, however long; extra columns are ignored; an empty table gives an empty
    result; empty texts count 0. Retried or concurrent appends may store a digest
    twice, so the cache is read as one row per digest.
    """
    spark = docs.sparkSession
    store = f"{cache_path or new_path(spark, 'token-cache')}/version={tokenizer_version(tokenizer_path)}"
    keyed = id_and_text(docs).withColumn("digest", F.unhex(F.sha2("text", 256)))
    missing = keyed.select("digest", "text")
    if path_exists(spark, store):
        missing = missing.join(spark.read.parquet(store).select("digest"), "digest", "left_anti")
    counted = map_arrow(missing.dropDuplicates(["digest"]), _count_batches(tokenizer_path), "digest binary, n_tokens long", keeps=True)
    counted.write.mode("append").option("compression", "zstd").parquet(store)
    stored = spark.read.schema("digest binary, n_tokens long").parquet(store).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    stored = stage(stored, "counts")  # only then can Spark split the join where very many rows share a digest
    return (
        keyed.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes"))
        .join(stored, "digest")
        .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
    )


def pack_ids(ids: list[int]) -> bytes:
    return np.asarray(ids, "<u4").tobytes()
