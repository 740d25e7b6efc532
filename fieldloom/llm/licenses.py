"""License scan: MinHash bands over overlapping windows retrieve templates, exact containment decides.

A window is as long as a template plus its stride; strides are an eighth of the length,
so some window holds any occurrence whole. At containment 0.8 such a window and the
template have a Jaccard similarity of 0.6 or more, and 32 bands of 2 rows then collide
with probability 1 - (1 - 0.36) ** 32 > 0.999999. Windows that hold fewer shingles of
templates of their length than containment asks for cannot match, and get no signature.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import id_and_text, map_arrow, sent, stage
from fieldloom.llm.license_texts import TEMPLATES
from fieldloom.llm.textvec import NON_ALNUM, Words, mix, shingle_sets, text_slices

WORDS = 5
CONTAINMENT = 0.8
BANDS, ROWS = 32, 2

_SEEDS = np.random.default_rng(5).integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """One key per band of a set's MinHash signature."""
    signature = np.array([mix(shingles ^ s).min() for s in _SEEDS], np.uint64).reshape(BANDS, ROWS)
    keys = np.arange(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + signature[:, r])
    return keys


class TemplateIndex:
    def __init__(self, templates: dict[str, str]):
        batch = pa.RecordBatch.from_arrays([pa.array(list(templates.values()), pa.string())], ["text"])
        self.names, self.sets, self.lengths = list(templates), [], []
        for _, _, data, offsets in text_slices(batch, limit=1 << 30):
            words = Words(data, offsets, NON_ALNUM)
            self.sets += shingle_sets(words, WORDS)
            self.lengths += np.diff(words.at).tolist()
        short = [n for n, k in zip(self.names, self.lengths, strict=True) if k < WORDS]
        if short:
            raise ValueError(f"templates of fewer than {WORDS} words: {', '.join(short)}")
        self.bands: dict[int, list[int]] = {}
        for t, s in enumerate(self.sets):
            for key in band_keys(s).tolist():
                self.bands.setdefault(key, []).append(t)
        self.sizes = sorted(set(self.lengths))
        self.known = {n: np.unique(np.concatenate([s for s, k in zip(self.sets, self.lengths, strict=True) if k == n])) for n in self.sizes}
        self.needs = {n: min(int(np.ceil(CONTAINMENT * len(s) - 1e-9)) for s, k in zip(self.sets, self.lengths, strict=True) if k == n) for n in self.sizes}
        self.any = np.unique(np.concatenate(self.sets))
        self.low = np.bincount((self.any & np.uint64(0xFFFFF)).astype(np.int64), minlength=1 << 20) > 0

    def scan(self, grams: np.ndarray, place: np.ndarray) -> dict[int, tuple[float, int]]:
        """template -> (containment, first word of the window), the best window of each, for one document's shingles."""
        out: dict[int, tuple[float, int]] = {}
        for n in self.sizes:
            hits = place[np.isin(grams, self.known[n])]
            if len(hits) < 1:
                continue
            stride = max(1, n // 8)
            reach = n + stride - WORDS  # shingles begin at 0 .. reach of a window's words
            first = np.unique(np.concatenate([np.arange((max(0, h - reach) + stride - 1) // stride, h // stride + 1) for h in np.unique(hits // stride) * stride + stride - 1])) * stride
            a, b = np.searchsorted(place, first), np.searchsorted(place, first + reach, "right")
            inside = np.searchsorted(hits, first + reach, "right") - np.searchsorted(hits, first)
            for k in np.flatnonzero(inside >= self.needs[n]):
                window = np.unique(grams[a[k] : b[k]])
                for t in {t for key in band_keys(window).tolist() for t in self.bands.get(key, ())}:
                    share = len(np.intersect1d(window, self.sets[t], assume_unique=True)) / len(self.sets[t])
                    if share >= CONTAINMENT and (t not in out or share > out[t][0]):
                        out[t] = (share, int(first[k]))
        return out


def _scan_batches(index):
    schema = pa.schema([("doc_id", pa.int64()), ("license", pa.string()), ("containment", pa.float64()), ("first_word", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = index.value
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            found: list[tuple] = []
            for a, _, data, offsets in text_slices(batch):
                words = Words(data, offsets, NON_ALNUM)
                grams, first = words.grams(WORDS)
                likely = np.flatnonzero(ix.low[(grams & np.uint64(0xFFFFF)).astype(np.int64)])
                likely = likely[np.isin(grams[likely], ix.any)]
                row = words.row[first]
                for r in np.unique(row[likely]).tolist():
                    lo, hi = np.searchsorted(row, r), np.searchsorted(row, r, "right")
                    for t, (share, at) in sorted(ix.scan(grams[lo:hi], first[lo:hi] - words.at[r]).items()):
                        found.append((ids[a + r], ix.names[t], share, at))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), schema, strict=True)], schema=schema)

    return run


def template_table(table: DataFrame) -> dict[str, str]:
    """Templates of a table (license, text), a few hundred rows that the driver holds; rows that lack either are left out."""
    return {r["license"]: r["text"] for r in table.select("license", "text").collect() if r["license"] and r["text"]}


def scan_licenses(docs: DataFrame, templates: dict[str, str] | DataFrame | None = None) -> DataFrame:
    """doc_id, license, containment, first_word: each template that a window of a document (doc_id, text) contains.

    Containment is the share of the template's 5-word shingles in the window, 0.8 at
    least; the best window counts, then the first. Words are runs of ASCII letters,
    digits and non-ASCII characters, A-Z lower-cased. Null, empty and short texts match
    nothing; whole texts are read, however long; rows without doc_id count as one
    document; repeated rows count once; extra columns are ignored; an empty table gives
    an empty result. Templates, by default ``license_texts.TEMPLATES``, may come as a
    table (license, text) and need five words or more.
    """
    templates = template_table(templates) if isinstance(templates, DataFrame) else templates
    with sent(docs.sparkSession, TemplateIndex(templates or TEMPLATES)) as index:
        found = stage(map_arrow(id_and_text(docs), _scan_batches(index), "doc_id long, license string, containment double, first_word long"), "licenses")
    best = F.max(F.struct("containment", (-F.col("first_word")).alias("minus"))).alias("b")
    return found.groupBy("doc_id", "license").agg(best).select("doc_id", "license", "b.containment", (-F.col("b.minus")).alias("first_word"))
