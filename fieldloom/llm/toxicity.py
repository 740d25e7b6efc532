"""Toxicity scores from class-conditional Kneser-Ney models.

Two interpolated bigram models, one of toxic and one of ordinary labelled texts, share
their lowest order: continuation counts pooled over both classes. Each text is scored by
how the two models' log-likelihoods differ, normalised by length, over the whole text
and over its most toxic stretches; a logistic curve turns these differences into a
probability. The curve is fitted on a fold that the counts leave out.

Words are hashed to ``VOCABULARY`` numbers, so the tables by word have one size whatever
the corpus. Bigrams of these numbers keep their own counts: a table of all that recur,
which grows with the labelled texts. Its most frequent rows, ``HELD_PARTS`` times
``BIGRAMS`` at most, are broadcast in parts; the driver gathers one part at a time. The
others stay a table, and reach the texts that hold them by a join on the bigram and one
on the text's digest. Which way a count came changes no score (but for rounding).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import id_and_text, map_arrow, scratch, stage
from fieldloom.llm.textvec import NON_ALNUM, Words, text_slices

BITS = 20
VOCABULARY = 1 << BITS
BIGRAMS = 1 << 20
HELD_PARTS = 8
#: Slices in which the driver gathers a table by word.
SLICES = 4
#: First bytes of a word, under which rare words share evidence.
STEM_BYTES = 5
#: Rows of the left-out fold on which the curve is fitted, at most (by hash of doc_id, all if fewer).
CURVE_ROWS = 20_000
#: Labelled rows up to which labels are joined by broadcast (some 50 MB).
BROADCAST_LABELS = 1_000_000
WINDOWS = (1, 4, 16, 64)
FEATURES = 2 + 2 * len(WINDOWS)
_WORD = np.uint64(VOCABULARY - 1)


_HOLDS, _STEM = 1 << (2 * BITS), 2 << (2 * BITS)
#: Bits of a key; what is left of 63 holds a slice's row (``textvec.SLICE_ROWS``).
_KEY_BITS = 2 * BITS + 2


def part_number(keys, parts: int):
    """The part of the bigram table that holds a key."""
    return (keys ^ (keys >> BITS)) % parts


class Pairs:
    """Counts [2, keys] of bigrams, 0 for those not in the table. parts: (sorted keys, counts) each, or broadcasts of that."""

    def __init__(self, parts: list):
        self.parts = parts

    def counts(self, keys: np.ndarray, joined: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        """``joined``: (sorted keys, counts) of bigrams that no part holds."""
        out = np.zeros((2, len(keys)), np.float32)
        part_of = part_number(keys, len(self.parts)) if len(self.parts) > 1 else None
        for k, part in enumerate(self.parts):
            own = np.flatnonzero(part_of == k) if part_of is not None else slice(None)
            known, n = getattr(part, "value", part)
            if len(known):
                at = np.minimum(np.searchsorted(known, keys[own]), len(known) - 1)
                out[:, own] = np.where(known[at] == keys[own], n[:, at], 0)
        if joined is not None and len(joined[0]):
            at = np.minimum(np.searchsorted(joined[0], keys), len(joined[0]) - 1)
            out += np.where(joined[0][at] == keys, joined[1][:, at], 0)
        return out


class Model:
    """What workers score with: a broadcast KneserNey, and the broadcast parts of its bigram table. rare: what is not broadcast of that, or None."""

    def __init__(self, tables, parts: list, rare: DataFrame | None = None):
        self.tables, self.parts, self.rare = tables, parts, rare

    def __getstate__(self) -> dict:
        return {"tables": self.tables, "parts": self.parts, "rare": None}  # workers get no tables

    @property
    def value(self) -> KneserNey:
        model = self.tables.value
        model.pairs = Pairs(self.parts)
        return model

    def destroy(self) -> None:
        """Frees the tables everywhere; nothing can be scored any more."""
        for b in (self.tables, *self.parts):
            b.destroy()


def word_numbers(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the word, number of the word before it, number of its stem); a row's first word follows number 0."""
    number = (words.hash & _WORD).astype(np.int64)
    before = np.zeros_like(number)
    before[1:] = number[:-1]
    starts = words.at[:-1][words.at[:-1] < words.at[1:]]
    before[starts] = 0
    return number, before, (words.prefix_hash(STEM_BYTES) & _WORD).astype(np.int64)


def document_keys(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) once for each bigram, word and stem that a row holds."""
    number, before, stem = word_numbers(words)
    row = words.row << _KEY_BITS
    marks = np.sort(np.concatenate([row | (before << BITS) | number, row | _HOLDS | number, row | _STEM | stem]))
    first = np.ones(len(marks), bool)
    first[1:] = marks[1:] != marks[:-1]
    marks = marks[first]
    return marks >> _KEY_BITS, marks & ((1 << _KEY_BITS) - 1)


class KneserNey:
    """Log-likelihood ratios of toxic to ordinary text, per word. All counts are of documents.

    pairs: Pairs, documents with a bigram, where two or more (a bigram of one document
    is discounted whole); total, single, more: [2, VOCABULARY] for a word as
    history, the bigrams' documents summed, and its bigrams of one and of more documents;
    before: [2, VOCABULARY] distinct predecessors of a word, but no more than documents
    that hold it; pooled: [VOCABULARY] distinct predecessors over both classes; stems:
    [2, VOCABULARY] documents with a stem.
    """

    def __init__(self, pairs, total, single, more, before, pooled, stems, discount: float = 0.9, prior: float = 2.0):
        self.discount, self.pairs, self.total = discount, pairs, total.astype(np.float32)
        shared = (pooled + 0.5) / (pooled.sum() + 0.5 * len(pooled))
        self.low, self.left, self.rest, self.stem = (np.empty((2, len(pooled)), np.float32) for _ in range(4))
        mass = np.maximum(stems.sum(axis=1).astype(float), 1)
        for c in range(2):
            n = max(1.0, float(before[c].sum()))
            share = discount * np.count_nonzero(before[c]) / n if before[c].any() else 1.0
            self.low[c] = np.maximum(before[c] - discount, 0) / n
            self.left[c] = share * shared
            self.rest[c] = np.where(total[c] > 0, (single[c] + discount * more[c]) / np.maximum(total[c], 1), 1.0)
            self.stem[c] = (stems[c] + prior) / (stems.sum(axis=0) * mass[c] / mass.sum() + prior)

    def ratios(self, number: np.ndarray, before: np.ndarray, stem: np.ndarray, joined=None) -> tuple[np.ndarray, np.ndarray]:
        """Of each word after its predecessor, and of each word alone. joined: see ``Pairs.counts``."""
        pairs = self.pairs.counts((before << BITS) | number, joined)
        low = [self.low[c][number] + self.left[c][number] * self.stem[c][stem] for c in range(2)]
        p = [np.maximum(pairs[c] - np.float32(self.discount), 0) / np.maximum(self.total[c][before], 1) + self.rest[c][before] * low[c] for c in range(2)]
        return np.log(p[1] / p[0]), np.log(low[1] / low[0])


def features(words: Words, model: KneserNey, joined=None) -> np.ndarray:
    """[rows, FEATURES]: mean ratios of the whole text, and the largest mean over each window length. joined: see ``Pairs.counts``."""
    out = np.zeros((words.rows, FEATURES))
    if not len(words.hash):
        return out
    lengths = np.diff(words.at)
    filled = np.flatnonzero(lengths)
    starts = words.at[:-1][filled]
    last = words.at[words.row + 1]
    for k, ratio in enumerate(model.ratios(*word_numbers(words), joined)):
        sums = np.concatenate(([0.0], np.cumsum(ratio.astype(np.float64))))
        out[filled, k] = (sums[words.at[1:][filled]] - sums[starts]) / lengths[filled]
        for j, w in enumerate(WINDOWS):
            # the mean over up to w words from each word on; what lies beyond the text counts as 0
            ends = np.minimum(np.arange(len(ratio)) + w, last)
            out[filled, 2 + 2 * j + k] = np.maximum.reduceat((sums[ends] - sums[:-1]) / w, starts)
    return out


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means, scales and weights (last: constant) of a ridge logistic regression, by Newton steps."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (p - y) + ridge * len(y) * 0.01 * w
        hess = (z * (p * (1 - p))[:, None]).T @ z + np.eye(len(w)) * (ridge * len(y) * 0.01 + 1e-9)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w


def fold_of(column: str = "doc_id"):
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(5))


def _key_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        toxic = batch.column("toxic").to_numpy(zero_copy_only=False)
        for a, b, data, offsets in text_slices(batch):
            row, keys = document_keys(Words(data, offsets, NON_ALNUM))
            keys, n = np.unique((keys << 1) | toxic[a:b][row], return_counts=True)
            counts = n.astype(np.int64) << (32 * (keys & 1))
            yield pa.RecordBatch.from_arrays([pa.array(keys >> 1), pa.array(counts)], ["key", "n"])


def _rare_key_batches(model):
    """Per text the bigrams that no broadcast part holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, found = [np.zeros(1, np.int64)], [np.zeros(0, np.int64)]
            for _, _, data, offsets in text_slices(batch):
                words = Words(data, offsets, NON_ALNUM)
                row, keys = document_keys(words)
                new = np.flatnonzero(keys < _HOLDS)
                new = new[~model.value.pairs.counts(keys[new]).any(axis=0)]
                ends.append(ends[-1][-1] + np.searchsorted(row[new], np.arange(words.rows), "right"))
                found.append(keys[new])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(ends), pa.int32()), pa.array(np.concatenate(found)))
            yield pa.RecordBatch.from_arrays([batch.column("digest"), lists], ["digest", "keys"])

    return run


def with_rare(texts: DataFrame, model: Model) -> DataFrame:
    """``texts`` with rare: (key, ordinary, toxic) of the bigrams in each that recur but are not broadcast; unchanged if all are.

    Bigrams are looked up once per distinct text. A list holds no more than its text does.
    """
    if model.rare is None:
        return texts
    texts = texts.withColumn("digest", F.md5("text"))
    keys = map_arrow(texts.select("digest", "text"), _rare_key_batches(model), "digest string, keys array<long>")
    keys = keys.groupBy("digest").agg(F.first("keys").alias("keys")).select("digest", F.explode("keys").alias("key"))
    rare = keys.join(model.rare, "key").groupBy("digest").agg(F.collect_list(F.struct("key", "ordinary", "toxic")).alias("rare"))
    return texts.join(rare, "digest", "left").drop("digest")


def joined_counts(batch: pa.RecordBatch, a: int, b: int) -> tuple[np.ndarray, np.ndarray] | None:
    """What ``with_rare`` joined to rows a..b-1, as ``Pairs.counts`` takes it."""
    if "rare" not in batch.schema.names:
        return None
    key, *counts = (x.to_numpy(zero_copy_only=False) for x in batch.column("rare").slice(a, b - a).flatten().flatten())
    key, first = np.unique(key, return_index=True)
    return key, np.array([c[first] for c in counts], np.float32)


def _feature_batches(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(Words(data, offsets, NON_ALNUM), model.value, joined_counts(batch, a, b)) for a, b, data, offsets in text_slices(batch)]
            x = np.concatenate(rows) if rows else np.zeros((0, FEATURES))
            flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), FEATURES).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), flat], ["doc_id", "toxic", "x"])

    return run


def apply_curve(x: np.ndarray, curve) -> np.ndarray:
    mean, scale, weights = curve[:3]
    return 1 / (1 + np.exp(-np.clip(np.column_stack([(x - mean) / scale, np.ones(len(x))]) @ weights, -30, 30)))


def _score_batches(model, curve):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [np.zeros(0)]
            for a, b, data, offsets in text_slices(batch):
                words = Words(data, offsets, NON_ALNUM)
                parts.append(np.where(np.diff(words.at) > 0, apply_curve(features(words, model.value, joined_counts(batch, a, b)), curve), curve[3]))
            scores = np.concatenate(parts)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores)], ["doc_id", "score"])

    return run


def _dense(df: DataFrame, index: str, columns: list[str], size: int) -> np.ndarray:
    """Columns of a table of at most ``size`` rows as dense arrays over ``index``; the driver gathers it in slices."""
    stored = stage(df.select(F.col(index).cast("int").alias(index), *[F.col(c).cast("float").alias(c) for c in columns]), "by-word")
    out = np.zeros((len(columns), size), np.float32)
    for k in range(SLICES):
        got = stored.filter(F.col(index) % SLICES == k).toArrow()
        at = got[index].to_numpy()
        for row, c in zip(out, columns, strict=True):
            row[at] = got[c].to_numpy()
        del got, at
        pa.default_memory_pool().release_unused()
    return out


def recurring(bigrams: DataFrame) -> DataFrame:
    """(key, ordinary, toxic), stored: documents of either class with a bigram, of those that recur in a class."""
    often = [F.when(F.col(c) > 1, F.col(c)).otherwise(0).cast("float").alias(c) for c in ("ordinary", "toxic")]
    return stage(bigrams.filter("toxic > 1 or ordinary > 1").select("key", *often), "bigrams")


def held_and_rare(repeated: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The most frequent rows, ``HELD_PARTS`` * ``BIGRAMS`` at most, and the others (None if there are none)."""
    level = F.floor(F.log2(F.col("ordinary") + F.col("toxic")) * 8)
    sizes = {r["level"]: r["n"] for r in repeated.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect()}  # some 500 rows at most
    held, least = 0, 0
    for k in sorted(sizes, reverse=True):
        held += sizes[k]
        if held > HELD_PARTS * BIGRAMS:
            least = k + 1
            break
    else:
        return repeated, None
    return repeated.filter(level >= least), repeated.filter(level < least)


def pair_counts(bigrams: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Parts of (sorted keys, [2, keys] documents of either class) of the bigrams that recur in a class, from (key, toxic, ordinary)."""
    return in_parts(recurring(bigrams))


def in_parts(repeated: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(sorted keys, [2, keys] counts) of a stored table (key, ordinary, toxic), ``BIGRAMS`` keys or so at a time."""
    parts = max(1, -(-repeated.count() // BIGRAMS))
    part = F.col("key").bitwiseXOR(F.shiftright("key", BITS)) % parts
    for k in range(parts):
        got = repeated.filter(part == k).toArrow()
        keys = got["key"].to_numpy()
        order = np.argsort(keys)
        found = keys[order], np.array([got[c].to_numpy()[order] for c in ("ordinary", "toxic")])
        del got, keys, order
        pa.default_memory_pool().release_unused()
        yield found


def labelled_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, toxic, fold of the rows that labels may be learned from: folds 1 to 4.

    Labels are joined by broadcast where they are few, by shuffle beyond ``BROADCAST_LABELS``.
    """
    known = labels.filter(F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("long").alias("toxic")).filter(fold_of() != 0)
    if known.count() <= BROADCAST_LABELS:
        known = F.broadcast(known)
    return id_and_text(docs).join(known, "doc_id").withColumn("fold", fold_of())


def curve_rows(labelled: DataFrame) -> DataFrame:
    """The rows up to the ``CURVE_ROWS``-th by hash of doc_id, with all that repeat its doc_id; texts are not read to find it."""
    place = F.struct(F.xxhash64("doc_id").alias("h"), F.col("doc_id"))
    last = labelled.select(place.alias("place")).orderBy("place").limit(CURVE_ROWS).agg(F.max("place").alias("last")).first()["last"]
    if last is None:
        return labelled.filter("false")
    h = F.xxhash64("doc_id")
    return labelled.filter((h < last["h"]) | ((h == last["h"]) & (F.col("doc_id") <= last["doc_id"])))


def fit(docs: DataFrame, labels: DataFrame):
    """(Model, curve) from labelled rows; fold 1 fits the curve, folds 2-4 are counted. Last in the curve: the share of toxic rows."""
    spark = docs.sparkSession
    learn = labelled_texts(docs, labels)
    keys = map_arrow(learn.filter("fold > 1").select("text", "toxic"), _key_batches, "key long, n long")
    counts = stage(keys.groupBy("key").agg(F.sum("n").alias("n")), "ngrams")
    mask = VOCABULARY - 1
    counts = counts.select("key", F.shiftright("key", 2 * BITS).alias("kind"), F.shiftright("n", 32).alias("toxic"), F.col("n").bitwiseAND((1 << 32) - 1).alias("ordinary"))
    bigrams = counts.filter("kind = 0")
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    word, history = F.col("key").bitwiseAND(mask), F.shiftright("key", BITS)
    by_word = bigrams.groupBy(word.alias("w")).agg(one(F.col("ordinary") > 0).alias("b0"), one(F.col("toxic") > 0).alias("b1"), F.count("*").alias("pooled"))
    by_history = bigrams.groupBy(history.alias("w")).agg(
        *[f(F.col(c)).alias(f"{n}{k}") for n, f in (("t", F.sum), ("s", lambda x: one(x == 1)), ("m", lambda x: one(x > 1))) for k, c in enumerate(("ordinary", "toxic"))]
    )
    before = _dense(by_word, "w", ["b0", "b1", "pooled"], VOCABULARY)
    after = _dense(by_history, "w", ["t0", "t1", "s0", "s1", "m0", "m1"], VOCABULARY)
    holds, stems = (_dense(counts.filter(F.col("kind") == k).select(word.alias("w"), "ordinary", "toxic"), "w", ["ordinary", "toxic"], VOCABULARY) for k in (1, 2))
    held, rare = held_and_rare(recurring(bigrams))
    parts = [spark.sparkContext.broadcast(part) for part in in_parts(held)]
    model = Model(spark.sparkContext.broadcast(KneserNey(None, after[0:2], after[2:4], after[4:6], np.minimum(before[:2], holds), before[2], stems)), parts, rare)

    taken = with_rare(curve_rows(learn.filter("fold = 1").select("doc_id", "toxic", "text")), model)
    seen = map_arrow(taken, _feature_batches(model), "doc_id long, toxic long, x array<double>")
    sample = seen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(CURVE_ROWS).toArrow()
    y = sample["toxic"].to_numpy().astype(float)
    x = np.array(sample["x"].to_pylist(), float).reshape(len(y), FEATURES)
    share = float(y.mean()) if len(y) else 0.0
    if 0 < share < 1:
        return model, (*fit_curve(x, y), share)
    constant = -30.0 if not share else 30.0  # labels of one class, or none
    return model, (np.zeros(FEATURES), np.ones(FEATURES), np.array([0.0] * FEATURES + [constant]), share)


def score(docs: DataFrame, model, curve) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs`` (doc_id, text)."""
    scored = map_arrow(with_rare(id_and_text(docs), model), _score_batches(model, curve), "doc_id long, score double")
    return scored.select("doc_id", (fold_of() == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs`` (doc_id, text), learned from ``labels`` (doc_id, toxic).

    Only labels of rows whose crc32(doc_id as text) mod 5 is not 0 are learned from.
    Null and empty texts and those without words get the share of toxic rows as score. Labels other than 0
    and 1 are ignored; if a doc_id is labelled twice, 1 counts. With labels of one class
    only that class is predicted, with none class 0. Whole texts are scored, however long;
    a null doc_id is no held-out row (held_out null) and has no label. Repeated rows
    repeat their result; extra columns are ignored; an empty table gives an empty result.
    The result is stored.
    """
    with scratch(docs.sparkSession, "scores") as keep:
        model, curve = fit(docs, labels)
        out = keep(score(docs, model, curve))
        model.destroy()
    return out
