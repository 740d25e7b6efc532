"""Quality selection by importance resampling over hashed n-gram models.

Two bags of hashed words and word pairs, one of target texts and one of all raw texts,
give each document a log importance weight: the sum over its n-grams of the log ratio of
the two models. Weight plus a Gumbel draw, keyed by doc_id, ranks documents; the top k
are a sample without replacement in proportion to the weights. With ``effective`` the
ranking is tempered instead: every document counts as that many n-grams, so that its
length does not decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import id_and_text, map_arrow, stage
from fieldloom.llm.textvec import NON_ALNUM, Words, text_slices

BUCKETS = 1 << 16
#: Share of the documents that is sampled.
FRACTION = 0.75
TARGET_BROADCAST = 1_000_000


def buckets(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of each word and each pair of words in a row."""
    pairs, first = words.grams(2)
    row = np.concatenate([words.row, words.row[first]])
    hashed = np.concatenate([words.hash, pairs])
    return row, (hashed >> np.uint64(20)).astype(np.int64) & (BUCKETS - 1)


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row of counts per bucket that occurs in the partition: all texts, and target texts."""
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        wanted = batch.column("target").to_numpy(zero_copy_only=False)
        for a, b, data, offsets in text_slices(batch):
            row, bucket = buckets(Words(data, offsets, NON_ALNUM))
            raw += np.bincount(bucket, minlength=BUCKETS)
            target += np.bincount(bucket[wanted[a:b][row]], minlength=BUCKETS)
    at = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])], ["bucket", "raw", "target"])


def _weight_batches(ratio: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, n = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for a, b, data, offsets in text_slices(batch):
                row, bucket = buckets(Words(data, offsets, NON_ALNUM))
                out[a:b], n[a:b] = np.bincount(row, ratio[bucket], b - a), np.bincount(row, minlength=b - a)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out), pa.array(n)], ["doc_id", "log_weight", "n_grams"])

    return run


def kth_largest(df: DataFrame, column: str, k: int) -> float | None:
    """The k-th largest value of a non-null double column, by histograms of 4096 cells, each over the cell before it.

    None if there are k values or fewer.
    """
    above = 0
    span = df.agg(F.count(column).alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).first()
    if span["n"] <= k:
        return None
    lower, upper = span["low"], span["high"]
    while lower < upper:
        width = (upper - lower) / 4096
        if width <= 0 or lower + width == lower:
            break
        inside = df.filter((F.col(column) >= lower) & (F.col(column) <= upper))
        step = F.least(F.floor((F.col(column) - lower) / width), F.lit(4095))
        cells = {r["c"]: (r["n"], r["low"], r["high"]) for r in inside.groupBy(step.alias("c")).agg(F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).collect()}
        for c in sorted(cells, reverse=True):
            n, low, high = cells[c]
            if above + n >= k:
                lower, upper = low, high
                break
            above += n
        if n <= 4096:  # few enough to look at
            values = sorted((r[0] for r in df.filter((F.col(column) >= lower) & (F.col(column) <= upper)).select(column).collect()), reverse=True)
            return values[k - above - 1]
    return lower


def kth_smallest_id(df: DataFrame, k: int) -> int | None:
    """The k-th smallest ``doc_id``, nulls last, of a table of longs; None if there are k or fewer."""
    ids = df.select(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("id"))
    # halves of 32 bits are exact as doubles
    halves = ids.select((-F.shiftright("id", 32)).cast("double").alias("high"), (-F.pmod("id", F.lit(1 << 32))).cast("double").alias("low"))
    high = kth_largest(halves, "high", k)
    if high is None:
        return None
    same = halves.filter(F.col("high") == high)
    place = k - halves.filter(F.col("high") > high).count()
    low = kth_largest(same, "low", place)
    return (int(-high) << 32) + int(-(same.agg(F.min("low")).first()[0] if low is None else low))


def gumbel(seed: int):
    """A Gumbel draw that depends on doc_id and ``seed`` alone."""
    uniform = (F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    return -F.log(-F.log(uniform))


def resample(docs: DataFrame, labels: DataFrame, fraction: float = FRACTION, seed: int = 17, effective: float | None = None) -> DataFrame:
    """doc_id, log_weight, gumbel_key, kept of every row of ``docs`` (doc_id, text); kept marks the sample.

    Target texts are rows labelled quality = 1. log_weight is the sum over a document's
    n-grams; gumbel_key adds the draw to it, or, with ``effective``, to ``effective``
    times its mean. The sample holds ceil(fraction * rows) documents; ties of keys go to
    the smaller doc_id, null ones last, and rows that tie in both are kept together. Null
    and empty texts have weight 0 (no evidence). Without target texts all weights are 0
    and the sample is uniform. Whole texts count, however long. Rows without doc_id share
    one draw and are no target. Repeated rows are drawn alike, each as a row; extra
    columns are ignored; an empty table gives an empty result.
    """
    good = labels.filter("quality = 1").select("doc_id").distinct().withColumn("target", F.lit(True))
    if good.count() <= TARGET_BROADCAST:
        good = F.broadcast(good)
    marked = id_and_text(docs).join(good, "doc_id", "left").select("text", F.coalesce("target", F.lit(False)).alias("target"))
    counts = map_arrow(marked, _count_batches, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()  # BUCKETS rows at most
    raw, target = np.ones(BUCKETS), np.ones(BUCKETS)
    at = counts["bucket"].to_numpy()
    raw[at] += counts["raw"].to_numpy()
    target[at] += counts["target"].to_numpy()
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum()) if counts.num_rows and counts["target"].to_numpy().any() else np.zeros(BUCKETS)
    ranked = F.col("log_weight") if effective is None else effective * F.col("log_weight") / F.greatest("n_grams", F.lit(1))
    keyed = map_arrow(id_and_text(docs), _weight_batches(ratio), "doc_id long, log_weight double, n_grams long")
    keyed = stage(keyed.select("doc_id", "log_weight", (ranked + gumbel(seed)).alias("gumbel_key")), "weights")
    k = int(np.ceil(fraction * keyed.count()))
    limit = kth_largest(keyed, "gumbel_key", k)
    if limit is None:
        return keyed.withColumn("kept", F.lit(True))
    free = k - keyed.filter(F.col("gumbel_key") > limit).count()
    last = kth_smallest_id(keyed.filter(F.col("gumbel_key") == limit), free)
    equal = F.lit(True) if last is None else F.coalesce("doc_id", F.lit((1 << 63) - 1)) <= last
    return keyed.withColumn("kept", (F.col("gumbel_key") > limit) | ((F.col("gumbel_key") == limit) & equal))
