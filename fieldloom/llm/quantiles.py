"""Mergeable quantile summaries: KLL compactors in NumPy, held against exact ranks.

A summary is a set of points on levels; a point of level h stands for 2 ** h values. Its
levels have geometric capacities, K on the top one and two thirds of the next below it.
Only when the points exceed the whole budget is the lowest level over its capacity
compacted: sorted, and the odd or the even places, as a seeded coin says (every second
time its opposite), go up a level with twice the weight. Summaries merge level by level.

While a summary is made it holds K_WORK points on its top level. The ranks of n values
are then wrong by a sum of independent coins of variance 1.5 (n / K_WORK) ** 2 at most,
or 0.1 % of n as a deviation. Cutting it to K for keeping compacts each level about once,
which adds 2 ** h on a level: two points of the top level at the very most, 2 / K of n.
A whole that is merged from kept summaries is cut once more. Together they stay below
2 % by several deviations at every size; what is measured is in the tests.

Values come in as counts per group and value, so that a group of any size brings each of
its values once from each task. Blocks of values, ``BLOCK_BITS`` wide, are summarised
first and then merged into batches, so no task meets a whole large group. Exact ranks
come from windows over the same counts: within blocks, and over the totals of blocks,
which go through the same function again if they are many.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.llm.common import map_arrow, partitions, stage

K, K_WORK = 300, 1200
SHRINK = 2 / 3
BATCHES = 4
PARTS = 4
#: A block holds 2 ** BLOCK_BITS values at most.
BLOCK_BITS = 14
#: Tolerated rank error and least size of a reported summary.
PER_MILLE, LEAST = 20, 20
KEY = ["stream", "grp", "batch"]
POINTS = "stream string, grp string, batch int, level int, x long, i int, points long"


def budget(k: int, levels: int) -> int:
    """Points that the capacities of so many levels allow."""
    return sum(capacity(k, h, levels) for h in range(levels))


def capacity(k: int, level: int, levels: int) -> int:
    return max(2, round(k * SHRINK ** (levels - 1 - level)))


class Summary:
    """KLL levels of sorted or unsorted points; level h weighs 2 ** h."""

    def __init__(self, k: int, seed: int):
        self.k, self.levels, self.coins, self.flips = k, [], np.random.default_rng(seed), {}

    def add(self, level: np.ndarray, x: np.ndarray) -> None:
        """Points, of this or of another summary, to their levels."""
        for h in range(int(level.max()) + 1 if len(level) else 0):
            if h == len(self.levels):
                self.levels.append(np.zeros(0, np.int64))
            self.levels[h] = np.concatenate([self.levels[h], x[level == h]])
        self.compact()

    def compact(self) -> None:
        while sum(map(len, self.levels)) > budget(self.k, len(self.levels)):
            n = len(self.levels)
            h = next(h for h, at in enumerate(self.levels) if len(at) > capacity(self.k, h, n))
            at = np.sort(self.levels[h])
            rest = at[len(at) & ~1 :]  # of an odd number the largest stays
            if h in self.flips:
                start = 1 - self.flips.pop(h)
            else:
                start = self.flips[h] = int(self.coins.integers(2))
            if h + 1 == n:
                self.levels.append(np.zeros(0, np.int64))
            self.levels[h + 1] = np.concatenate([self.levels[h + 1], at[start : len(at) & ~1 : 2]])
            self.levels[h] = rest

    def kept(self, k: int) -> Summary:
        self.k = k
        self.compact()
        return self

    def points(self) -> tuple[np.ndarray, np.ndarray]:
        return np.repeat(np.arange(len(self.levels)), [len(at) for at in self.levels]), np.concatenate([np.zeros(0, np.int64), *self.levels])


def split_counts(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, level): a value that was seen c times is a point on the level of each bit of c."""
    index, level = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for h in range(int(counts.max()).bit_length() if len(counts) else 0):
        at = np.flatnonzero((counts >> h) & 1)
        index.append(at)
        level.append(np.full(len(at), h))
    index, level = np.concatenate(index), np.concatenate(level)
    order = np.argsort(index, kind="stable")
    return index[order], level[order]


def _seed(stream: str, grp: str, batch: int) -> int:
    return int.from_bytes(f"{stream}\0{grp}\0{batch}".encode(), "little") % ((1 << 127) - 1)


def answers(level: np.ndarray, x: np.ndarray, parts: int) -> tuple[int, np.ndarray]:
    """How many values points stand for, and for each of parts - 1 quantiles the least point that the weights reach it with."""
    order = np.argsort(x, kind="stable")
    weight = np.cumsum(np.int64(1) << level[order])
    n = int(weight[-1])
    return n, x[order][np.searchsorted(weight, [-(-i * n // parts) for i in range(1, parts)])]


def _fold_batches(k: int, parts: int, least: int, keep: bool):
    """Points of each key's summary, from rows sorted by key that have a level or a count; with ``keep``, cut to ``K``, also its answers.

    Groups that end within a batch and stay within the budget of one level are passed on
    as they are, all at once; others are compacted one by one, a batch of rows at a time.
    """
    room = K if keep else k

    def told(key: list[pa.Array], at: np.ndarray, x: np.ndarray, level=None, i=None, points=None) -> pa.RecordBatch:
        """Points with a level, or answers with i and the number of points; ``at`` says which key each has."""
        rest = [pa.nulls(len(x), t) if v is None else pa.array(v, t) for v, t in ((level, pa.int32()), (x, pa.int64()), (i, pa.int32()), (points, pa.int64()))]
        return pa.RecordBatch.from_arrays([*(c.take(pa.array(at)) for c in key), *rest], [*KEY, "level", "x", "i", "points"])

    def one(key: tuple, summary: Summary) -> Iterator[pa.RecordBatch]:
        level, x = (summary.kept(K) if keep else summary).points()
        key = [pa.array([v], t) for v, t in zip(key, (pa.string(), pa.string(), pa.int32()), strict=True)]
        yield told(key, np.zeros(len(x), np.int64), x, level)
        n, found = answers(level, x, parts)
        if keep and n >= least:
            yield told(key, np.zeros(len(found), np.int64), found, None, np.arange(1, parts), np.full(len(found), len(x)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, summary = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            key, x = [batch.column(c) for c in range(3)], batch.column(4).to_numpy()
            row, level = split_counts(batch.column(3).to_numpy()) if batch.schema.names[3] == "c" else (np.arange(batch.num_rows), batch.column(3).to_numpy().astype(np.int64))
            new = np.zeros(batch.num_rows, bool)
            new[0] = True
            for c in key:
                new[1:] |= pc.not_equal(c.slice(1), c.slice(0, batch.num_rows - 1)).to_numpy(zero_copy_only=False)
            start = np.flatnonzero(new)
            edges = np.searchsorted(row, np.append(start, batch.num_rows))
            size, x = np.diff(edges), x[row]
            alone = size <= room
            alone[-1] = False  # may go on in the next batch
            name = lambda g: tuple(c[int(start[g])].as_py() for c in key)  # noqa: E731, B023
            if name(0) == open_key:
                alone[0] = False
            wholly = np.repeat(alone, size)
            if wholly.any():
                yield told(key, row[wholly], x[wholly], level[wholly])
                if keep:
                    group = np.repeat(np.arange(len(start)), size)[wholly]
                    order = np.lexsort((x[wholly], group))
                    group, ordered, weight = group[order], x[wholly][order], np.cumsum(np.int64(1) << level[wholly][order])
                    heads = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
                    before = np.append(0, weight[np.append(heads[1:], len(group)) - 1])
                    n = np.diff(before)
                    for i in range(1, parts):
                        at, enough = np.searchsorted(weight, before[:-1] - (-i * n // parts)), n >= least
                        of = group[heads][enough]
                        yield told(key, start[of], ordered[at[enough]], None, np.full(len(of), i), size[of])
            for g in np.flatnonzero(~alone):
                if open_key != name(g):
                    if summary is not None:
                        yield from one(open_key, summary)
                    open_key = name(g)
                    summary = Summary(k, _seed(*open_key))
                summary.add(level[edges[g] : edges[g + 1]], x[edges[g] : edges[g + 1]])
        if summary is not None:
            yield from one(open_key, summary)

    return run


def _folded(rows: DataFrame, dealt: list, what: str, k: int, parts: int, least: int, keep: bool) -> DataFrame:
    """Summaries by KEY of rows that are dealt out, and sorted, by further columns too."""
    spark = rows.sparkSession
    dealt = rows.repartition(partitions(spark), *dealt).sortWithinPartitions(*dealt)
    return map_arrow(dealt.select(*KEY, what, "x"), _fold_batches(k, parts, least, keep), POINTS)


def running(rows: DataFrame, key: list[str], low: int, high: int) -> DataFrame:
    """``rows`` (key, x, c, more) with n_upto, the sum of c up to x within the key, n_at, its part at x, and n, the key's whole.

    Sums run within blocks of values, and over the blocks' totals in the same way.
    """
    if (high >> BLOCK_BITS) - (low >> BLOCK_BITS) <= 1:  # on both sides of zero there are two at least
        over = Window.partitionBy(*key)
        return rows.withColumns({"n_upto": F.sum("c").over(over.orderBy("x")), "n_at": F.sum("c").over(over.orderBy("x").rangeBetween(Window.currentRow, Window.currentRow)), "n": F.sum("c").over(over)})
    spark = rows.sparkSession
    dealt = rows.withColumn("block", F.shiftright("x", BLOCK_BITS)).repartition(partitions(spark), *key, "block")
    totals = dealt.groupBy(*key, "block").agg(F.sum("c").alias("c")).withColumnRenamed("block", "x")
    before = running(totals, key, low >> BLOCK_BITS, high >> BLOCK_BITS).select(*key, F.col("x").alias("block"), (F.col("n_upto") - F.col("n_at")).alias("n_before"), "n")
    over = Window.partitionBy(*key, "block").orderBy("x")
    inside = dealt.withColumns({"n_inside": F.sum("c").over(over), "n_at": F.sum("c").over(over.rangeBetween(Window.currentRow, Window.currentRow))})
    return inside.join(before.hint("merge"), [*key, "block"]).withColumn("n_upto", F.col("n_inside") + F.col("n_before")).drop("block", "n_inside", "n_before")


def summarise(values: DataFrame, batches: int = BATCHES, parts: int = PARTS, per_mille: int = PER_MILLE, least: int = LEAST, k: int = K_WORK) -> DataFrame:
    """Quantiles of every group of ``values`` (stream, grp, batch, x, c), of each of its batches and of the whole (batch -1).

    x is a whole number, c the number of rows that have it; rows with the same x add up.
    Per summary of ``least`` values or more and i in 1 .. parts - 1: n, target (the exact
    ceil of i * n / parts), exact_x (the target-th smallest x), points (kept by the
    summary), answer (a value of the group, nondecreasing in i), n_below and n_upto (rows
    below, and up to, the answer), rank_error and within. The whole is made of the
    batches' summaries only. Ties of values are one value with a larger count. Rows
    without stream, grp, batch, x or c, or with a count below 1, take no part. Extra
    columns are ignored; an empty table gives an empty result.
    """
    spark = values.sparkSession
    given = F.col("c") > 0
    for name in (*KEY, "x"):
        given &= F.col(name).isNotNull()
    values = values.filter(given).groupBy(F.col("stream").cast("string"), F.col("grp").cast("string"), F.col("batch").cast("int"), F.col("x").cast("long")).agg(F.sum("c").alias("c")).toDF(*KEY, "x", "c")
    values = stage(values, "values")
    low, high = values.agg(F.coalesce(F.min("x"), F.lit(0)), F.coalesce(F.max("x"), F.lit(0))).first()
    # a block's values, then as many blocks at a time, up to one summary a batch
    made, shift, what = values, BLOCK_BITS, "c"
    while (high >> shift) - (low >> shift) > 1:
        made, what = _folded(made.withColumn("block", F.shiftright("x", shift)), [*KEY, "block"], what, k, parts, least, False).select(*KEY, "level", "x"), "level"
        shift += BLOCK_BITS
    batch = stage(_folded(made, KEY, what, k, parts, least, True), "batch_summaries")
    whole = stage(_folded(batch.filter("i IS NULL").withColumn("batch", F.lit(-1)), KEY, "level", k, parts, least, True), "whole_summaries")
    asked = batch.filter("i IS NOT NULL").unionByName(whole.filter("i IS NOT NULL")).select(*KEY, "x", F.lit(0).cast("long").alias("c"), "i", "points")
    all_values = values.unionByName(values.groupBy("stream", "grp", "x").agg(F.sum("c").alias("c")).withColumn("batch", F.lit(-1)))
    ranked = running(all_values.unionByName(asked, allowMissingColumns=True), KEY, low, high).filter(F.col("n") >= least)
    targets = F.array(*(F.struct(F.lit(i).alias("i"), F.expr(f"({i} * n + {parts - 1}) div {parts}").alias("target")) for i in range(1, parts)))
    held = F.filter(targets, lambda t: (t["target"] > F.col("n_upto") - F.col("c")) & (t["target"] <= F.col("n_upto")))
    of = F.when(F.col("i").isNull(), held).otherwise(F.filter(targets, lambda t: t["i"] == F.col("i")))
    told = ranked.withColumn("at", F.explode(of)).select(*KEY, F.col("at.i").alias("i"), "n", F.col("at.target").alias("target"), F.when(F.col("i").isNull(), F.col("x")).alias("exact_x"), "points", F.when(F.col("i").isNotNull(), F.struct(F.col("x"), (F.col("n_upto") - F.col("n_at")).alias("below"), F.col("n_upto").alias("upto"))).alias("found"))
    one = told.groupBy(*KEY, "i").agg(*(F.max(c).alias(c) for c in ("n", "target", "exact_x", "points")), F.max("found.x").alias("answer"), F.max("found.below").alias("n_below"), F.max("found.upto").alias("n_upto"))
    error = F.greatest(F.lit(0).cast("long"), F.col("n_below") + 1 - F.col("target"), F.col("target") - F.col("n_upto"))
    return one.withColumn("rank_error", error).withColumn("within", F.col("rank_error") * 1000 <= F.col("n") * per_mille)


def money_values(clicks: DataFrame, sale_lines: DataFrame, items: DataFrame, batches: int = BATCHES) -> DataFrame:
    """(stream, grp, batch, x, c): stream ``value`` of clicks, and ``price`` of sale lines with their items' prices.

    A click counts once; of rows with one click_id the first to arrive does, then the one
    of least client and value. Rows without click_id are clicks of their own. Of rows with
    one item_id the least brand and price count. Rows without item, group or money, NaN and
    infinities included, take no part; a missing id that only gives the batch counts as
    an empty text. Sale lines are counted per item and batch before they meet items.
    """
    batch = lambda c: (F.crc32(F.coalesce(F.col(c).cast("string"), F.lit(""))) % batches).cast("int")
    x = lambda money: (F.floor(100 * F.col(money) + 0.5) + 1000 * F.col("batch")).cast("long")
    is_money = lambda c: F.abs(c) < float("inf")
    clicks = clicks.select("click_id", "arrived_at", "client_id", F.col("value").cast("double").alias("value"))
    first = Window.partitionBy("click_id").orderBy("arrived_at", "client_id", "value")
    known = clicks.filter("click_id IS NOT NULL").withColumn("place", F.row_number().over(first)).filter("place = 1").drop("place")
    seen = known.unionByName(clicks.filter("click_id IS NULL")).filter(F.col("client_id").isNotNull() & is_money("value")).withColumn("batch", batch("click_id"))
    value = seen.select(F.lit("value").alias("stream"), F.col("client_id").cast("string").alias("grp"), "batch", x("value").alias("x"), F.lit(1).cast("long").alias("c"))
    lines = sale_lines.filter("item_id IS NOT NULL").groupBy("item_id", batch("vendor_id").alias("batch")).agg(F.count("*").alias("c"))
    sold = items.filter("item_id IS NOT NULL").groupBy("item_id").agg(F.min(F.struct("brand", F.col("price").cast("double").alias("price"))).alias("item"))
    sold = sold.select("item_id", "item.brand", "item.price").filter(F.col("brand").isNotNull() & is_money("price"))
    price = lines.join(sold.hint("merge"), "item_id").select(F.lit("price").alias("stream"), F.col("brand").alias("grp"), "batch", x("price").alias("x"), "c")
    return value.unionByName(price)
