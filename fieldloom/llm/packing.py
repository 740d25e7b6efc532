"""Best-fit packing planned on the histogram of lengths.

A plan sees counts per length, never documents: best-fit decreasing places runs of
equal lengths in runs of equally filled sequences. Documents then take planned slots
by joining on their rank within their length.
"""

from __future__ import annotations

import bisect
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.llm.common import id_and_text, map_arrow, stage
from fieldloom.llm.tokens import pack_ids, piece_cache

#: Rows of one length that one task ranks at most, on average.
RANK_BLOCK = 20_000
#: Slots up to which a plan is broadcast (about 10 MB); a larger one is joined by shuffle.
BROADCAST_SLOTS = 200_000


def plan_best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Slots (length, first_rank, n_ranks, first_sequence, per_sequence, offset) for best-fit decreasing.

    Items of a length with ranks first_rank .. first_rank + n_ranks - 1 fill sequences
    first_sequence, first_sequence + 1, ... with per_sequence items each, from offset on.
    Each length splits one group of sequences at most, so groups and slots depend on the
    number of distinct lengths (``capacity`` at most), not on the number of items.
    """
    slots: list[tuple[int, int, int, int, int, int]] = []
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)
    rooms: list[int] = []
    next_sequence = 0

    def put(left: int, start: int, n: int) -> None:
        if left > 0 and n > 0:
            if not room[left]:
                bisect.insort(rooms, left)
            room[left].append((start, n))

    def fill(length: int, rank: int, left_items: int, left: int, start: int, n: int) -> int:
        """Put items in n sequences that have ``left`` places each; returns how many were placed."""
        per = left // length
        whole = min(n, left_items // per)
        placed = whole * per
        if whole:
            slots.append((length, rank, placed, start, per, capacity - left))
            put(left - per * length, start, whole)
        extra = min(left_items - placed, per) if whole < n else 0
        if extra:
            slots.append((length, rank + placed, extra, start + whole, extra, capacity - left))
            put(left - extra * length, start + whole, 1)
        used = whole + (1 if extra else 0)
        put(left, start + used, n - used)
        return placed + extra

    for length in sorted(histogram, reverse=True):
        if not 1 <= length <= capacity:
            raise ValueError(f"length {length} is outside 1..{capacity}")
        rank, total = 0, histogram[length]
        while rank < total:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                left = rooms[at]
                start, n = room[left].pop()
                if not room[left]:
                    rooms.pop(at)
                rank += fill(length, rank, total - rank, left, start, n)
            else:
                per = capacity // length
                n = -(-(total - rank) // per)
                start, next_sequence = next_sequence, next_sequence + n
                rank += fill(length, rank, total - rank, capacity, start, n)
    return slots


def in_blocks(pieces: DataFrame, histogram: dict[int, int]) -> DataFrame:
    """Stored ``pieces`` with blocks and block: about ``RANK_BLOCK`` rows of one length each, whatever their ids and contents."""
    blocks = pieces.sparkSession.createDataFrame([(k, -(-n // RANK_BLOCK)) for k, n in histogram.items()], "length long, blocks long")
    return pieces.join(F.broadcast(blocks), "length").withColumn("block", F.pmod(F.xxhash64("doc_id", "piece", "row"), F.col("blocks")))


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """``pieces`` (doc_id, piece, length, ...) with sequence_id and offset added.

    Lengths must be 1..capacity. Ties of equal lengths go by doc_id, piece, start, then
    contents, within blocks of ``RANK_BLOCK`` rows; repeated rows each get a place. An
    empty table gives an empty result. The input is stored first, with a number for each
    row, so that rows alike in every column (null or repeated ids) spread over blocks.
    """
    spark, columns = pieces.sparkSession, pieces.columns
    pieces = stage(pieces.withColumn("row", F.monotonically_increasing_id()), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    slots = plan_best_fit(histogram, capacity)
    spread = in_blocks(pieces, histogram)
    sizes = spread.groupBy("length", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("length", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ties = [c for c in ("doc_id", "piece", "start", "ids_crc32") if c in columns]
    within = Window.partitionBy("length", "block").orderBy(*ties)
    ranked = spread.withColumn("place", F.row_number().over(within) - 1).join(bases, ["length", "block"]).withColumn("rank", F.col("base") + F.col("place"))
    plan = spark.createDataFrame(slots, "slot_length long, first_rank long, n_ranks long, first_sequence long, per_sequence long, first_offset long")
    if len(slots) <= BROADCAST_SLOTS:
        plan = F.broadcast(plan)
    at = F.col("rank") - F.col("first_rank")
    placed = ranked.join(plan, (F.col("length") == F.col("slot_length")) & (at >= 0) & (at < F.col("n_ranks")))
    return placed.select(
        *[F.col(c) for c in columns],
        (F.col("first_sequence") + F.floor(at / F.col("per_sequence"))).cast("long").alias("sequence_id"),
        (F.col("first_offset") + (at % F.col("per_sequence")) * F.col("length")).cast("long").alias("offset"),
    )


def _piece_batches(path: str, capacity: int, end_id: int):
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = piece_cache(path, pack_ids)
        end = pack_ids([end_id])
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [], [])
            size = 0
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = b"".join([*cache.parts(text), end])
                for piece, at in enumerate(range(0, len(ids) // 4, capacity)):
                    part = ids[4 * at : 4 * (at + capacity)]
                    for column, value in zip(rows, (doc_id, piece, at, len(part) // 4, part), strict=True):
                        column.append(value)
                size += len(ids)
                if size > 8_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema, strict=True)], schema=schema)
                    rows, size = ([], [], [], [], []), 0
            if rows[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema, strict=True)], schema=schema)

    return run


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids (little-endian unsigned 32-bit) of every row of ``docs`` (doc_id, text).

    A document's ids are those of its whole text followed by ``end_id``; only longer ones
    than ``capacity`` are cut. Null text is empty, so each row gives one piece at least.
    """
    return map_arrow(id_and_text(docs), _piece_batches(tokenizer_path, capacity, end_id), "doc_id long, piece int, start long, length long, ids binary", keeps=True)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids) of every piece of every document.

    Ties and repeated rows: see ``pack``. Null text counts as empty, a null doc_id is kept
    as it is, extra columns are ignored, an empty table gives an empty result. With
    ``keep_ids`` the token ids travel along.
    """
    pieces = token_pieces(docs, tokenizer_path, capacity, end_id).withColumn("ids_crc32", F.crc32("ids"))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])]
    return pack(pieces.select(*columns), capacity)
