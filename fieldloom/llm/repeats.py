"""Removal of word passages that occur more than once, found by fixed-block anchors.

Each text is cut into blocks of ``BLOCK`` words that do not overlap: the reference. A
window of ``WINDOW`` = 2 * BLOCK - 1 words holds exactly one whole block of its own
text, so two equal windows meet where the block of one equals a run of BLOCK words, at
whatever place, of the other. Every such run of every text is therefore probed against
the reference. Runs that equal a block and occur at two places are hits; a hit is
extended word by word to both sides, as far as a window around it reaches. Windows of
equal extension form a class, told by a hash of the whole window, and a class with two
members is a repeat. Classes, unlike pairs, grow with the text only; the repeats that
overlap or touch make up the maximal repeated passages that are removed.

Texts travel in packs of about a megabyte. A pack sends each distinct hash once: what
occurs twice in one pack is known to repeat and asks for no answer, so a passage that
all texts share costs one entry a pack. A bucket of hashes answers with the places that
repeat; it holds one entry per distinct hash, whatever the number of copies. Packs are
stored once, bucketed by the task that made them, and both joins of answers to texts
leave the texts where they lie.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import id_and_text, map_arrow, new_path, partitions, stage
from fieldloom.llm.textvec import Words, text_bytes, text_slices
from fieldloom.staging import small_batches

BLOCK = 18
WINDOW = 2 * BLOCK - 1
#: Bytes of text in a pack; a longer text is a pack of its own.
PACK_BYTES = 1 << 20
#: Buckets of hashes per shuffle partition.
BUCKETS_EACH = 4
#: The step of the hash that deals windows to buckets; independent of the one that tells them apart there.
_OTHER_STEP = np.uint64(0xA24BAED4963EE407)
REF, KNOWN, ASK, FOUND = range(4)
ENTRY = "bucket int, kind int, run int, pack int, hashes binary, places binary"
ANSWER = "run int, pack int, places binary"

#: DuckDB SQL: every window of every text, counted; words are made one-character apart by the same separators.
ORACLE_SQL = r"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
     starts AS (SELECT r, unnest(range(1, len(w) - 33)) AS p FROM texts WHERE len(w) >= 35),
     windows AS (SELECT s.r, s.p, sha256(array_to_string(t.w[s.p:s.p + 34], ' ')) AS h FROM starts s JOIN texts t USING (r)),
     repeated AS (SELECT r, p FROM windows WHERE h IN (SELECT h FROM windows GROUP BY h HAVING count(*) > 1)),
     gone AS (SELECT DISTINCT r, p + k AS p FROM repeated, range(0, 35) AS o(k)),
     lists AS (SELECT r, list(p) AS p FROM gone GROUP BY r)
SELECT t.doc_id, len(t.w) AS n_words, coalesce(len(l.p), 0) AS n_removed,
       sha256(array_to_string(list_transform(list_filter(list_zip(t.w, range(1, len(t.w) + 1)), lambda x: NOT list_contains(coalesce(l.p, []), x[2])), lambda x: x[1]), ' ')) AS kept_sha256
FROM texts t LEFT JOIN lists l USING (r)
"""


def _pack_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of texts that lie side by side, numbered within the task."""
    run, number = TaskContext.get().partitionId(), 0
    for batch in batches:
        for a, b, _, _ in text_slices(batch, limit=PACK_BYTES):
            part = batch.slice(a, b - a)
            ids, texts = (pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), part.column(k)) for k in range(2))
            yield pa.RecordBatch.from_arrays([pa.array([run], pa.int32()), pa.array([number], pa.int32()), ids, texts], ["run", "pack", "ids", "texts"])
            number += 1


def _packs(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    """(run, pack, texts, further columns' values) of each row."""
    for batch in batches:
        run, pack, texts = (batch.column(batch.schema.get_field_index(c)) for c in ("run", "pack", "texts"))
        more = [batch.column(batch.schema.get_field_index(c)) for c in columns]
        for i in range(batch.num_rows):
            yield run[i].as_py(), pack[i].as_py(), texts[i].values, *(c[i] for c in more)


def _words(texts: pa.Array) -> Words:
    data, offsets = text_bytes(texts)
    return Words(data[offsets[0] : offsets[-1]], offsets - offsets[0], fold=False)


def _cell_shift(n: int) -> int:
    """Places of a pack of n words are told in 16 bits, to 2 ** shift words."""
    return max(0, max(n - 1, 0).bit_length() - 16)


def _rows(kind: int, run: int, pack: int, buckets: int, bucket: np.ndarray, hashes: np.ndarray, places: np.ndarray | None) -> pa.RecordBatch:
    """One row per bucket that has entries; these are sorted by bucket."""
    bounds = np.searchsorted(bucket, np.arange(buckets + 1))
    full = np.flatnonzero(np.diff(bounds))
    edges = np.append(bounds[full], len(bucket))

    def column(values: np.ndarray | None) -> pa.Array:
        if values is None:
            return pa.nulls(len(full), pa.binary())
        return pa.Array.from_buffers(pa.binary(), len(full), [None, pa.py_buffer((edges * values.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])

    same = lambda x: pa.array(np.full(len(full), x, np.int32))
    return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), same(kind), same(run), same(pack), column(hashes), column(places)], ["bucket", "kind", "run", "pack", "hashes", "places"])


def _sent(run: int, pack: int, buckets: int, bucket: np.ndarray, hashes: np.ndarray, places: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A pack's entries: hashes that occur once ask, others are known and found already."""
    order = np.argsort(hashes)
    order = order[np.argsort(bucket[order].astype(np.uint16 if buckets <= 1 << 16 else np.int64), kind="stable")]
    bucket, hashes, places = bucket[order], hashes[order], places[order]
    first = np.ones(len(order), bool)
    first[1:] = (hashes[1:] != hashes[:-1]) | (bucket[1:] != bucket[:-1])
    last = np.append(first[1:], True)
    alone = first & last
    yield _rows(ASK, run, pack, buckets, bucket[alone], hashes[alone], places[alone])
    if not alone.all():
        head = first & ~last
        yield _rows(KNOWN, run, pack, buckets, bucket[head], hashes[head], None)
        found = np.unique(places[~alone])
        yield _rows(FOUND, run, pack, buckets, np.full(len(found), pack % buckets), found, found)


def _probe_batches(buckets: int):
    """Reference blocks of each pack, and all its runs of BLOCK words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for task, pack, texts in _packs(batches):
            words = _words(texts)
            grams, first = words.grams(BLOCK)
            if not len(grams):
                continue
            bucket, hashes = (grams >> np.uint64(32)) % np.uint64(buckets), grams.astype(np.uint32)
            block = (first - words.at[words.row[first]]) % BLOCK == 0
            refs = np.unique((bucket[block] << np.uint64(32)) | hashes[block])
            yield _rows(REF, task, pack, buckets, refs >> np.uint64(32), refs.astype(np.uint32), None)
            yield from _sent(task, pack, buckets, bucket, hashes, (first >> _cell_shift(len(words.hash))).astype(np.uint16))

    return run


def _extend_batches(buckets: int):
    """Windows around the hits of each pack."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for task, pack, texts, hits in _packs(batches, "hits"):
            words = _words(texts)
            n = len(words.hash)
            shift = _cell_shift(n)
            cells = np.unique(np.concatenate([np.frombuffer(x, np.uint16) for x in hits.as_py()])).astype(np.int64)
            near = np.zeros(n + 1, np.int64)
            np.add.at(near, np.maximum((cells << shift) - (WINDOW - BLOCK), 0), 1)
            np.add.at(near, np.minimum((cells + 1) << shift, n), -1)
            grams, first = words.grams(WINDOW)
            other, _ = words.grams(WINDOW, _OTHER_STEP)
            near = np.cumsum(near)[first] > 0
            if near.any():
                yield from _sent(task, pack, buckets, other[near] % np.uint64(buckets), grams[near], first[near].astype(np.uint32))

    return run


def _inside(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which values are in a sorted array."""
    if not len(among):
        return np.zeros(len(values), bool)
    at = np.searchsorted(among, values)
    return among[np.minimum(at, len(among) - 1)] == values


class _Bucket:
    """What has been seen of one bucket: one waiting place per hash that was seen once."""

    def __init__(self, hash_type, place_type, by_reference: bool):
        self.types, self.by_reference = (hash_type, place_type), by_reference
        self.refs = self.sure = np.zeros(0, hash_type)
        self.more_refs, self.more_sure, self.asking, self.pending = [], [], [], 0
        self.owners: list[tuple[int, int]] = []
        self.waiting = (np.zeros(0, hash_type), np.zeros(0, np.int64), np.zeros(0, place_type))

    def take(self, kind: int, owner: tuple[int, int], hashes: bytes, places: bytes | None) -> Iterator[tuple]:
        values = np.frombuffer(hashes, self.types[0])
        if kind == REF:
            self.more_refs.append(values)
            if sum(map(len, self.more_refs)) > max(1 << 16, len(self.refs)):
                self._known()
            return
        if kind == KNOWN:
            self.more_sure.append(values)
            if sum(map(len, self.more_sure)) > max(1 << 16, len(self.sure)):
                self._known()
            return
        if self.more_refs or self.more_sure:
            self._known()
        at = np.frombuffer(places, self.types[1])
        if self.by_reference:
            wanted = _inside(values, self.refs)
            values, at = values[wanted], at[wanted]
        if len(values):
            self.asking.append((values, np.full(len(values), len(self.owners)), at))
            self.owners.append(owner)
            self.pending += len(values)
            if self.pending > max(1 << 16, len(self.waiting[0])):
                yield from self.answer()

    def _known(self) -> None:
        self.refs = np.unique(np.concatenate([self.refs, *self.more_refs]))
        self.sure = np.unique(np.concatenate([self.sure, *self.more_sure]))
        if self.by_reference:
            self.sure = self.sure[_inside(self.sure, self.refs)]
        self.more_refs, self.more_sure = [], []

    def answer(self) -> Iterator[tuple]:
        """(run, pack, places) that repeat, as far as is known by now; a hash's first place is given with its second."""
        if not self.pending:
            return
        hashes, owner, place = (np.concatenate(x) for x in zip(self.waiting, *self.asking, strict=True))
        order = np.argsort(hashes, kind="stable")
        hashes, owner, place = hashes[order], owner[order], place[order]
        first = np.append(True, hashes[1:] != hashes[:-1])
        twice = ~(first & np.append(first[1:], True))
        repeated = twice | _inside(hashes, self.sure)
        self.sure = np.union1d(self.sure, hashes[twice & first])
        self.asking, self.pending = [], 0
        rest = owner[~repeated]
        used = np.unique(rest)
        out_owner, out_place = owner[repeated], place[repeated]
        order = np.argsort(out_owner, kind="stable")
        out_owner, out_place = out_owner[order], out_place[order]
        edges = np.flatnonzero(np.append(True, out_owner[1:] != out_owner[:-1])) if len(out_owner) else np.zeros(0, np.int64)
        for a, b in zip(edges, np.append(edges[1:], len(out_owner)), strict=True):
            yield *self.owners[out_owner[a]], out_place[a:b].tobytes()
        self.owners, self.waiting = [self.owners[k] for k in used], (hashes[~repeated], np.searchsorted(used, rest), place[~repeated])


def _answer_batches(hash_type, place_type, by_reference: bool):
    """Places of hashes that occur twice, and that are in the reference if there is one; rows come by bucket, then kind."""

    def out(rows: list[tuple]) -> pa.RecordBatch:
        run, pack, places = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(run, pa.int32()), pa.array(pack, pa.int32()), pa.array(places, pa.binary())], ["run", "pack", "places"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, rows = None, None, []
        for batch in batches:
            for bucket, kind, task, pack, hashes, places in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == FOUND:
                    rows.append((task, pack, places))
                    continue
                if bucket != at:
                    if state is not None:
                        rows += state.answer()
                    at, state = bucket, _Bucket(hash_type, place_type, by_reference)
                rows += state.take(kind, (task, pack), hashes, places)
            if rows:
                yield out(rows)
                rows = []
        if state is not None:
            rows += state.answer()
        if rows:
            yield out(rows)

    return run


def _answers(entries: DataFrame, parts: int, hash_type, place_type, by_reference: bool, name: str) -> DataFrame:
    """Places that repeat, a list per pack."""
    dealt = entries.repartition(parts, "bucket").sortWithinPartitions("bucket", "kind")
    answers = map_arrow(dealt, _answer_batches(hash_type, place_type, by_reference), ANSWER)
    # a pack's list is no longer than its text
    return stage(answers.groupBy("run", "pack").agg(F.collect_list("places").alias(name)), name)


def _with_packs(packs: DataFrame, lists: DataFrame, how: str) -> DataFrame:
    """Packs with their lists. Only ``run`` is a key of the join, as the packs lie bucketed by it; a run has few packs."""
    lists = lists.withColumnsRenamed({"run": "of_run", "pack": "of_pack"}).hint("shuffle_hash")
    return packs.join(lists, (F.col("run") == F.col("of_run")) & (F.col("pack") - F.col("of_pack") == 0), how).drop("of_run", "of_pack")


def _keep_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text without the words that a repeated window covers."""
    for _, _, texts, ids, marks in _packs(batches, "ids", "marks"):
        data, offsets = text_bytes(texts)
        split = [data[a:b].tobytes().split() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        n = np.array([len(x) for x in split], np.int64)
        edges = np.concatenate(([0], np.cumsum(n)))
        cover = np.zeros(edges[-1] + 1, np.int64)
        if marks.is_valid:
            starts = np.unique(np.concatenate([np.frombuffer(x, np.uint32) for x in marks.as_py()])).astype(np.int64)
            cover[starts] += 1
            np.add.at(cover, starts + WINDOW, -1)
        kept = np.cumsum(cover)[:-1] == 0
        left = np.concatenate(([0], np.cumsum(kept)))
        n_kept = left[edges[1:]] - left[edges[:-1]]
        texts = [b" ".join(x if k == len(x) else compress(x, kept[a:b].tolist())).decode() for x, k, a, b in zip(split, n_kept.tolist(), edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([ids.values, pa.array(texts, pa.string()), pa.array(n), pa.array(n - n_kept)], ["doc_id", "text", "n_words", "n_removed"])


def drop_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, text, n_words, n_removed of every row of ``docs`` (doc_id, text): its words, joined by one blank, without repeated passages.

    Words are runs of characters other than 0x20 and 0x09-0x0D, unchanged. A word goes if
    some window of WINDOW consecutive words around it occurs, word by word, at any other
    place of the table: in another row, a repeated row or a row without doc_id included,
    or elsewhere in the same text, overlapping itself or not. All occurrences go. Windows
    are those of the input; what a removal brings together is not judged again. Null and
    empty texts have no words and stay empty; texts of fewer than WINDOW words stay
    whole. Whole texts count, however long. Extra columns are ignored; an empty table
    gives an empty result. Windows are told apart by 64 bits of one hash and the bucket
    number of another: about 75 bits here, more on larger clusters.
    """
    spark, parts = docs.sparkSession, partitions(docs.sparkSession)
    buckets = parts * BUCKETS_EACH
    texts = id_and_text(docs)
    id_type = texts.schema["doc_id"].dataType.simpleString()
    packs = map_arrow(texts, _pack_batches, f"run int, pack int, ids array<{id_type}>, texts array<string>")
    name, path = f"packs_{uuid.uuid4().hex}", new_path(spark, "packs")
    with small_batches(spark):
        packs.write.option("compression", "zstd").option("path", path).bucketBy(parts, "run").saveAsTable(name)
    packs = spark.table(name)
    hits = _answers(map_arrow(packs.select("run", "pack", "texts"), _probe_batches(buckets), ENTRY), parts, np.uint32, np.uint16, True, "hits")
    near = _with_packs(packs.select("run", "pack", "texts"), hits, "inner")
    marks = _answers(map_arrow(near, _extend_batches(buckets), ENTRY), parts, np.uint64, np.uint32, False, "marks")
    return map_arrow(_with_packs(packs, marks, "left"), _keep_batches, f"doc_id {id_type}, text string, n_words long, n_removed long")
