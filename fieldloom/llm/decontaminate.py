"""Benchmark decontamination by CGK embedding, bit-sampling LSH and exact edit distance, on words.

The CGK random walk reads a window word by word and writes one word per step, moving on
or staying by a random bit of the word and the step; equal walks under small edit
distance keep a small Hamming distance. Each repetition samples ``SAMPLED`` positions of
such an embedding; items and windows of one length that agree on them are verified by
exact word edit distance. The number of repetitions is set for each class of lengths, on
edited copies of its longest items with as many edits as are allowed, so that ``RECALL``
of these are retrieved, and confirmed on other copies.

An item of more than ``BLOCK`` words is cut into blocks of nearly equal length. Edits of
0.2 of the item's words leave at least one block with edits of 0.2 of its own words or
less, so that one block at least is retrieved as an item of its length is; each
retrieved block says where the item may start, give or take its most edits, and there the
whole item is verified by exact alignment.

A window within d = ``EDITS`` * n edits of an item or block of n words shares at least
n - g + 1 - g * d of its g-word runs (q-gram lemma), g = 3 for all but the shortest.
Windows with fewer runs of blocks of that length are not embedded; this drops no match.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import id_and_text, map_arrow, sent, stage
from fieldloom.llm.textvec import NON_ALNUM, Words, mix, text_slices

EDITS = 0.2
RECALL = 0.998
SAMPLED = 2
LEAST_REPEATS = 16
#: Edited copies on which repetitions are set, and as many on which they are confirmed.
COPIES = 500
#: Lengths whose ratio is no more than this share repetitions.
CLASS = 1.15
#: Most words of a block; at most 64, one bit each in ``ItemIndex.grams``.
BLOCK = 64
#: Items, and bytes of their texts, that one pass over the documents holds in each worker.
ITEM_BLOCK = 20_000
ITEM_BYTES = 16 << 20
_END = np.uint64(0)


def most_edits(n: int) -> int:
    return int(EDITS * n + 1e-9)


def gram_of(n: int) -> int:
    """Longest run (up to 3 words) of which an item of n words keeps at least one under its most edits."""
    d = most_edits(n)
    return max(g for g in (1, 2, 3) if g == 1 or n - g + 1 - g * d >= 1)


def _coins(repeats: int, steps: int, seed: int = 11) -> np.ndarray:
    return (np.random.default_rng(seed).integers(0, 1 << 63, (repeats, steps), dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


def sampled_words(windows: np.ndarray, repeats: int) -> np.ndarray:
    """[windows, repeats] hash of the sampled words of each window's CGK embeddings."""
    w, n = windows.shape
    steps = 2 * n
    coins = _coins(repeats, steps)
    picks = np.sort(np.random.default_rng(n).integers(0, steps, (repeats, SAMPLED)), axis=1)
    padded = np.concatenate([windows, np.full((w, 1), _END)], axis=1)
    at = np.zeros((w, repeats), np.int64)
    rows = np.arange(w)[:, None]
    out = np.full((w, repeats), np.uint64(n), np.uint64)
    for step in range(int(picks.max()) + 1):
        word = padded[rows, at]
        for s in range(SAMPLED):
            now = picks[:, s] == step
            if now.any():
                out[:, now] = mix(out[:, now] * np.uint64(0x9E3779B97F4A7C15) + word[:, now])
        at = np.minimum(at + ((word * coins[:, step]) >> np.uint64(63)).astype(np.int64), n)
    return mix(out + np.arange(repeats, dtype=np.uint64)[None] * np.uint64(0xD6E8FEB86659FD93))


def prefix_distances(items: np.ndarray, windows: np.ndarray, limit: int) -> np.ndarray:
    """Least word edit distance of each item to a prefix of the window beside it; over ``limit``: limit + 1.

    items: [pairs, n]; windows: [pairs, m], m <= n + limit, padded with 0.
    """
    pairs, n = items.shape
    m = windows.shape[1]
    row = np.tile(np.minimum(np.arange(m + 1), limit + 1).astype(np.int32), (pairs, 1))
    for i in range(1, n + 1):
        change = row[:, :-1] + (windows != items[:, i - 1 : i])
        best = np.minimum(change, row[:, 1:] + 1)
        new = np.empty_like(row)
        new[:, 0] = i
        new[:, 1:] = best
        # insertions: new[j] = min over k <= j of new[k] + (j - k)
        steps = np.arange(m + 1, dtype=np.int32)
        row = np.minimum.accumulate(new - steps, axis=1) + steps
    return np.minimum(row.min(axis=1), limit + 1)


def start_distances(items: np.ndarray, text: np.ndarray, limit: int) -> np.ndarray:
    """[items, starts] least word edit distance of each item to any run of the text's words from each start on; over ``limit``: limit + 1."""
    back, pattern = text[::-1], items[:, ::-1]
    m = len(text)
    steps = np.arange(m + 1, dtype=np.int32)
    row = np.zeros((len(items), m + 1), np.int32)  # read backwards, a run may begin anywhere
    for i in range(items.shape[1]):
        change = row[:, :-1] + (back[None] != pattern[:, i : i + 1])
        new = np.empty_like(row)
        new[:, 0] = i + 1
        new[:, 1:] = np.minimum(change, row[:, 1:] + 1)
        row = np.minimum.accumulate(new - steps, axis=1) + steps
    return np.minimum(row[:, :0:-1], limit + 1)


def block_cuts(n: int) -> list[int]:
    """Where the blocks of an item of n words begin, and n: as few of ``BLOCK`` words or less as will do, alike in length."""
    k = -(-n // BLOCK)
    return [j * n // k for j in range(k + 1)]


class ItemIndex:
    """Items, their blocks by length with sampled embeddings, and the runs of words of these.

    blocks: words by length; owner, offset: the item of each block, and where in it the block begins.
    """

    def __init__(self, ids: list[int], texts: list[str]):
        batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
        self.ids: list[int] = []
        self.items: list[np.ndarray] = []
        at = 0
        for _, _, data, offsets in text_slices(batch):
            words = Words(data, offsets, NON_ALNUM)
            for r in range(words.rows):
                h = words.hash[words.at[r] : words.at[r + 1]] | np.uint64(1)  # 0 is what lies past the end
                if len(h):
                    self.ids.append(ids[at + r])
                    self.items.append(h)
            at += words.rows
        by_length: dict[int, list[tuple[int, int]]] = {}
        for i, h in enumerate(self.items):
            cuts = block_cuts(len(h))
            for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
                by_length.setdefault(end - begin, []).append((i, begin))
        self.lengths = sorted(by_length)
        self.owner = {b: np.array([i for i, _ in by_length[b]], np.int64) for b in self.lengths}
        self.offset = {b: np.array([o for _, o in by_length[b]], np.int64) for b in self.lengths}
        self.whole = {b: np.array([len(self.items[i]) == b for i, _ in by_length[b]]) for b in self.lengths}
        self.blocks = {b: np.array([self.items[i][o : o + b] for i, o in by_length[b]], np.uint64) for b in self.lengths}
        self.repeats = self._repeats()
        self.keys = {}
        for b in self.lengths:
            keys = sampled_words(self.blocks[b], self.repeats[b]).ravel()
            order = np.argsort(keys, kind="stable")
            self.keys[b] = (keys[order], order // self.repeats[b])
        self.grams = {}
        for g in {gram_of(b) for b in self.lengths}:
            of_length = [(k, np.unique(run_hashes(self.blocks[b], g))) for k, b in enumerate(self.lengths) if gram_of(b) == g]
            known = np.unique(np.concatenate([runs for _, runs in of_length]))
            member = np.zeros(len(known), np.uint64)  # bit k: some block of lengths[k] words has the run
            for k, runs in of_length:
                member[np.searchsorted(known, runs)] |= np.uint64(1) << np.uint64(k)
            self.grams[g] = (known, member, np.bincount((known & np.uint64(0xFFFFF)).astype(np.int64), minlength=1 << 20) > 0)

    def _repeats(self) -> dict[int, int]:
        """Repetitions for each length; lengths within ``CLASS`` of each other share those of their longest."""
        out: dict[int, int] = {}
        rng = np.random.default_rng(3)
        longest = None
        for n in reversed(self.lengths):
            if longest is None or longest > CLASS * n or not most_edits(n):
                longest = n
                out[n] = repeats_for(self.blocks[n], rng)
            else:
                out[n] = out[longest]
        return out


def edited_copies(items: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Each item with as many random edits as are allowed, cut or followed by other words to its length."""
    n = items.shape[1]
    out = np.empty_like(items)
    for row, h in zip(out, items, strict=True):
        e = list(h)
        for _ in range(most_edits(n)):
            kind, p = rng.integers(3), int(rng.integers(len(e)))
            new = np.uint64(rng.integers(1, 1 << 63))
            if kind == 0:
                e[p] = new
            elif kind == 1:
                e.insert(p, new)
            elif len(e) > 1:
                e.pop(p)
        e += [np.uint64(rng.integers(1, 1 << 63)) for _ in range(n - len(e))]
        row[:] = e[:n]
    return out


def repeats_for(items: np.ndarray, rng: np.random.Generator) -> int:
    """Repetitions that retrieve ``RECALL`` of edited copies, and of as many others."""
    if not most_edits(items.shape[1]):
        return LEAST_REPEATS
    take = np.resize(rng.permutation(len(items)), COPIES)
    pairs = [(items[take], edited_copies(items[take], rng)) for _ in range(2)]
    tried, needed = 64, None
    while needed is None or needed > tried:
        tried *= 2
        first = []
        for a, b in pairs:
            same = sampled_words(a, tried) == sampled_words(b, tried)
            first.append(np.sort(np.where(same.any(axis=1), same.argmax(axis=1), tried)))
        needed = int(max(f[int(np.ceil(RECALL * COPIES)) - 1] for f in first)) + 1
    return max(LEAST_REPEATS, needed)


def run_hashes(rows: np.ndarray, g: int) -> np.ndarray:
    total = np.full((rows.shape[0], rows.shape[1] - g + 1), np.uint64(g))
    for j in range(g):
        total = mix(total * np.uint64(0x9E3779B97F4A7C15) + rows[:, j : rows.shape[1] - g + 1 + j])
    return total


def _windows(words: Words, index: ItemIndex) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length n, rows, first words) of the windows that hold enough runs of blocks of n words."""
    hashes = words.hash | np.uint64(1)
    for g, (known, member, low) in index.grams.items():
        if len(hashes) < g:
            continue
        runs = run_hashes(hashes[None], g)[0]
        runs_ok = words.row[g - 1 :] == words.row[: len(runs)]
        spots = np.flatnonzero(low[(runs & np.uint64(0xFFFFF)).astype(np.int64)] & runs_ok)
        found = np.minimum(np.searchsorted(known, runs[spots]), len(known) - 1)
        right = known[found] == runs[spots]
        spots, found = spots[right], found[right]
        if not len(spots):
            continue
        spot_row = words.row[spots]
        for k, n in enumerate(index.lengths):
            if gram_of(n) != g:
                continue
            hit = (member[found] >> np.uint64(k)) & np.uint64(1) > 0
            place, row = spots[hit], spot_row[hit]
            d = most_edits(n)
            need = n - g + 1 - g * d
            if len(place) < need:
                continue
            # a window holds its first to last shared run within n + d words; start at most n + d before a run
            reach = n + d - g
            count = np.searchsorted(place, place + reach, "right") - np.arange(len(place))
            same = row[np.minimum(np.arange(len(place)) + need - 1, len(place) - 1)] == row
            good = (count >= need) & same
            if not good.any():
                continue
            # the first shared run of a window lies at most n + d - g - (need - 1) words after its start
            lead = max(0, n + d - g - need + 1)
            begin = np.maximum(place[good] - lead, words.at[row[good]])
            span = place[good] - begin + 1
            first = np.unique(np.repeat(begin - np.concatenate(([0], np.cumsum(span)[:-1])), span) + np.arange(span.sum()))
            yield n, words.row[first], first


def _match_batches(index):
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("distance", pa.int32()), ("item_words", pa.int32()), ("first_word", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = index.value
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            held: dict[int, list] = {}
            texts: dict[int, np.ndarray] = {}  # words of the rows that may hold blocks of longer items
            out: dict[tuple[int, int], tuple[int, int, int]] = {}
            for a, _, data, offsets in text_slices(batch):
                words = Words(data, offsets, NON_ALNUM)
                for n, rows, first in _windows(words, ix):
                    width = n + most_edits(n)
                    take = first[:, None] + np.arange(width)
                    end = words.at[rows + 1][:, None]
                    text = np.where(take < end, (words.hash | np.uint64(1))[np.minimum(take, len(words.hash) - 1)], _END)
                    held.setdefault(n, []).append((a + rows, first - words.at[rows], text))
                    if not ix.whole[n].all():
                        for r in np.unique(rows).tolist():
                            texts.setdefault(a + r, words.hash[words.at[r] : words.at[r + 1]] | np.uint64(1))
            starts = []
            for n, parts in held.items():
                rows, first, text = (np.concatenate(x) for x in zip(*parts, strict=True))
                for b in range(0, len(rows), 4096):
                    starts.append(match_windows(ix, n, rows[b : b + 4096], first[b : b + 4096], text[b : b + 4096], ids, out))
            if starts:
                align_items(ix, np.concatenate(starts), texts, ids, out)
            if out:
                columns = list(zip(*[(d, i, *v) for (d, i), v in sorted(out.items())], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def _note(out: dict, key: tuple[int, int], value: tuple[int, int, int]) -> None:
    if key not in out or value < out[key]:
        out[key] = value


def match_windows(ix: ItemIndex, n: int, rows: np.ndarray, first: np.ndarray, text: np.ndarray, ids: np.ndarray, out: dict) -> np.ndarray:
    """Windows of one length against the blocks of that length.

    The best match of each document and item of one block goes to ``out``; returned is
    [matches of blocks of longer items, (row, item, where the item would start)].
    """
    keys, owner = ix.keys[n]
    repeats = ix.repeats[n]
    probes = sampled_words(np.ascontiguousarray(text[:, :n]), repeats)
    low, high = np.searchsorted(keys, probes.ravel(), "left"), np.searchsorted(keys, probes.ravel(), "right")
    hits = np.flatnonzero(high > low)
    many = high[hits] - low[hits]
    window = np.repeat(hits // repeats, many)
    block = owner[np.repeat(low[hits] - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())]
    pairs = np.unique(window * len(ix.owner[n]) + block)
    window, block = pairs // len(ix.owner[n]), pairs % len(ix.owner[n])
    limit = most_edits(n)
    starts = [np.empty((0, 3), np.int64)]
    for b in range(0, len(window), 8192):
        w, k = window[b : b + 8192], block[b : b + 8192]
        distance = prefix_distances(ix.blocks[n][k], text[w], limit)
        near = distance <= limit
        w, k, distance = w[near], k[near], distance[near]
        item, whole = ix.owner[n][k], ix.whole[n][k]
        for j in np.flatnonzero(whole):
            _note(out, (int(ids[rows[w[j]]]), ix.ids[item[j]]), (int(distance[j]), n, int(first[w[j]])))
        w, k, item = w[~whole], k[~whole], item[~whole]
        starts.append(np.stack([rows[w], item, first[w] - ix.offset[n][k]], axis=1))
    return np.concatenate(starts)


def align_items(ix: ItemIndex, starts: np.ndarray, texts: dict[int, np.ndarray], ids: np.ndarray, out: dict) -> None:
    """Exact alignment of items where blocks of theirs were retrieved; neighbouring starts of a row and item go as one stretch."""
    starts = np.unique(starts, axis=0)
    if not len(starts):
        return
    sizes = np.array([len(ix.items[i]) for i in starts[:, 1].tolist()])
    gap = 2 * np.array([most_edits(n) for n in sizes.tolist()]) + 1
    step = np.diff(starts, axis=0)
    cuts = np.flatnonzero((step[:, 0] != 0) | (step[:, 1] != 0) | (step[:, 2] > gap[1:])) + 1
    for part in np.split(starts, cuts):
        row, i = int(part[0, 0]), int(part[0, 1])
        item = ix.items[i]
        n, limit, g = len(item), most_edits(len(item)), gram_of(len(item))
        begin, last = max(0, int(part[0, 2]) - limit), int(part[-1, 2]) + limit
        text = texts[row][begin : last + n + limit]
        if len(text) < g or np.isin(run_hashes(item[None], g)[0], run_hashes(text[None], g)[0]).sum() < n - g + 1 - g * limit:
            continue
        found = start_distances(item[None], text, limit)[0, : last - begin + 1]
        at = int(found.argmin())
        if found[at] <= limit:
            _note(out, (int(ids[row]), ix.ids[i]), (int(found[at]), n, begin + at))


def block_count(items: DataFrame) -> int:
    """Blocks that hold about ``ITEM_BLOCK`` items or ``ITEM_BYTES`` of their texts, whichever is less."""
    size = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    return max(1, -(-size["n"] // ITEM_BLOCK), -(-size["bytes"] // ITEM_BYTES))


def matches(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, distance, item_words, first_word: the best window of each document for each item it holds.

    A document (doc_id, text) holds an item (item_id, text) if a run of its words is
    within 0.2 n word edits of the item's n words; words are runs of ASCII letters,
    digits and non-ASCII characters, A-Z lower-cased. Among windows the least distance
    counts, then the first. Null and empty texts and items without words match nothing;
    repeated items give a row each per item_id; repeated documents repeat no row; rows
    without doc_id or item_id match nothing. Whole texts and items are read, however long.
    Extra columns are ignored; empty tables give an empty result. Items go to the workers in
    blocks of about ``ITEM_BLOCK`` items or ``ITEM_BYTES`` of text, one pass over the documents each; an item
    id must be an integer.
    """
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, distance int, item_words int, first_word long"
    known = items.filter("item_id is not null").select("item_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).filter("text <> ''")
    blocks = block_count(known)
    found = None
    for block in range(blocks):
        part = known.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).toArrow()  # about ITEM_BLOCK rows
        index = ItemIndex(part["item_id"].to_pylist(), part["text"].to_pylist())
        if index.lengths:
            with sent(spark, index) as held:
                one = stage(map_arrow(id_and_text(docs).filter("doc_id is not null"), _match_batches(held), schema), "matches")
            found = one if found is None else found.union(one)
    if found is None:
        return spark.createDataFrame([], schema)
    best = F.min(F.struct("distance", "item_words", "first_word")).alias("m")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "m.distance", "m.item_words", "m.first_word")
