"""Approximate nearest neighbours by cosine: inverted file with product-quantised residuals.

Coarse centroids and residual codebooks are fitted on a bounded sample; every vector is
then encoded. Lists grow in number with the table: beyond ``MAX_LISTS`` lists of
``LIST_ROWS`` rows each is split by a second, shared set of centroids of what is left, so
that what a query scans stays about the same up to some 10^9 vectors. A query scans the lists of its nearest centroids by asymmetric distances
(exact query residual against codewords), and the best candidates are ranked again by
the exact cosine of the original vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.llm.common import map_arrow, scratch, sent, stage

#: Vectors (by hash of vec_id; all if fewer) on which centroids and codebooks are fitted.
SAMPLE = 20_000
MAX_LISTS = 4096
#: Rows that a list holds on average before lists are split, and parts of a list at most.
LIST_ROWS = 4096
MAX_PARTS = 64
#: Share of near neighbours inside the sample that the scanned lists must hold, and candidates that are ranked exactly.
IN_LISTS = 0.97
RERANK = 256
SUBSPACES = 16
CODEWORDS = 256
#: Codes and queries that meet in one group of the scan at most, on average.
CHUNK = 32_768
QUERY_BLOCK = 256


@dataclass
class Index:
    centroids: np.ndarray  # [first level, dim]
    parts: np.ndarray  # [second level, dim]; list i * len(parts) + j lies around centroids[i] + parts[j]
    books: list[np.ndarray]  # per subspace [codewords, width]
    cuts: list[int]  # first dimension of each subspace, and dim

    def lists(self) -> int:
        return len(self.centroids) * len(self.parts)

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """List of each row, and what is left of it."""
        one = _nearest(x, self.centroids)
        rest = x - self.centroids[one]
        two = _nearest(rest, self.parts)
        return one * len(self.parts) + two, rest - self.parts[two]

    def centres(self, lists: np.ndarray) -> np.ndarray:
        return self.centroids[lists // len(self.parts)] + self.parts[lists % len(self.parts)]

    def remoteness(self, x: np.ndarray) -> np.ndarray:
        """[rows, lists] half the squared distance to each list's centre, but for a constant of the row."""
        both = self.centroids @ self.parts.T  # |c + p|^2 = |c|^2 + |p|^2 + 2 c.p
        half = ((self.centroids**2).sum(axis=1)[:, None] + (self.parts**2).sum(axis=1)[None]) / 2 + both
        out = half[None] - (x @ self.centroids.T)[:, :, None] - (x @ self.parts.T)[:, None, :]
        return out.reshape(len(x), -1)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    half = (centres * centres).sum(axis=1) / 2
    for a in range(0, len(x), 4096):
        out[a : a + 4096] = np.argmax(x[a : a + 4096] @ centres.T - half, axis=1)
    return out


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """k centres at most (fewer if there are fewer distinct rows)."""
    distinct = np.unique(x, axis=0)
    if len(distinct) <= k:
        return distinct
    centres = distinct[np.random.default_rng(seed).choice(len(distinct), k, replace=False)].copy()
    for _ in range(rounds):
        at = _nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        n = np.bincount(at, minlength=k)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def fit_index(sample: np.ndarray, rows: int) -> Index:
    """Index for ``rows`` unit vectors from a sample of them."""
    dim = sample.shape[1]
    centroids = kmeans(sample, int(min(MAX_LISTS, max(1, rows**0.5))))
    residual = sample - centroids[_nearest(sample, centroids)]
    split = int(min(MAX_PARTS, rows // (len(centroids) * LIST_ROWS)))
    parts = kmeans(residual, split, rounds=8) if split > 1 else np.zeros((1, dim), np.float32)
    residual = residual - parts[_nearest(residual, parts)]
    cuts = np.linspace(0, dim, min(SUBSPACES, dim) + 1).round().astype(int).tolist()
    books = [kmeans(np.ascontiguousarray(residual[:, a:b]), CODEWORDS, rounds=8) for a, b in zip(cuts, cuts[1:], strict=False)]
    return Index(centroids, parts, books, cuts)


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(n, -1) if n else flat.reshape(0, 0)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True) if len(x) else x
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32) if len(x) else x.astype(np.float32)


def _encode_batches(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = index.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = unit(_matrix(batch.column("vector")))
            at, residual = ix.assign(x)
            codes = np.stack([_nearest(residual[:, a:b], book) for a, b, book in zip(ix.cuts, ix.cuts[1:], ix.books, strict=False)], axis=1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(at.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary())], ["vec_id", "list", "code"])

    return run


def probes_for(index: Index, sample: np.ndarray, k: int, share: float = IN_LISTS, queries: int = 256) -> int:
    """Nearest lists that hold ``share`` of the k nearest neighbours, measured inside the sample.

    Neighbours among all rows are at least as near as those in a sample of them, so the
    number errs to the safe side.
    """
    q = sample[:: max(1, len(sample) // queries)][:queries]
    near = q @ sample.T
    near[near >= 1 - 1e-6] = -2  # the query itself and its copies are found in any case
    best = np.argsort(-near, axis=1, kind="stable")[:, :k]
    held, at = index.assign(sample)[0], []
    for a in range(0, len(q), 16):
        place = np.argsort(np.argsort(index.remoteness(q[a : a + 16]), axis=1, kind="stable"), axis=1)
        at.append(np.take_along_axis(place, held[best[a : a + 16]], axis=1))
    at = np.concatenate(at)
    return int(np.sort(at.ravel())[min(at.size - 1, int(share * at.size))]) + 1


def cells(index: Index, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First chunk and number of chunks of each list: lists that lie together share a chunk, large ones are split."""
    centred = index.centroids - index.centroids.mean(axis=0)
    axis = np.linalg.svd(centred, full_matrices=False)[2][0]
    place = ((centred @ axis)[:, None] + (index.parts @ axis)[None]).ravel()
    first, n = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64)
    chunk, held = 0, 0
    for i in np.argsort(place, kind="stable"):
        n[i] = max(1, -(-sizes[i] // CHUNK))
        if held and (n[i] > 1 or held + sizes[i] > CHUNK):
            chunk, held = chunk + 1, 0
        first[i] = chunk
        if n[i] > 1:
            chunk += n[i]
        else:
            held += sizes[i]
    return first, n


def _probe_batches(index, sizes: np.ndarray, first: np.ndarray, chunks: np.ndarray, probes: int, enough: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = index.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = unit(_matrix(batch.column("vector")))
            row, chunk, lists = [], [], []
            for a in range(0, len(x), 64):
                order = np.argsort(ix.remoteness(x[a : a + 64]), axis=1, kind="stable")
                n = np.maximum(probes, 1 + (np.cumsum(sizes[order], axis=1) < enough).sum(axis=1))
                for r in range(len(order)):
                    asked = order[r, : n[r]]
                    asked = asked[sizes[asked] > 0]
                    split = np.repeat(asked, chunks[asked])
                    into = np.concatenate([first[i] + np.arange(chunks[i]) for i in asked]) if len(asked) else asked
                    for c in np.unique(into):
                        row.append(a + r)
                        chunk.append(int(c))
                        lists.append(split[into == c].astype(np.int32))
            take = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(take), batch.column("vector").take(take), pa.array(chunk, pa.int64()), pa.array(lists, pa.list_(pa.int32()))], ["query_id", "vector", "chunk", "lists"])

    return run


def _scan(index, keep: int):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("distance", pa.float32())])

    def run(queries: pa.Table, codes: pa.Table) -> pa.Table:
        if not queries.num_rows or not codes.num_rows:
            return schema.empty_table()
        ix = index.value
        q = unit(_matrix(queries["vector"]))
        qid, vid, at = queries["query_id"].to_numpy(), codes["vec_id"].to_numpy(), codes["list"].to_numpy()
        code = np.frombuffer(b"".join(codes["code"].to_pylist()), np.uint8).reshape(len(vid), -1)
        by_id = np.argsort(vid, kind="stable")
        vid, code, at = vid[by_id], np.ascontiguousarray(code[by_id].T), at[by_id]
        # |q - c - w|^2 = |q - c|^2 + (|w|^2 + 2 c.w) - 2 q.w for list centre c and codewords w
        own = np.zeros(len(vid), np.float32)
        for s, book in enumerate(ix.books):
            span = slice(ix.cuts[s], ix.cuts[s + 1])
            own += ((book * book).sum(axis=1)[None] + 2 * ix.centroids[:, span] @ book.T)[at // len(ix.parts), code[s]]
            own += (2 * ix.parts[:, span] @ book.T)[at % len(ix.parts), code[s]]
        asked = queries["lists"].to_pylist()
        parts = []
        for a in range(0, len(q), 32):
            block = q[a : a + 32]
            distance = np.zeros((len(block), len(vid)), np.float32)
            for s, book in enumerate(ix.books):
                distance -= (2 * block[:, ix.cuts[s] : ix.cuts[s + 1]] @ book.T)[:, code[s]]
            centre = np.full((len(block), ix.lists()), np.inf, np.float32)
            for r in range(len(block)):
                centre[r, asked[a + r]] = ((block[r] - ix.centres(np.array(asked[a + r]))) ** 2).sum(axis=1)
            distance += own + centre[:, at]
            distance[vid[None, :] == qid[a : a + 32, None]] = np.inf
            for r in range(len(block)):
                d = distance[r]
                if len(d) > keep:
                    limit = np.partition(d, keep - 1)[keep - 1]
                    best = np.flatnonzero(d <= limit)
                    best = best[np.argsort(d[best], kind="stable")][:keep]  # ties: codes are in order of vec_id
                else:
                    best = np.argsort(d, kind="stable")
                best = best[np.isfinite(d[best])]
                parts.append((np.full(len(best), qid[a + r]), vid[best], d[best]))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)], schema=schema)

    return run


def valid_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, vector) of rows whose vector has the commonest length, finite components and one that isn't 0; extreme ones scaled."""
    v = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("vector")).filter("vec_id is not null and vector is not null and size(vector) > 0")
    v = v.filter(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0))
    common = v.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    v = v.filter(F.size("vector") == (common["dim"] if common else 0))
    # squares of very large or small components would leave the range of doubles; powers of two change no cosine and no digit
    largest = F.array_max(F.transform("vector", lambda x: F.abs(x)))
    scale = F.pow(F.lit(2.0), F.least(F.greatest(-F.floor(F.log2(largest)), F.lit(-1000)), F.lit(1000)))
    return v.withColumn("vector", F.when(largest.between(1e-100, 1e100), F.col("vector")).otherwise(F.transform("vector", lambda x: x * scale)))


def cosine(a: str, b: str):
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def nearest(vectors: DataFrame, k: int = 5, every: int = 50, rerank: int = RERANK) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row whose vec_id is divisible by ``every``.

    Candidates are all other rows; ties go to the smaller vec_id. Vectors that are null,
    zero, of another than the commonest length, or hold null or non-finite components
    take no part, nor do rows without vec_id. vec_id is the key: of rows that repeat one,
    the least vector counts (by its first component, then the next), whatever their order. With k candidates or fewer all are returned. Extra columns are ignored.
    An empty table gives an empty result.
    """
    with scratch(vectors.sparkSession, "nearest") as keep:
        return _nearest_rows(vectors, k, every, rerank, keep)


def _nearest_rows(vectors: DataFrame, k: int, every: int, rerank: int, keep) -> DataFrame:
    spark = vectors.sparkSession
    valid = stage(valid_vectors(vectors).groupBy("vec_id").agg(F.min("vector").alias("vector")), "vectors")
    schema = "query_id long, rank int, vec_id long, score double"
    rows = valid.count()
    if rows < 2:
        return spark.createDataFrame([], schema)
    sample = valid.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vector").toArrow()
    sample = unit(_matrix(sample["vector"]))
    with sent(spark, fit_index(sample, rows)) as index:
        return keep(_search(valid, index, sample, k, every, rerank))


def _search(valid: DataFrame, index, sample: np.ndarray, k: int, every: int, rerank: int) -> DataFrame:
    """The result of ``nearest`` over a stored table, lazily; ``index`` is a broadcast."""
    spark = valid.sparkSession
    codes = stage(map_arrow(valid, _encode_batches(index), "vec_id long, list int, code binary"), "codes")
    lists = index.value.lists()
    sizes = np.zeros(lists, np.int64)
    for r in codes.groupBy("list").count().collect():  # MAX_LISTS * MAX_PARTS rows at most
        sizes[r["list"]] = r["count"]
    queries = valid.filter(F.col("vec_id") % every == 0)
    first, chunks = cells(index.value, sizes)
    probes = probes_for(index.value, sample, k)
    run = _probe_batches(index, sizes, first, chunks, probes, 4 * rerank)
    probed = stage(map_arrow(queries, run, "query_id long, vector array<double>, chunk long, lists array<int>"), "probes")
    blocks = probed.groupBy("chunk").agg(F.ceil(F.count("*") / QUERY_BLOCK).alias("blocks"))
    cut = F.broadcast(spark.createDataFrame([(i, int(first[i]), int(chunks[i])) for i in range(lists)], "list int, first long, chunks long"))  # MAX_LISTS * MAX_PARTS rows at most
    left = probed.join(blocks, "chunk").withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")))
    right = codes.join(cut, "list").withColumn("chunk", F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("chunks"))).join(blocks, "chunk")
    right = right.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    keys = ["chunk", "block"]
    found = left.select(*keys, "query_id", "vector", "lists").groupBy(*keys).cogroup(right.select(*keys, "vec_id", "list", "code").groupBy(*keys)).applyInArrow(_scan(index, rerank), "query_id long, vec_id long, distance float")
    best = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    short = found.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= rerank).select("query_id", "vec_id")
    exact = short.join(valid, "vec_id").join(queries.select(F.col("vec_id").alias("query_id"), F.col("vector").alias("query")), "query_id")
    exact = exact.select("query_id", "vec_id", cosine("query", "vector").alias("score"))
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return exact.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
