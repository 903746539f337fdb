"""Vector distances, exact neighbours, product quantisation and LSH."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Values of all queries that may be held at once; more are searched in blocks.
QUERY_VALUES = 4_000_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda t, x: t + x)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2)), F.lit(0.0), lambda t, x: t + x))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; 1 where a vector has no length."""
    return 1 - F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def weighted_distance(a: Column, b: Column, first: float = 0.3, second: float = 0.7) -> Column:
    """Euclidean distance with one weight for the first half of the dimensions and one for the second."""
    weights = F.transform(a, lambda _, i: F.when(i < F.size(a) / 2, first).otherwise(second))
    squares = F.zip_with(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2)), weights, lambda d, w: d * w)
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda t, x: t + x))


def _blocks(queries: DataFrame, id_col: str, vector: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    ids, rows, held = [], [], 0
    for r in queries.select(F.col(id_col).cast("long"), F.col(vector).cast("array<float>")).toLocalIterator():
        ids.append(r[0])
        rows.append(r[1])
        held += len(r[1])
        if held >= QUERY_VALUES:
            yield np.array(ids), np.array(rows, np.float64)
            ids, rows, held = [], [], 0
    if ids:
        yield np.array(ids), np.array(rows, np.float64)


def knn(queries: DataFrame, corpus: DataFrame, k: int, id_col: str = "vec_id", vector: str = "embedding", metric: str = "euclidean", include_self: bool = False) -> DataFrame:
    """query_id, neighbour_id, distance, rank: the k nearest of each query, exactly.

    A stated query set goes against all rows in blocks of bounded size: each partition of
    the corpus keeps its own k best of every query, by matrix products, and a window picks
    the k best of those; ties go to the smaller id.
    """
    from pyspark.sql import Window

    spark, parts = corpus.sparkSession, []
    for ids, rows in _blocks(queries, id_col, vector):
        held = spark.sparkContext.broadcast((ids, rows))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            qid, q = held.value
            best_d = np.full((len(qid), 0), np.inf)
            best_i = np.zeros((len(qid), 0), np.int64)
            unit = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
            for batch in batches:
                if not batch.num_rows:
                    continue
                ids = batch.column(0).to_numpy()
                x = np.array(batch.column(1).to_pylist(), np.float64)
                if metric == "cosine":
                    d = 1 - unit @ (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)).T
                else:
                    d = np.stack([np.sqrt(((x - v) ** 2).sum(axis=1)) for v in q])
                if not include_self:
                    d[qid[:, None] == ids[None, :]] = np.inf
                best_d, best_i = np.hstack([best_d, d]), np.hstack([best_i, np.broadcast_to(ids, d.shape)])
                order = np.lexsort((best_i, best_d), axis=1)[:, :k]
                best_d, best_i = np.take_along_axis(best_d, order, 1), np.take_along_axis(best_i, order, 1)
            ok = np.isfinite(best_d)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qid, best_d.shape[1])[ok.ravel()]), pa.array(best_i[ok]), pa.array(best_d[ok])], names=["query_id", "neighbour_id", "distance"])

        rows_in = corpus.select(F.col(id_col).cast("long"), F.col(vector).cast("array<float>"))
        parts.append(rows_in.mapInArrow(run, "query_id bigint, neighbour_id bigint, distance double"))
    if not parts:
        return spark.createDataFrame([], "query_id bigint, neighbour_id bigint, distance double, rank int")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    w = Window.partitionBy("query_id").orderBy("distance", "neighbour_id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def in_range(queries: DataFrame, corpus: DataFrame, radius: float, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, neighbour_id, distance of all rows within the radius of each query, exactly."""
    spark, parts = corpus.sparkSession, []
    for ids, rows in _blocks(queries, id_col, vector):
        held = spark.sparkContext.broadcast((ids, rows))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            qid, q = held.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                ids, x = batch.column(0).to_numpy(), np.array(batch.column(1).to_pylist(), np.float64)
                for i, v in zip(qid, q, strict=True):
                    d = np.sqrt(((x - v) ** 2).sum(axis=1))
                    ok = (d <= radius) & (ids != i)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(ok.sum(), i)), pa.array(ids[ok]), pa.array(d[ok])], names=["query_id", "neighbour_id", "distance"])

        parts.append(corpus.select(F.col(id_col).cast("long"), F.col(vector).cast("array<float>")).mapInArrow(run, "query_id bigint, neighbour_id bigint, distance double"))
    out = parts[0] if parts else spark.createDataFrame([], "query_id bigint, neighbour_id bigint, distance double")
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def similar(found: DataFrame, threshold: float) -> DataFrame:
    """Neighbours whose similarity 1 / (1 + distance) reaches the threshold."""
    return found.withColumn("similarity", 1 / (1 + F.col("distance"))).where(F.col("similarity") >= threshold)


# --- product quantisation ---------------------------------------------------


def pq_train(df: DataFrame, vector: str = "embedding", subspaces: int = 8, centroids: int = 256, iterations: int = 20, sample: int = 20_000, seed: int = 7) -> np.ndarray:
    """Codebooks [subspace, centroid, dimension] from k-means on at most ``sample`` vectors.

    The sample only fits the codebooks; every vector is encoded.
    """
    rows = df.select(F.col(vector).cast("array<float>").alias("v")).orderBy(F.xxhash64("v")).limit(sample).collect()
    x = np.array([r.v for r in rows], np.float64)
    rng = np.random.default_rng(seed)
    books = []
    for part in np.split(x, subspaces, axis=1):
        k = min(centroids, len(part))
        centres = [part[rng.integers(len(part))]]
        d = ((part - centres[0]) ** 2).sum(axis=1)
        for _ in range(1, k):
            centres.append(part[rng.choice(len(part), p=d / d.sum())] if d.sum() > 0 else part[0])
            d = np.minimum(d, ((part - centres[-1]) ** 2).sum(axis=1))
        c = np.array(centres)
        for _ in range(iterations):
            near = _nearest(part, c)
            moved = np.array([part[near == j].mean(axis=0) if (near == j).any() else c[j] for j in range(k)])
            if np.abs(moved - c).max() < 1e-4:
                break
            c = moved
        books.append(c)
    return np.array(books)


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c * c).sum(axis=1)[None, :] - 2 * x @ c.T).argmin(axis=1)


def pq_encode(df: DataFrame, books: np.ndarray, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, codes: the nearest centroid of each subspace."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.array(batch.column(1).to_pylist(), np.float64)
                codes = np.stack([_nearest(part, c) for part, c in zip(np.split(x, len(books), axis=1), books, strict=True)], axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes.astype(np.int32).tolist(), pa.list_(pa.int32()))], names=["vec_id", "codes"])

    return df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector).cast("array<float>")).mapInArrow(run, "vec_id bigint, codes array<int>")


def _book_column(books: np.ndarray) -> Column:
    return F.array(*(F.array(*(F.array(*map(F.lit, map(float, c))) for c in book)) for book in books))


def pq_decode(codes: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, embedding: the centroids of the codes, one after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [np.concatenate([books[s][c] for s, c in enumerate(row)]).tolist() for row in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.list_(pa.float64()))], names=["vec_id", "embedding"])

    return codes.select("vec_id", "codes").mapInArrow(run, "vec_id bigint, embedding array<double>")


def pq_search(codes: DataFrame, books: np.ndarray, query: list[float], k: int) -> DataFrame:
    """vec_id, distance: the k smallest table distances to the query."""
    tables = [((book - part) ** 2).sum(axis=1) for book, part in zip(books, np.split(np.array(query), len(books)), strict=True)]
    literal = F.array(*(F.array(*(F.lit(float(d)) for d in t)) for t in tables))
    parts = F.transform("codes", lambda c, s: F.get(F.get(literal, s), c))
    return codes.select("vec_id", F.sqrt(F.aggregate(parts, F.lit(0.0), lambda t, x: t + x)).alias("distance")).orderBy("distance", "vec_id").limit(k)


def pq_distance(a: Column, b: Column, books: np.ndarray) -> Column:
    """Distance of two code arrays by their centroids."""
    between = F.array(*(F.array(*(F.array(*(F.lit(float(x)) for x in row)) for row in ((book[:, None] - book[None]) ** 2).sum(axis=2))) for book in books))
    parts = F.transform(F.arrays_zip(a.alias("a"), b.alias("b")), lambda p, s: F.get(F.get(F.get(between, s), p["a"]), p["b"]))
    return F.sqrt(F.aggregate(parts, F.lit(0.0), lambda t, x: t + x))


def pq_ratio(dimensions: int, subspaces: int) -> float:
    """Bytes of floats per byte of codes."""
    return dimensions * 4 / subspaces


# --- locality-sensitive hashing ---------------------------------------------


#: Pairs of queries and rows that are marked as candidates at once.
MARKED_PAIRS = 8_000_000


def _probes(margins: np.ndarray, probes: int) -> np.ndarray:
    """[query, probe] signatures of one table, likeliest first, from [query, bit] distances to its planes.

    Flipping a bit costs its squared distance; signatures of up to three flipped bits go by rising cost.
    """
    bits = margins.shape[1]
    flips = [c for n in range(min(bits, 3) + 1) for c in combinations(range(bits), n)]
    masks = np.array([sum(1 << b for b in c) for c in flips], np.int64)
    flipped = np.array([[b in c for b in range(bits)] for c in flips], np.float64)
    own = (margins > 0) @ (1 << np.arange(bits))
    best = np.argsort(margins**2 @ flipped.T, axis=1, kind="stable")[:, :probes]
    return own[:, None] ^ masks[best]


def lsh_knn(queries: DataFrame, corpus: DataFrame, k: int, id_col: str = "vec_id", vector: str = "embedding", tables: int = 24, bits: int = 8, seed: int = 3, probes: int = 12) -> DataFrame:
    """query_id, neighbour_id, distance, rank among rows whose signature of random hyperplanes is probed.

    In every table a query probes its own signature and those it misses by least.  Queries
    go in blocks of bounded size against all rows; candidates are compared exactly, each
    partition keeps its own k best of every query, and a window picks the k best of those.
    """
    from pyspark.sql import Window

    spark, parts = corpus.sparkSession, []
    for ids, rows in _blocks(queries, id_col, vector):
        planes = np.random.default_rng(seed).normal(size=(tables, bits, rows.shape[1])).round(4)
        probed = np.stack([_probes(rows @ p.T, probes) for p in planes]).astype(np.int32)
        held = spark.sparkContext.broadcast((ids, rows, planes, probed))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            qid, q, planes, probed = held.value
            best = [(np.zeros(0), np.zeros(0, np.int64))] * len(qid)
            for batch in batches:
                if not batch.num_rows:
                    continue
                ids, x = batch.column(0).to_numpy(), np.array(batch.column(1).to_pylist(), np.float64)
                signed = [(x @ p.T > 0) @ (1 << np.arange(bits)) for p in planes]
                step = max(1, MARKED_PAIRS // max(len(x), 1 << bits))
                for begin in range(0, len(qid), step):
                    some = range(begin, min(begin + step, len(qid)))
                    marked = np.zeros((len(some), len(x)), bool)
                    for p, s in zip(probed, signed, strict=True):
                        wanted = np.zeros((len(some), 1 << bits), bool)
                        np.put_along_axis(wanted, p[begin : begin + step], True, axis=1)
                        marked |= wanted[:, s]
                    for i, near in zip(some, marked, strict=True):
                        at = np.flatnonzero(near & (ids != qid[i]))
                        d = np.concatenate([best[i][0], np.sqrt(((x[at] - q[i]) ** 2).sum(axis=1))])
                        n = np.concatenate([best[i][1], ids[at]])
                        order = np.lexsort((n, d))[:k]
                        best[i] = d[order], n[order]
            found = np.concatenate([n for _, n in best])
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qid, [len(n) for _, n in best])), pa.array(found), pa.array(np.concatenate([d for d, _ in best]))], names=["query_id", "neighbour_id", "distance"])

        rows_in = corpus.select(F.col(id_col).cast("long"), F.col(vector).cast("array<float>"))
        parts.append(rows_in.mapInArrow(run, "query_id bigint, neighbour_id bigint, distance double"))
    if not parts:
        return spark.createDataFrame([], "query_id bigint, neighbour_id bigint, distance double, rank int")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    w = Window.partitionBy("query_id").orderBy("distance", "neighbour_id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
