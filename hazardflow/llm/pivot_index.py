"""Exact top-k by inner product over an index of pivots and distances.

Components become integers, floor(scale * x). With M the largest norm, a row x becomes (x,
sqrt(M^2 - |x|^2)) and a query q becomes (q * M / |q|, 0): then the nearest rows are those of the
largest inner product. Every row is keyed by its nearest pivot and its distance to it; rows sorted
by these keys are cut into annuli. A query first searches the annuli of the least lower bound
(triangle inequality: its distance to the pivot against the annulus' range), which gives it k scores
to beat, and then every other annulus whose bound can still beat or equal the k-th; all others are
left out, and no row that could be in the answer is.

The pivots are picked from a bounded sample (SAMPLE rows by hash order, farthest first); every row is
indexed and the result is exact, whatever the pivots.

Scale: equal vectors are made one row with their k + 1 smallest ids first (limited per task before
the shuffle), so a very common vector cannot fill an annulus. Annuli hold ANNULUS rows, more only
beyond MAX_ANNULI of them, so their ranges (MAX_ANNULI rows at most) are small enough for the driver
and every task. Queries meet an annulus in blocks of QUERIES, never all at once.

Edge cases: null vectors, vectors with null or non-finite components and null ids take no part;
vectors of another length than a query's are no candidates for it; ties go to the smaller id; a zero
query ranks by id; fewer candidates than k give fewer rows; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hazardflow.session import written

SCALE = 256
K = 5
PIVOTS = 48
SAMPLE = 4000
ANNULUS = 2048
MAX_ANNULI = 50_000
QUERIES = 4096
FIRST_ANNULI = 2
EXACT = float(1 << 53)


def integers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, size, vector (little-endian 64-bit integers) of the rows that take part."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            flat = lists.flatten().cast(pa.float64())
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
            value = pc.fill_null(flat, float("nan")).to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(len(lists)), sizes)
            good = np.bincount(owner, ~np.isfinite(value), len(lists)) == 0
            good &= lists.is_valid().to_numpy(zero_copy_only=False)
            whole = np.floor(scale * np.where(np.isfinite(value), value, 0)).astype("<i8")
            stops = np.cumsum(sizes)
            keep = np.flatnonzero(good)
            rows = [whole[stops[i] - sizes[i] : stops[i]].tobytes() for i in keep]
            yield pa.record_batch([batch.column(0).take(pa.array(keep)).cast(pa.int64()), pa.array(sizes[keep], pa.int32()), pa.array(rows, pa.binary())], ["vec_id", "size", "vector"])

    named = vectors.filter("vec_id is not null and embedding is not null").select("vec_id", "embedding")
    return named.mapInArrow(each, "vec_id long, size int, vector binary")


def _matrix(rows: list[bytes], size: int) -> np.ndarray:
    return np.frombuffer(b"".join(rows), "<i8").reshape(len(rows), size)


def _lifted(rows: np.ndarray, norm: float) -> np.ndarray:
    """The rows with the coordinate that gives all of them one norm."""
    plain = rows.astype(float)
    rest = np.sqrt(np.maximum(norm**2 - (plain**2).sum(1), 0))
    return np.concatenate([plain, rest[:, None]], 1)


def _distances(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    squares = (rows**2).sum(1)[:, None] + (pivots**2).sum(1)[None, :] - 2 * rows @ pivots.T
    return np.sqrt(np.maximum(squares, 0))


def _products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Integer inner products; by floating point where that is exact."""
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * rows.shape[1]
    if most < EXACT:
        return (queries.astype(float) @ rows.T.astype(float)).astype(np.int64)
    return queries @ rows.T


def pick_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Rows of the sample, each the farthest from those before it."""
    chosen = [sample[0]]
    far = _distances(sample, sample[:1])[:, 0]
    while len(chosen) < min(count, len(sample)) and far.max() > 0:
        chosen.append(sample[int(np.argmax(far))])
        far = np.minimum(far, _distances(sample, chosen[-1][None, :])[:, 0])
    return np.array(chosen)


def _annuli(distinct: DataFrame, size: int, rows: int, pivots: np.ndarray, norm: float, parts: int) -> DataFrame:
    """annulus, pivot, low, high, n, vectors, ids: blocks of rows of one pivot sorted by distance."""

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            away = _distances(_lifted(_matrix(batch["vector"].to_pylist(), size), norm), pivots)
            nearest = away.argmin(1)
            columns = [pa.array(nearest, pa.int32()), pa.array(away[np.arange(len(away)), nearest]), batch["vector"], batch["ids"]]
            yield pa.record_batch(columns, ["pivot", "distance", "vector", "ids"])

    keyed = distinct.select("vector", "ids").mapInArrow(key, "pivot int, distance double, vector binary, ids array<long>")
    ordered = keyed.repartitionByRange(parts, "pivot", "distance", F.xxhash64("vector")).sortWithinPartitions("pivot", "distance")

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def out():
            own = [np.array(c) for c in zip(*[(h[0], h[1]) for h in held], strict=True)]
            columns = [
                pa.array([int(own[0][0])], pa.int32()), pa.array([own[1].min()]), pa.array([own[1].max()]), pa.array([len(held)], pa.int32()),
                pa.array([b"".join([h[2] for h in held])], pa.binary()), pa.array([[h[3] for h in held]], pa.list_(pa.list_(pa.int64()))),
            ]
            return pa.record_batch(columns, ["pivot", "low", "high", "n", "vectors", "ids"])

        for batch in batches:
            for row in zip(*[batch[c].to_pylist() for c in ("pivot", "distance", "vector", "ids")], strict=True):
                if held and (held[0][0] != row[0] or len(held) >= rows):
                    yield out()
                    held.clear()
                held.append(row)
        if held:
            yield out()

    blocks = ordered.mapInArrow(block, "pivot int, low double, high double, n int, vectors binary, ids array<array<long>>")
    return blocks.withColumn("annulus", F.xxhash64("pivot", "low", "high", "vectors"))


def _search(annuli: DataFrame, wanted: DataFrame, size: int, k: int) -> DataFrame:
    """query (vector), vec_id, score: the k best of each annulus for each query that wants it."""

    def best(blocks: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if blocks.num_rows and asked.num_rows:
            rows = np.frombuffer(blocks["vectors"][0].as_py(), "<i8").reshape(blocks["n"][0].as_py(), size)
            ids = blocks["ids"][0].as_py()
            vectors = asked["query"].to_pylist()
            for start in range(0, len(vectors), 512):
                scores = _products(_matrix(vectors[start : start + 512], size), rows)
                for query, own in zip(vectors[start : start + 512], scores, strict=True):
                    edge = np.partition(own, max(0, len(own) - k))[max(0, len(own) - k)]
                    found = sorted((-int(own[i]), x) for i in np.flatnonzero(own >= edge) for x in ids[i])[:k]
                    out[0] += [query] * len(found)
                    out[1] += [x for _, x in found]
                    out[2] += [-s for s, _ in found]
        return pa.table([pa.array(out[0], pa.binary()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64())], ["query", "vec_id", "score"])

    asked = wanted.withColumn("part", F.pmod(F.xxhash64("query"), F.lit(_parts(wanted))).cast("int"))
    needed = asked.select("annulus", F.col("part").alias("own_part")).distinct().join(annuli, "annulus").withColumnRenamed("annulus", "own")
    asked = asked.select("annulus", "part", "query")
    return needed.groupBy("own", "own_part").cogroup(asked.groupBy("annulus", "part")).applyInArrow(best, "query binary, vec_id long, score long")


def _parts(wanted: DataFrame) -> int:
    return max(1, -(-wanted.agg(F.approx_count_distinct("query")).first()[0] // QUERIES))


def _leading(found: DataFrame, key: str, k: int) -> DataFrame:
    order = Window.partitionBy(key).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _one_size(rows: DataFrame, asking: DataFrame, size: int, k: int) -> DataFrame:
    spark = rows.sparkSession
    order = Window.partitionBy("vector").orderBy("vec_id")
    few = rows.select("vector", "vec_id").distinct().withColumn("turn", F.row_number().over(order)).filter(F.col("turn") <= k + 1)
    distinct = written(few.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "vectors")

    def norms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            squares = (_matrix(batch["vector"].to_pylist(), size).astype(float) ** 2).sum(1)
            yield pa.record_batch([pa.array(squares)], ["square"])

    size_of = distinct.select("vector").mapInArrow(norms, "square double").agg(F.max("square"), F.count(F.lit(1))).first()
    norm, count = float(np.sqrt(size_of[0])) * (1 + 1e-9), size_of[1]
    picked = distinct.select("vector").orderBy(F.xxhash64("vector"), "vector").limit(SAMPLE).collect()
    pivots = pick_pivots(_lifted(_matrix([bytes(r["vector"]) for r in picked], size), norm), PIVOTS)
    rows_each = max(ANNULUS, -(-count // MAX_ANNULI))
    parts = max(1, -(-count // (4 * rows_each)))
    annuli = written(_annuli(distinct, size, rows_each, pivots, norm, parts), "annuli")
    edges = annuli.select("annulus", "pivot", "low", "high").orderBy("annulus").toArrow()  # at most 2 * MAX_ANNULI + parts rows
    held = spark.sparkContext.broadcast([edges[c].to_numpy() for c in ("annulus", "pivot", "low", "high")])

    def bounds(vectors: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Least distance of each query to each annulus, and the factor from scores to the scaled query's."""
        queries = _matrix(vectors, size).astype(float)
        length = np.sqrt((queries**2).sum(1))
        factor = norm / np.maximum(length, 1e-12)
        scaled = np.concatenate([queries * factor[:, None], np.zeros((len(queries), 1))], 1)
        _, pivot, low, high = held.value
        away = _distances(scaled, pivots)[:, pivot]
        least = np.maximum(0, np.maximum(away - high, low - away))
        least[length == 0] = 0
        return least, factor

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch["query"].to_pylist()
            for start in range(0, len(vectors), 256):
                own = vectors[start : start + 256]
                least, _ = bounds(own)
                take = np.argsort(least, axis=1, kind="stable")[:, :FIRST_ANNULI]
                yield pa.record_batch([pa.array([q for q, t in zip(own, take, strict=True) for _ in t], pa.binary()), pa.array(held.value[0][take.ravel()])], ["query", "annulus"])

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch[c].to_pylist() for c in ("query", "beat", "seen")]
            for start in range(0, len(columns[0]), 256):
                own, beat, seen = (c[start : start + 256] for c in columns)
                least, factor = bounds(own)
                most = norm**2 - least**2 / 2  # of the scaled query's product
                floor = np.array([-np.inf if b is None else b for b in beat], float) * factor
                wanted = most >= floor[:, None] - 1e-6 * (norm**2 + 1)
                number = {a: i for i, a in enumerate(held.value[0].tolist())}
                for i, done in enumerate(seen):
                    wanted[i, [number[a] for a in done]] = False
                at, which = np.nonzero(wanted)
                yield pa.record_batch([pa.array([own[i] for i in at], pa.binary()), pa.array(held.value[0][which])], ["query", "annulus"])

    queries = asking.select(F.col("vector").alias("query")).distinct()
    near = written(queries.mapInArrow(first, "query binary, annulus long"), "first-annuli")
    found = written(_search(annuli, near, size, k + 1), "first-found")
    beat = _leading(found, "query", k + 1).groupBy("query").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n"))
    beat = beat.select(F.col("query").alias("q"), F.when(F.col("n") > k, F.col("least")).alias("beat"))
    seen = near.groupBy("query").agg(F.collect_list("annulus").alias("seen"))
    known = seen.join(beat, F.col("query") == F.col("q"), "left").select("query", "beat", "seen")
    rest = written(known.mapInArrow(others, "query binary, annulus long"), "other-annuli")
    every = found.unionByName(_search(annuli, rest, size, k + 1))
    best = _leading(every, "query", k + 1).drop("rank")
    pairs = asking.select(F.col("vec_id").alias("query_id"), F.col("vector").alias("query")).distinct().join(best, "query")
    return _leading(pairs.filter("vec_id <> query_id"), "query_id", k).select("query_id", "rank", "vec_id", "score")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: for each query row its k best other rows (ties to the smaller id).

    Both tables have vec_id and embedding; queries are rows of the vectors.
    """
    spark = vectors.sparkSession
    rows = written(integers(vectors, scale), "integers")
    asking = written(integers(queries, scale), "queries")
    sizes = [r["size"] for r in asking.select("size").distinct().orderBy("size").collect()]
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    for size in sizes:
        out = out.unionByName(_one_size(rows.filter(F.col("size") == size), asking.filter(F.col("size") == size), size, k))
    return out
