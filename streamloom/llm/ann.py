"""Approximate nearest neighbours by shifted space-filling curves."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import hash_pair, written

#: Components of the vectors that the curves' ranges are fitted on (16 MB of floats); every vector is indexed.
SAMPLE_FLOATS = 1 << 22
#: Vectors of the sample whose nearest in the whole table say how wide windows must be.
ASKED = 256
CURVES, FIRST, DIMS, BITS = 16, 4, 8, 7
#: Rows of a key window that meet in one task: larger windows are dealt over several.
CHUNK, QUERY_CHUNK = 8192, 4096
#: Ranges that a curve can be cut into, and the recall that the cut must reach for the vectors asked.
LADDER, TARGET = (8192, 4096, 2048, 1024, 512, 384, 256, 192, 128, 96, 80, 64, 56, 48, 40, 32, 24, 16, 12, 8, 6, 4, 1), 0.93


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of cells (rows of coordinates below ``2**bits``), as int64."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    for level in range(bits - 1, 0, -1):  # undo the turns and mirrors of each level, from the largest
        low = (1 << level) - 1
        for i in range(dims):
            high = (x[i] >> level) & 1
            swap = np.where(high == 1, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high == 1, low, swap)
            if i:
                x[i] ^= swap
    for i in range(1, dims):  # Gray code of the coordinates' bits
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] >> level) & 1, (1 << level) - 1, 0)
    x ^= flip
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> level) & 1)
    return key


@dataclass
class Curves:
    """Projections, shifts and range bounds of all curves: some hundred KB, whatever the input's size."""

    longest: float
    planes: np.ndarray  # curve x (dimensions + 1) x DIMS
    low: np.ndarray  # curve x DIMS
    step: np.ndarray
    bounds: list[np.ndarray] = None

    def lifted(self, x: np.ndarray, query: bool) -> np.ndarray:
        """One more coordinate makes the nearest in distance those of the largest inner product."""
        square = (x**2).sum(1)
        if query:
            return np.column_stack([x * (self.longest / np.sqrt(square))[:, None], np.zeros(len(x))])
        return np.column_stack([x, np.sqrt(np.maximum(self.longest**2 - square, 0))])

    def keys(self, lifted: np.ndarray, curve: int) -> np.ndarray:
        cells = np.floor((lifted @ self.planes[curve] - self.low[curve]) / self.step[curve])
        return hilbert_keys(np.clip(cells, 0, (1 << BITS) - 1), BITS)


def random_curves(sample: np.ndarray, longest: float, seed: int = 7) -> Curves:
    """Random projections, each with a grid of its own shift that covers the sample."""
    rng = np.random.default_rng(seed)
    dims = sample.shape[1] + 1
    planes = np.stack([np.linalg.qr(rng.normal(size=(dims, DIMS)))[0] if dims >= DIMS else rng.normal(size=(dims, DIMS)) for _ in range(CURVES)])
    curves = Curves(longest, planes, np.empty((CURVES, DIMS)), np.empty((CURVES, DIMS)))
    points = curves.lifted(sample, False)
    for c in range(CURVES):
        p = points @ planes[c]
        middle, half = p.mean(0), np.maximum(3.5 * p.std(0), 1e-9)
        curves.step[c] = 2 * half / ((1 << BITS) - 1)
        curves.low[c] = middle - half - rng.uniform(0, 1, DIMS) * half / 2
        curves.step[c] *= 1.25
    return curves


def cut_curves(curves: Curves, sample: np.ndarray, asked: np.ndarray, near: np.ndarray, owner: np.ndarray) -> Curves:
    """Cut the curves into the most ranges, equal shares of the sample, with which ``TARGET`` of the
    vectors ``near`` are in the range of the asking vector ``owner`` names or in the two beside it, on
    any curve. As these are the nearest of the whole table, the cut is as fine as the table allows."""
    points = curves.lifted(sample, False)
    keys = [np.sort(curves.keys(points, c)) for c in range(CURVES)]
    wanted = [curves.keys(curves.lifted(asked, True), c) for c in range(CURVES)]
    held = [curves.keys(curves.lifted(near, False), c) for c in range(CURVES)]
    for ranges in LADDER:
        if ranges * 4 > len(sample) and ranges > 1:
            continue
        curves.bounds = [x[(np.arange(1, ranges) * len(x)) // ranges] for x in keys]
        met = np.zeros(len(near), bool)
        for c, bounds in enumerate(curves.bounds):
            met |= np.abs(np.searchsorted(bounds, held[c], "right") - np.searchsorted(bounds, wanted[c], "right")[owner]) <= 1
        if ranges == 1 or len(met) and met.mean() >= TARGET:
            return curves
    raise AssertionError("one range finds everything")


def _matrix(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    """Vectors of raw components, of 4 or 8 bytes each."""
    rows = column.to_pylist()
    kind = np.float32 if rows and len(rows[0]) == 4 * dims else np.float64
    return np.frombuffer(b"".join(rows), kind).reshape(-1, dims).astype(np.float64)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to smaller ids."""
    if len(scores) > k:
        near = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ids[near], -scores[near]))][:k]


def nearest(vectors: DataFrame, query_mod: int = 20, k: int = 20) -> DataFrame:
    """The ``k`` nearest found of every row whose vec_id is divisible by ``query_mod``, by inner product.

    Equal vectors are one point of the index, with their ``k + 1`` smallest ids: more can't be among
    anyone's ``k`` nearest. Points are projected to several randomly turned and shifted grids and put
    in Hilbert order; each curve is cut into key ranges, and a query meets its range and the two
    beside it. Range by range the best are reranked on the original vectors, then merged over curves.

    The ranges are shares of a bounded sample; how many there are follows from the nearest of
    ``ASKED`` sampled vectors in the whole table, found exactly in one pass without shuffle
    (``cut_curves``). Every point is indexed. Ranges of over ``CHUNK`` points are dealt over several
    tasks, queries too, so no task grows with the input. The ``FIRST`` curves give each query k
    points; of the other curves, ranges send on only what is no worse.

    Returns ``query_id``, ``rank`` (from 1), ``vec_id``, ``score``, computed in double precision on the
    components as they are (floats or doubles). Vectors that are null, zero, hold null or non-finite
    components take no part, nor do rows without vec_id; vectors of different lengths have no inner
    product, so each length is searched on its own. Rows that agree in both columns count once; if
    one id has several vectors, it takes part with each and is listed with its best. An empty table
    gives an empty result.
    """
    spark = vectors.sparkSession
    e = F.col("embedding")
    kind = "float" if isinstance(vectors.schema["embedding"].dataType.elementType, T.FloatType) else "double"
    sound = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    rows = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), vectors["embedding"].cast(f"array<{kind}>").alias("embedding")).filter(F.col("vec_id").isNotNull() & sound)
    square = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    lengths = rows.groupBy(F.size("embedding").alias("dims")).agg(F.max(square).alias("square")).collect()  # one row a length
    found = [_of_length(rows.filter(F.size("embedding") == r["dims"]), r["dims"], r["square"], query_mod, k) for r in lengths]
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    pairs = reduce(DataFrame.unionByName, found)
    if len(found) > 1:  # an id may have vectors of several lengths
        pairs = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(final)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _exact(points: DataFrame, asked: np.ndarray, dims: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of the points nearest to a few asked ones (not themselves), and whose they are."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(1).flatten().to_numpy().reshape(-1, dims)
            scores = asked @ x.T.astype(np.float64)
            take = min(k, len(x))
            near = np.argpartition(-scores, take - 1, axis=1)[:, :take]
            owner = np.repeat(np.arange(len(asked), dtype=np.int32), take)
            yield pa.RecordBatch.from_arrays([pa.array(owner), pa.array(np.take_along_axis(scores, near, 1).ravel()), pa.array([r.tobytes() for r in x[near.ravel()]], pa.binary())], names=["owner", "score", "raw"])

    own = Window.partitionBy("owner").orderBy(F.desc("score"))
    rows = points.select("point", "embedding").mapInArrow(best, "owner int, score double, raw binary")
    rows = rows.withColumn("place", F.row_number().over(own)).filter(F.col("place") <= k).select("owner", "raw").toArrow()
    near, owner = _matrix(rows["raw"], dims), rows["owner"].to_numpy()
    other = (near != asked[owner]).any(1)
    return near[other], owner[other]


def _of_length(rows: DataFrame, dims: int, square: float, query_mod: int, k: int) -> DataFrame:
    """``query_id``, ``vec_id``, ``score`` of vectors of one length: at least the ``k`` best found of each query."""
    spark, wide = rows.sparkSession, k + 1
    h1, h2 = hash_pair(F.col("embedding"))
    rows = rows.withColumns({"h1": h1, "h2": h2})
    order = Window.partitionBy("h1", "h2").orderBy("vec_id")
    few = rows.distinct().withColumn("place", F.row_number().over(order)).filter(F.col("place") <= wide)  # cut in each map task, then per vector
    queries = rows.filter(F.col("vec_id") % query_mod == 0).select("h1", "h2", F.col("vec_id").alias("query_id")).distinct()
    points = few.groupBy("h1", "h2").agg(F.min("vec_id").alias("point"), F.array_sort(F.collect_list("vec_id")).alias("ids"), F.first("embedding").alias("embedding"))
    asks = queries.groupBy("h1", "h2").agg(F.lit(True).alias("asked"))
    points = written(points.join(asks, ["h1", "h2"], "left").select("h1", "h2", "point", "ids", "embedding", F.coalesce("asked", F.lit(False)).alias("asked")))
    sample = points.select("embedding").orderBy("h1").limit(max(ASKED, SAMPLE_FLOATS // dims)).toArrow()["embedding"]
    sample = sample.combine_chunks().flatten().to_numpy().reshape(-1, dims).astype(np.float64)
    longest = max(np.sqrt(square), np.sqrt((sample**2).sum(1)).max())
    wanted = sample[np.random.default_rng(5).permutation(len(sample))[:ASKED]]
    curves = cut_curves(random_curves(sample, longest), sample, wanted, *_exact(points, wanted, dims, k + 1))
    shared = spark.sparkContext.broadcast(curves)
    names = ["curve", "range", "is_query", "point", "raw", "floor"]

    def place(some: range):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            curves = shared.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                point, asked = batch.column(0), batch.column(2).to_numpy(zero_copy_only=False)
                x = batch.column(1).flatten().to_numpy().reshape(-1, dims)
                raw = pa.array([r.tobytes() for r in x], pa.binary())
                data, ask = curves.lifted(x.astype(np.float64), False), curves.lifted(x[asked].astype(np.float64), True)
                which = pa.array(np.flatnonzero(asked))
                for c in some:
                    at = np.searchsorted(curves.bounds[c], curves.keys(data, c), "right")
                    cols = [pa.array(np.full(len(x), c, np.int32)), pa.array(at.astype(np.int32)), pa.array(np.zeros(len(x), bool)), point, raw, pa.array(np.zeros(len(x)))]
                    yield pa.RecordBatch.from_arrays(cols, names=names)
                    if not len(ask):
                        continue
                    at = np.searchsorted(curves.bounds[c], curves.keys(ask, c), "right")
                    for beside in (-1, 0, 1):
                        ok = pa.array((at + beside >= 0) & (at + beside <= len(curves.bounds[c])))
                        cols = [pa.array(np.full(len(ask), c, np.int32)), pa.array((at + beside).astype(np.int32)), pa.array(np.ones(len(ask), bool)), point.take(which), raw.take(which), batch.column(3).take(which)]
                        yield pa.RecordBatch.from_arrays([v.filter(ok) for v in cols], names=names)

        return run

    kinds = "curve int, range int, is_query boolean, point long, raw binary, floor double"
    lowest = points.withColumn("floor", F.lit(float("-inf"))).select("point", "embedding", "asked", "floor")
    # one row per curve and range, at most CURVES * 2048
    counts = lowest.mapInArrow(place(range(CURVES)), kinds).groupBy("curve", "range").agg(F.count_if(~F.col("is_query")).alias("n"), F.count_if("is_query").alias("q")).collect()
    split = [(r["curve"], r["range"], -(-r["n"] // CHUNK), -(-r["q"] // QUERY_CHUNK)) for r in counts if r["n"] > CHUNK or r["q"] > QUERY_CHUNK]

    def dealt(placed: DataFrame) -> DataFrame:
        """Large ranges in parts: points once for each part of the queries, and the other way round."""
        if not split:
            return placed.withColumns({"part": F.lit(0), "asked": F.lit(0)})
        table = F.broadcast(spark.createDataFrame(split, "curve int, range int, parts int, asks int"))
        own = lambda n: F.pmod(F.xxhash64("point"), F.greatest(n, F.lit(1))).cast("int")
        every = lambda n: F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1)
        n, q = F.coalesce("parts", F.lit(1)), F.coalesce("asks", F.lit(1))
        placed = placed.join(table, ["curve", "range"], "left")
        placed = placed.withColumn("part", F.explode(F.when(F.col("is_query"), every(n)).otherwise(F.array(own(n)))))
        return placed.withColumn("asked", F.explode(F.when(F.col("is_query"), F.array(own(q))).otherwise(every(q)))).drop("parts", "asks")

    def rerank(table: pa.Table) -> pa.Table:
        is_query = table["is_query"]
        ask, data = table.filter(is_query), table.filter(pa.compute.invert(is_query))
        query, point, floor = ask["point"].to_numpy(), data["point"].to_numpy(), ask["floor"].to_numpy()
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(query) and len(point):
            d = _matrix(data["raw"], dims)
            for start in range(0, len(query), 256):
                part = ask.slice(start, 256)
                scores = _matrix(part["raw"], dims) @ d.T
                for i, row in enumerate(scores):
                    near = np.flatnonzero(row >= floor[start + i])
                    near = near[_best(row[near], point[near], wide)]
                    found.append((np.full(len(near), query[start + i]), point[near], row[near]))
        parts = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        return pa.table({"query": pa.array(parts[0], pa.int64()), "point": pa.array(parts[1], pa.int64()), "score": pa.array(parts[2], pa.float64())})

    def reranked(table: DataFrame, some: range) -> DataFrame:
        placed = dealt(table.mapInArrow(place(some), kinds))
        return placed.groupBy("curve", "range", "part", "asked").applyInArrow(rerank, "query long, point long, score double")

    best = Window.partitionBy("query").orderBy(F.desc("score"), "point")

    def merged(found: DataFrame) -> DataFrame:
        found = found.groupBy("query", "point").agg(F.max("score").alias("score"))
        return found.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= wide).drop("place")

    begun = written(merged(reranked(lowest, range(FIRST))))
    floors = begun.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).filter(F.col("n") == wide)
    floors = floors.select(F.col("query").alias("point"), (F.col("least") - 1e-9 * F.abs("least")).alias("floor"))  # one pair's products may differ in the last bits
    raised = points.select("point", "embedding", "asked").join(floors, "point", "left").select("point", "embedding", "asked", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"))
    found = merged(begun.unionByName(reranked(raised, range(FIRST, CURVES))))
    # back from points to ids, and from asking points to the queries that share them
    members = found.join(points.select("point", "ids"), "point").withColumn("vec_id", F.explode("ids"))
    short = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    members = members.withColumn("place", F.row_number().over(short)).filter(F.col("place") <= 2 * wide).select("query", "vec_id", "score")
    who = queries.join(points.filter("asked").select("h1", "h2", F.col("point").alias("query")), ["h1", "h2"]).select("query_id", "query")
    return who.join(members, "query").filter("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
