"""Approximate nearest neighbours by an adaptive dimension scan in probed lists.

Vectors belong to the list of their nearest centroid; a query probes the lists
nearest to it. Within a list, vectors are rotated at random and read in blocks
of columns: after each block, a hypothesis test on the partial distance tells
whether a candidate can still be among the nearest, and the others are left.

Inner products become distances by one more column: with M the largest norm,
x gets sqrt(M^2 - |x|^2) and q gets 0, so the nearest has the largest product.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuesheet.llm.common import written

NEAREST = 20
# Lists, the rotation and the number of probes are fitted on this many vectors at most.
FIT_VECTORS = 20_000
LIST_VECTORS = 1000
FIT_PER_LIST = 40
# Part of the true neighbours that the probed lists should hold, measured on the sample.
PROBED_RECALL = 0.975
_MEASURED = 300
# A list meets its queries in pieces of this many vectors and queries.
_VECTORS_AT_ONCE, _QUERIES_AT_ONCE = 4096, 1024
# Queries compared with the whole sample at a time.
_ASKED_AT_ONCE = 256
_COLUMNS, _ROWS = 16, 512
# Width of the hypothesis test: at 2.1 it wrongly leaves a candidate very rarely.
EPSILON = 2.1


@dataclass
class Index:
    centroids: np.ndarray  # in the space with the added column
    rotation: np.ndarray
    norm: float  # the largest norm
    order_ids: np.ndarray  # sample: ids, vectors and lists
    sample: np.ndarray
    lists: np.ndarray
    sizes: np.ndarray  # vectors of every list in the whole table
    probes: int


def usable(vector: Column) -> Column:
    """Whether a vector is neither null nor zero and all components are finite."""
    finite = F.forall(
        vector,
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))),
    )
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of a list column, all of the same length."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _added(vectors: np.ndarray, norm: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(norm * norm - (vectors * vectors).sum(axis=1), 0))
    return np.hstack([vectors, rest[:, None]])


def _asked(queries: np.ndarray) -> np.ndarray:
    return np.hstack([queries, np.zeros((len(queries), 1))])


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)


def _centroids(points: np.ndarray, count: int, rounds: int = 10) -> np.ndarray:
    rng = np.random.default_rng(3)
    centroids = points[rng.choice(len(points), count, replace=False)]
    for _ in range(rounds):
        nearest = _distances(points, centroids).argmin(axis=1)
        held = np.bincount(nearest, minlength=count)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, points)
        centroids = np.where(held[:, None] > 0, sums / np.maximum(held, 1)[:, None], centroids)
    return centroids


def fit(ids: np.ndarray, sample: np.ndarray, norm: float, rows: int) -> Index:
    """Lists from a sample; the number of probes is the smallest with which the
    lists hold `PROBED_RECALL` of the sample's own true neighbours."""
    points = _added(sample, norm)
    count = max(1, min(-(-rows // LIST_VECTORS), len(sample) // FIT_PER_LIST))
    centroids = _centroids(points, count)
    lists = _distances(points, centroids).argmin(axis=1)
    rotation, _ = np.linalg.qr(np.random.default_rng(4).normal(size=(points.shape[1],) * 2))
    rng = np.random.default_rng(5)
    asked = rng.choice(len(sample), min(_MEASURED, len(sample)), replace=False)
    product = sample[asked] @ sample.T
    product[np.arange(len(asked)), asked] = -np.inf
    k = min(NEAREST, len(sample) - 1)
    near = np.argpartition(-product, max(k - 1, 0), axis=1)[:, :k]
    rank = _distances(_asked(sample[asked]), centroids).argsort(axis=1).argsort(axis=1)
    needed = np.sort(np.take_along_axis(rank, lists[near], axis=1).ravel())
    probes = 1 + int(needed[min(len(needed) - 1, int(PROBED_RECALL * len(needed)))]) if len(needed) else 1
    return Index(centroids, rotation, norm, ids, sample, lists, np.zeros(count, np.int64), probes)


def probed(index: Index, queries: np.ndarray) -> np.ndarray:
    """(query, list): the nearest lists, more than `probes` where these hold too few vectors."""
    order = _distances(_asked(queries), index.centroids).argsort(axis=1, kind="stable")
    before = np.cumsum(index.sizes[order], axis=1) - index.sizes[order]
    place = np.arange(order.shape[1])[None, :]
    take = (place < index.probes) | (before <= NEAREST)
    out = np.zeros(order.shape, dtype=bool)
    np.put_along_axis(out, order, take, axis=1)
    return out


def scan(
    index: Index,
    queries: np.ndarray,
    asking: np.ndarray,
    vectors: np.ndarray,
    ids: np.ndarray,
    bound: np.ndarray,
) -> tuple[np.ndarray, np.ndarray]:
    """(query, vector) pairs that an adaptive scan of one list's piece leaves:
    for each query those among the nearest of another id, none farther than its
    `bound`."""
    q = _asked(queries) @ index.rotation
    x = _added(vectors, index.norm) @ index.rotation
    width = q.shape[1]
    limit = bound.copy()
    kept_q, kept_x, kept_d = [], [], []
    for start in range(0, len(x), _ROWS):
        part = x[start : start + _ROWS]
        partial = np.zeros((len(q), len(part)))
        alive = asking[:, None] != ids[None, start : start + _ROWS]
        rows = cols = None
        for low in range(0, width, _COLUMNS):
            high = min(width, low + _COLUMNS)
            a, b = q[:, low:high], part[:, low:high]
            if rows is None:
                partial += _distances(a, b)
            else:
                gap = a[rows] - b[cols]
                partial[rows, cols] += (gap * gap).sum(axis=1)
            if high < width:
                # The whole distance exceeds the limit unless chance made these columns large.
                reach = limit * (high / width) * (1 + EPSILON / np.sqrt(high)) ** 2
                if rows is None:
                    alive &= partial <= reach[:, None]
                    if alive.mean() < 0.2:
                        rows, cols = np.nonzero(alive)
                else:
                    stay = partial[rows, cols] <= reach[rows]
                    rows, cols = rows[stay], cols[stay]
        if rows is None:
            rows, cols = np.nonzero(alive)
        d = partial[rows, cols]
        near = d <= limit[rows] * (1 + 1e-9) + 1e-12
        kept_q.append(rows[near])
        kept_x.append(cols[near] + start)
        kept_d.append(d[near])
        if start + _ROWS < len(x):
            rows, cols, d = (np.concatenate(k) for k in (kept_q, kept_x, kept_d))
            order = np.lexsort((d, rows))
            rows, cols, d = rows[order], cols[order], d[order]
            place = np.arange(len(rows)) - np.searchsorted(rows, rows)
            last = place == NEAREST - 1
            limit[rows[last]] = np.minimum(limit[rows[last]], d[last])
            # Equal distances stay: ties are settled by id, on exact scores.
            stay = d <= limit[rows] * (1 + 1e-9) + 1e-12
            kept_q, kept_x, kept_d = [rows[stay]], [cols[stay]], [d[stay]]
    return np.concatenate(kept_q or [np.zeros(0, int)]), np.concatenate(kept_x or [np.zeros(0, int)])


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", q, x)


def _best(query: np.ndarray, vec: np.ndarray, score: np.ndarray) -> np.ndarray:
    """Places of each query's `NEAREST` pairs: largest score, then smallest id."""
    order = np.lexsort((vec, -score, query))
    place = np.arange(len(order)) - np.searchsorted(query[order], query[order])
    return order[place < NEAREST]


def build(vectors: DataFrame) -> Index | None:
    """An index over all of (vec_id, vector); None for an empty table."""
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    rows, largest = vectors.agg(F.count("*"), F.max(norm)).first()
    if not rows:
        return None
    spread = F.xxhash64("vec_id", "vector")
    sample = vectors.select("vec_id", "vector", spread.alias("h"))
    if rows > 4 * FIT_VECTORS:  # enough are left below this bound; no task sorts more
        sample = sample.where(F.shiftrightunsigned("h", 32) < (4 * FIT_VECTORS << 32) // rows)
    table = sample.orderBy("h", "vec_id").limit(FIT_VECTORS).select("vec_id", "vector").toArrow()
    ids = table.column("vec_id").to_numpy()
    return fit(ids, matrix(table.column("vector")), float(largest), rows)


def nearest_neighbours(
    table: DataFrame, queries: Column, vec_id: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """Each query's `NEAREST` rows of largest inner product: query_id, rank, vec_id, score.

    Queries are the rows for which `queries` holds; candidates are all rows of
    another id. Ties go to the smaller id, and scores are exact, in double
    precision. Rows with a null id or a vector that is null, zero, of another
    length than most, or holds null or non-finite components take no part. Of
    rows that share an id, one takes part: that of the largest vector, compared
    by component. A query with fewer candidates gets them all; an empty table
    gives an empty result.
    """
    spark = table.sparkSession
    rows = table.where(F.col(vec_id).isNotNull() & usable(F.col(vector))).select(
        F.col(vec_id).cast("long").alias("vec_id"),
        F.col(vector).alias("vector"),
        F.coalesce(queries, F.lit(False)).alias("asks"),
    )
    common = (
        rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    )
    kind = rows.schema["vector"].dataType.simpleString()
    if common is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = (
        rows.where(F.size("vector") == common["n"])
        .groupBy("vec_id")
        .agg(F.max("vector").alias("vector"), F.max("asks").alias("asks"))
    )
    index = build(rows.select("vec_id", "vector"))
    shared = spark.sparkContext.broadcast(index)

    def assign(batches):
        for batch in batches:
            x = matrix(batch.column("vector"))
            own = shared.value
            near = _distances(_added(x, own.norm), own.centroids).argmin(axis=1) if len(x) else []
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(near, pa.int32())], names=[*batch.schema.names, "list"]
            )

    listed = written(
        rows.mapInArrow(assign, f"vec_id long, vector {kind}, asks boolean, list int"), "lists"
    )
    for list_, size in listed.groupBy("list").count().collect():
        index.sizes[list_] = size
    full = spark.sparkContext.broadcast(index)

    def ask(batches):
        """The lists to probe, and how far a neighbour may be: as far as the
        20th of the sample's vectors in these lists."""
        for batch in batches:
            own, q = full.value, matrix(batch.column("vector"))
            if not len(q):
                continue
            ids = batch.column("vec_id").to_numpy()
            lists = probed(own, q)
            bound = np.full(len(q), np.inf)
            for start in range(0, len(q) if len(own.sample) >= NEAREST else 0, _ASKED_AT_ONCE):
                part = slice(start, start + _ASKED_AT_ONCE)
                product = q[part] @ own.sample.T
                product[~lists[part][:, own.lists] | (ids[part, None] == own.order_ids[None, :])] = -np.inf
                low = np.partition(product, -NEAREST, axis=1)[:, -NEAREST]
                reach = (q[part] * q[part]).sum(axis=1) + own.norm**2 - 2 * low
                bound[part] = np.where(np.isfinite(low), reach, np.inf)
            flat = pa.array(np.nonzero(lists)[1], pa.int32())
            offsets = pa.array(np.append(0, np.cumsum(lists.sum(axis=1))), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("vector"), pa.array(bound), pa.ListArray.from_arrays(offsets, flat)],
                names=["query_id", "query", "bound", "lists"],
            )

    asked = written(
        listed.where("asks").mapInArrow(ask, f"query_id long, query {kind}, bound double, lists array<int>"),
        "asked",
    )
    # Pieces of lists meet pieces of their queries, so a list of any size spreads.
    pieces = {i: max(1, -(-int(n) // _VECTORS_AT_ONCE)) for i, n in enumerate(index.sizes)}
    probes = asked.select("query_id", "query", "bound", F.explode("lists").alias("list"))
    asking = dict(probes.groupBy("list").count().collect())
    groups = {i: max(1, -(-asking.get(i, 0) // _QUERIES_AT_ONCE)) for i in pieces}
    of = lambda counts: F.element_at(F.array(*[F.lit(counts[i]) for i in sorted(counts)]), F.col("list") + 1)
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = listed.select(
        "vec_id",
        "vector",
        "list",
        F.pmod(F.xxhash64("vec_id", "vector"), of(pieces)).cast("int").alias("piece"),
        every(of(groups)).alias("group"),
    )
    right = probes.select(
        "query_id",
        "query",
        "bound",
        "list",
        F.pmod(F.xxhash64("query_id"), of(groups)).cast("int").alias("group"),
        every(of(pieces)).alias("piece"),
    )
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def meet(vectors: pa.Table, asking: pa.Table) -> pa.Table:
        if not vectors.num_rows or not asking.num_rows:
            return pa.table({c: [] for c in schema.names}, schema=schema)
        x, q = matrix(vectors.column("vector")), matrix(asking.column("query"))
        ids, owners = vectors.column("vec_id").to_numpy(), asking.column("query_id").to_numpy()
        bound = asking.column("bound").to_numpy()
        i, j = scan(full.value, q, owners, x, ids, bound)
        score = _scores(q[i], x[j])
        take = _best(owners[i], ids[j], score)
        return pa.table([owners[i][take], ids[j][take], score[take]], schema=schema)

    keys = ["list", "piece", "group"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(
        meet, "query_id long, vec_id long, score double"
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= NEAREST)
        .select("query_id", "rank", "vec_id", "score")
    )
