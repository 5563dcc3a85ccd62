"""Approximate nearest neighbours: inverted lists and an adaptive scan of dimensions.

Lists come from spherical k-means on a bounded sample; every row is put in the list of its
nearest center. How many lists a query probes is fitted too: as many as find `aim` of the
sample's true neighbours. Inside a list, unit vectors are turned by one random rotation and
kept in blocks of columns. A candidate's squared distance over the first d of D dimensions
estimates its whole distance by the factor D / d; a hypothesis test abandons it as soon as
that estimate, less an error of EPSILON / sqrt(d), exceeds the query's k-th best so far.
Survivors' cosines are computed in double precision, on the vectors divided by their largest
component: that is exact in direction, and neither very small nor very large components are
lost. The k best so far are those by (cosine, smaller id), so ties don't depend on order.

Vectors of equal direction (equal after that division) are searched and stored once: only
the smallest ids of each can be among the nearest, as ties go to the smaller id. Lists are
cut into blocks of bounded size, and so are a list's queries, so that no task holds a whole
list; a hot list is just more blocks.

Defined results: vectors that are null, zero, of another length than most, or that hold
null or non-finite components take no part, neither do rows without id; rows that repeat
an id with the same vector count once, with another vector each on its own, and none of
them is a candidate for a query of that id; fewer than k candidates give fewer rows; a
query whose probed lists hold too few candidates is searched over all lists; columns
besides the two named are not read; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.common import written
from marlstone.shipping import ship

NEAREST = 5
SAMPLE = 20_000
AIM = 0.97
TRIED = 300
MOST_LISTS = 4096
BLOCK = 16_384
QUERY_BLOCK = 2048
COLUMNS = 16
EPSILON = 2.1
FOUND = "qid long, ids array<long>, score double"


def units(x: np.ndarray) -> np.ndarray:
    """Unit vectors, from vectors whose largest component is 1 or -1."""
    return (x / np.sqrt((x * x).sum(axis=1, keepdims=True))).astype(np.float32)


class Index:
    """Centers, rotation and the number of lists to probe."""

    def __init__(self, sample: np.ndarray, lists: int, k: int, aim: float = AIM, seed: int = 11):
        rng, x = np.random.default_rng(seed), units(sample)
        dim = x.shape[1]
        self.rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0].astype(np.float32)
        self.lists = max(1, min(lists, len(x) // 8))
        centers = x[rng.choice(len(x), self.lists, replace=False)]
        for _ in range(12):
            own = self.nearest(x, centers)
            sums = np.zeros((self.lists, dim))
            np.add.at(sums, own, x)
            norm = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
            centers = np.where(norm > 1e-9, sums / np.maximum(norm, 1e-9), centers).astype(np.float32)
        self.centers = centers
        self.probes = self._fit(x, k, aim, rng)

    @staticmethod
    def nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
        return np.concatenate([np.argmax(x[i : i + 8192] @ centers.T, axis=1) for i in range(0, len(x), 8192)]) if len(x) else np.zeros(0, np.int64)

    def _fit(self, x: np.ndarray, k: int, aim: float, rng) -> int:
        q = rng.choice(len(x), min(TRIED, len(x)), replace=False)
        own = self.nearest(x, self.centers)
        similar = x[q] @ x.T
        similar[np.arange(len(q)), q] = -2
        k = min(k, len(x) - 1)
        if k < 1:
            return self.lists
        best = np.argpartition(-similar, k - 1, axis=1)[:, :k]
        place = np.argsort(np.argsort(-(x[q] @ self.centers.T), axis=1), axis=1)
        needed = np.sort(place[np.arange(len(q))[:, None], own[best]].ravel())
        return int(needed[min(len(needed) - 1, math.ceil(aim * len(needed)))]) + 1

    def probed(self, x: np.ndarray, probes: int) -> np.ndarray:
        return np.argsort(-(x @ self.centers.T), axis=1, kind="stable")[:, :probes]


#: By how much a squared distance in single precision may be off.
ROUNDING = 1e-5


def scan(candidates: np.ndarray, query: np.ndarray, k: int, cosine: Callable[[np.ndarray], np.ndarray], ids: np.ndarray, chunk: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Places and cosines of about the k nearest candidates to a rotated query. candidates: (blocks, rows, COLUMNS); cosine gives it for places; ids decide ties."""
    blocks, rows, width = candidates.shape
    dim = blocks * width
    parts = query.reshape(blocks, width)
    limit, best, at = np.inf, np.zeros(0), np.zeros(0, np.int64)
    begin = 0
    while begin < rows:
        end = min(rows, begin + (chunk if begin else 4 * k))
        alive, partial = np.arange(begin, end), np.zeros(end - begin, np.float32)
        for b in range(blocks):
            gap = candidates[b, alive] - parts[b] if len(alive) < end - begin else candidates[b, begin:end] - parts[b]
            partial = partial + np.einsum("ij,ij->i", gap, gap)
            if np.isfinite(limit):
                seen = (b + 1) * width
                bound = limit if seen == dim else limit * (seen / dim) * (1 + EPSILON / math.sqrt(seen)) ** 2
                keep = partial <= bound
                alive, partial = alive[keep], partial[keep]
            if not len(alive):
                break
        if len(alive):
            best, at = np.concatenate([best, cosine(alive)]), np.concatenate([at, alive])
            first = np.lexsort((ids[at], -best))[:k]
            best, at = best[first], at[first]
            if len(best) == k:
                limit = max(0.0, 2 - 2 * float(best[-1])) + ROUNDING
        begin = end
    return at, best


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy().reshape(len(flat), -1)


def _search(index: Index, k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    dim = len(index.rotation)
    width = COLUMNS if dim % COLUMNS == 0 else dim

    def blocked(x: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray((units(x) @ index.rotation).reshape(len(x), dim // width, width).transpose(1, 0, 2))

    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if queries.num_rows and rows.num_rows:
            original = _matrix(rows["vector"])
            norm, kept, ids = np.sqrt((original * original).sum(axis=1)), blocked(original), rows["ids"].to_pylist()
            first = np.fromiter((i[0] for i in ids), np.int64, len(ids))
            asked = _matrix(queries["vector"])
            turned = units(asked) @ index.rotation
            for qid, q, r in zip(queries["qid"].to_pylist(), asked, turned, strict=True):
                own = math.sqrt(float((q * q).sum()))
                cosine = lambda at: (original[at] * q).sum(axis=1) / (norm[at] * own)  # noqa: E731, B023
                out += [(qid, ids[i], s) for i, s in zip(*(x.tolist() for x in scan(kept, r, k, cosine, first)), strict=True)]
        return pa.table([pa.array([r[n] for r in out], t) for n, t in enumerate((pa.int64(), pa.list_(pa.int64()), pa.float64()))], ["qid", "ids", "score"])

    return run


def _placed(index: Index, probes: int):
    """Adds list: a row for each probed list."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = units(_matrix(pa.chunked_array([batch["vector"]])))
                lists = index.probed(x, probes) if probes > 1 else Index.nearest(x, index.centers)[:, None]
                where = np.repeat(np.arange(len(x)), lists.shape[1])
                yield pa.RecordBatch.from_arrays([*[c.take(pa.array(where)) for c in batch.columns], pa.array(lists.ravel().astype(np.int64))], [*batch.schema.names, "list"])

    return run


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(vec_id, vector): the rows that take part, their vectors divided by the largest component's size."""
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("vector")).where("vec_id is not null and vector is not null")
    largest = F.greatest(F.array_max("vector"), -F.array_min("vector"))  # NaN is the largest of all
    rows = rows.where((largest > 0) & (largest < float("inf")) & F.forall("vector", lambda v: v.isNotNull()))
    rows = rows.select("vec_id", "vector", largest.alias("largest")).select("vec_id", F.transform("vector", lambda v: v / F.col("largest") + F.lit(0.0)).alias("vector"))
    size = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.col("count").desc(), "n").first()
    return rows.where(F.size("vector") == (size["n"] if size else 0))


def _found(index: Index, queries: DataFrame, rows: DataFrame, probes: int, k: int) -> DataFrame:
    """(qid, ids, score) of the blocks' nearest rows for queries (qid, vector)."""
    stored = rows.mapInArrow(_placed(index, 1), "cid long, ids array<long>, vector array<double>, list long")
    stored = written(stored, "stored")
    asked = written(queries.mapInArrow(_placed(index, probes), "qid long, vector array<double>, list long"), "asked")
    blocks = lambda df, size, name: df.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / size).alias(name))  # noqa: E731  at most MOST_LISTS rows
    sizes = F.broadcast(written(blocks(stored, BLOCK, "cb").join(blocks(asked, QUERY_BLOCK, "qb"), "list"), "sizes"))
    salt = lambda c, n: F.pmod(F.xxhash64(c), F.col(n))
    one_of_c, one_of_q = salt("cid", "cb").alias("c"), salt("qid", "qb").alias("q")
    all_c, all_q = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("cb") - 1)).alias("c"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("qb") - 1)).alias("q")
    left = asked.join(sizes, "list").select("list", "qid", "vector", one_of_q, all_c)
    right = stored.join(sizes, "list").select("list", "ids", "vector", one_of_c, all_q)
    return left.groupBy("list", "c", "q").cogroup(right.groupBy("list", "c", "q")).applyInArrow(_search(index, k), FOUND)


def nearest_neighbours(
    vectors: DataFrame, is_query: Column, *, id_column: str = "vec_id", vector_column: str = "embedding", k: int = NEAREST, aim: float = AIM, sample: int = SAMPLE
) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows for which is_query (an expression of vec_id) holds."""
    ship(vectors.sparkSession)
    rows = written(usable(vectors, id_column, vector_column), "vectors")
    by_vector = Window.partitionBy("vector").orderBy("vec_id")
    few = rows.withColumn("n", F.dense_rank().over(by_vector)).where(F.col("n") <= k + 1)
    classes = written(few.groupBy("vector").agg(F.array_sort(F.collect_set("vec_id")).alias("ids")).select(F.element_at("ids", 1).alias("cid"), "ids", "vector"), "classes")
    drawn = classes.orderBy(F.xxhash64("vector"), "cid").limit(sample).select("cid", "vector").collect()  # at most `sample` vectors
    n = classes.count()
    queries = rows.where(is_query).distinct()
    asked = written(queries.join(classes.select(F.col("cid").alias("qid"), F.col("vector").alias("v")), F.col("vector") == F.col("v")).select(F.col("vec_id").alias("query_id"), "qid"), "queries")
    once = asked.select("qid").distinct().join(classes.select(F.col("cid").alias("qid"), "vector"), "qid")
    schema = "query_id long, rank int, vec_id long, score double"
    if not drawn:
        return vectors.sparkSession.createDataFrame([], schema)
    index = Index(np.array([r["vector"] for r in sorted(drawn)]), min(MOST_LISTS, max(1, math.isqrt(n) // 4)), k, aim)

    def best(found: DataFrame) -> DataFrame:
        each = found.select("qid", F.explode("ids").alias("vec_id"), "score").distinct()
        in_order = Window.partitionBy("qid").orderBy(F.col("score").desc(), "vec_id")
        return written(each.withColumn("n", F.row_number().over(in_order)).where(F.col("n") <= k + 1).drop("n"), "best")

    top = best(_found(index, once, classes, index.probes, k + 1))
    if index.probes < index.lists:
        full = top.groupBy("qid").count().where(F.col("count") > k).select("qid")
        short = written(once.join(full, "qid", "left_anti"), "short")
        if not short.isEmpty():
            again = best(_found(index, short, classes, index.lists, k + 1))
            top = top.join(short.select("qid"), "qid", "left_anti").union(again.select(*top.columns))
    in_order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    pairs = asked.join(top, "qid").where("vec_id <> query_id").withColumn("rank", F.row_number().over(in_order))
    return pairs.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
