"""Approximate nearest neighbours: inverted lists, and within each probed list an adaptive scan of dimensions.

Lists come from k-means on a bounded sample; every vector is put in its nearest list. How many lists a query probes is
calibrated: for a bounded sample of queries the exact neighbours are found among all rows, and the number is the least that
would have reached ``recall``. Within a list, vectors are turned by a random rotation and scanned in blocks of columns:
after each block a hypothesis test on the partial distance, scaled to all dimensions, abandons candidates that are
unlikely to be within the current radius (Gao and Long, 2023). What survives gets its exact distance in double precision.

Lists with many vectors or queries are dealt out as a grid of parts, so no task holds a whole hot list. The driver holds
the sample, the centroids and counts by list.

A query that finds fewer than it asks for in the lists it probes is asked again of all lists without a radius, which is exact.

Defined cases: vectors that are null, zero, of another length than most, or hold null or non-finite components take no part, nor do rows
without an id; of its candidates a query leaves out its own row alone, so with a repeated id each row is a query of its own, with ranks
of its own, and a candidate of the others; equal distances are ordered by id; fewer candidates than asked for are all
returned; an empty table gives an empty result; other columns of the input are not returned.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import materialize, read_table

#: Bounds of what the driver takes: vectors to fit the lists, queries to calibrate. There are as many lists as the root of the rows, up to a
#: fourth of the vectors that fit them.
MAX_FIT_ROWS, MAX_CALIBRATION_QUERIES = 8192, 64
PART_ROWS = 8192


def valid_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, vector, row) of the rows that take part; row: a number of its own for each, kept in shared storage."""
    v = F.col("vector").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector")).where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull())
    rows = rows.where(finite & F.exists(v, lambda x: x != 0)).withColumn("vector", v)
    most = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    rows = rows.where(F.size("vector") == (most["d"] if most else 0))
    return materialize(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")


@dataclass
class Index:
    """Centroids and rotation, and part of the fitted sample for first radii."""

    centroids: np.ndarray
    rotation: np.ndarray
    sample_rows: np.ndarray
    sample: np.ndarray

    def order(self, x: np.ndarray) -> np.ndarray:
        """Lists by distance for each row."""
        return np.argsort(self._to_centroids(x), axis=1, kind="stable")

    def nearest(self, x: np.ndarray) -> np.ndarray:
        return self._to_centroids(x).argmin(axis=1)

    def _to_centroids(self, x: np.ndarray) -> np.ndarray:
        return (self.centroids**2).sum(axis=1)[None, :] - 2 * x @ self.centroids.T

    def radius(self, own: np.ndarray, x: np.ndarray, lists: np.ndarray, k: int) -> np.ndarray:
        """A distance within which each query has k vectors in its lists, and a few more: from the sample in those lists."""
        k += k // 2
        d = (x**2).sum(axis=1)[:, None] - 2 * x @ self.sample.T + (self.sample**2).sum(axis=1)[None, :]
        probed = np.zeros((len(x), len(self.centroids)), dtype=bool)
        np.put_along_axis(probed, lists, True, axis=1)
        d[(own[:, None] == self.sample_rows[None, :]) | ~probed[:, self.nearest(self.sample)]] = np.inf
        if d.shape[1] < k:
            return np.full(len(x), np.inf)
        return np.sqrt(np.maximum(np.partition(d, k - 1, axis=1)[:, k - 1], 0)) * (1 + 1e-6) + 1e-6


def fit(vectors: DataFrame, n_lists: int | None = None, max_rows: int = MAX_FIT_ROWS, rounds: int = 8, seed: int = 11) -> Index | None:
    """Lists from k-means on the ``max_rows`` vectors of least hashed id."""
    n = vectors.count()
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max_rows).toPandas()
    if not len(rows):
        return None
    x = np.stack(rows["vector"].to_numpy())
    rng = np.random.default_rng(seed)
    apart = np.unique(x, axis=0)
    k = min(len(apart), n_lists or int(np.clip(np.sqrt(n), 1, max_rows // 4)))
    centroids = apart[rng.choice(len(apart), k, replace=False)]
    for _ in range(rounds):
        near = ((centroids**2).sum(axis=1)[None, :] - 2 * apart @ centroids.T).argmin(axis=1)
        total, size = np.zeros_like(centroids), np.bincount(near, minlength=k)
        np.add.at(total, near, apart)
        centroids = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], centroids)
    rotation, _ = np.linalg.qr(rng.standard_normal((x.shape[1], x.shape[1])))
    return Index(centroids, rotation, rows["row"].to_numpy()[:4096], x[:4096])


def _top(ids: np.ndarray, distances: np.ndarray, k: int) -> np.ndarray:
    """Places of the k nearest, ties to the smaller id."""
    if len(ids) > 4 * k:
        near = np.flatnonzero(distances <= np.partition(distances, k - 1)[k - 1])
        return near[np.lexsort((ids[near], distances[near]))[:k]]
    return np.lexsort((ids, distances))[:k]


def exact_distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - q) ** 2).sum(axis=1))


def adaptive_scan(ids: np.ndarray, rows: np.ndarray, x: np.ndarray, turned: np.ndarray, own: int, q: np.ndarray, q_turned: np.ndarray, radius: float, k: int, step: int = 16, epsilon: float = 2.1) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest of a list's vectors ``x`` (``turned``: rotated) within ``radius``: ids and exact distances."""
    dims = x.shape[1]
    best_ids, best = np.empty(0, dtype=np.int64), np.empty(0)
    chunk = 1024
    for at in range(0, len(ids), chunk):
        alive = np.arange(at, min(at + chunk, len(ids)))
        alive = alive[rows[alive] != own]
        partial = np.zeros(len(alive))
        for d in range(0, dims, step):
            if not len(alive):
                break
            block = turned[alive, d : d + step] - q_turned[d : d + step]
            partial = partial + np.einsum("ij,ij->i", block, block)
            seen = min(d + step, dims)
            # The partial distance, scaled to all dimensions, must not exceed the radius beyond what chance allows.
            slack = (1 + epsilon / np.sqrt(seen)) ** 2 if seen < dims else 1.0
            stays = partial * (dims / seen) <= slack * radius * radius * (1 + 1e-9) + 1e-12
            alive, partial = alive[stays], partial[stays]
        if len(alive):
            all_ids, all_d = np.append(best_ids, ids[alive]), np.append(best, exact_distances(x[alive], q))
            kept = _top(all_ids, all_d, k)
            best_ids, best = all_ids[kept], all_d[kept]
            if len(best) == k:
                radius = min(radius, best[-1])
    return best_ids, best


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()) if len(column) else np.empty((0, 0))


def exact_neighbours(vectors: DataFrame, own_rows: np.ndarray, queries: np.ndarray, k: int) -> DataFrame:
    """(query_row, vec_id, score, vector): the exact k nearest of a bounded set of queries among all rows, scanned in blocks."""

    def scan(batches):
        for batch in batches:
            x, ids, rows = _stack(batch["vector"]), batch["vec_id"].to_numpy(), batch["row"].to_numpy()
            for i, q in zip(own_rows.tolist(), queries, strict=True):
                d = exact_distances(x, q)
                d[rows == i] = np.inf
                kept = _top(ids, d, k)
                kept = kept[np.isfinite(d[kept])]
                yield pd.DataFrame({"query_row": i, "vec_id": ids[kept], "score": d[kept], "vector": list(x[kept])})

    found = vectors.mapInPandas(scan, "query_row long, vec_id long, score double, vector array<double>")
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def calibrated_probes(index: Index, vectors: DataFrame, queries: DataFrame, k: int, recall: float, max_queries: int = MAX_CALIBRATION_QUERIES) -> int:
    """The least number of lists that holds the share ``recall`` of the sampled queries' exact neighbours."""
    sample = queries.orderBy(F.xxhash64("vec_id", F.lit(1)), "vec_id").limit(max_queries).toPandas()
    if not len(sample):
        return 1
    x, own = _stack(sample["vector"]), sample["row"].to_numpy()
    rows = exact_neighbours(vectors, own, x, k).select("query_row", "vector").toPandas()
    if not len(rows):
        return 1
    place = dict(zip(own.tolist(), np.argsort(index.order(x), axis=1, kind="stable"), strict=True))
    needed = np.sort([place[q][c] for q, c in zip(rows["query_row"], index.nearest(_stack(rows["vector"])), strict=True)])
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]) + 1


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, recall: float = 0.98, part_rows: int = PART_ROWS, probes: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score) for ``queries`` among ``vectors`` (both as of :func:`valid_vectors`; a query that is a row of
    ``vectors`` has its row number). ``probes``: lists that a query probes, by default calibrated to ``recall``."""
    spark = vectors.sparkSession
    index = fit(vectors)
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    n_lists = len(index.centroids)
    probes = probes or calibrated_probes(index, vectors, queries, k, recall)

    def assign(batches):
        for batch in batches:
            yield batch.assign(list=index.nearest(_stack(batch["vector"])) if len(batch) else [])

    placed = materialize(vectors.select("vec_id", "vector", "row").mapInPandas(assign, "vec_id long, vector array<double>, row long, list int"), "placed")
    # Counts by list: at most as many as there are centroids.
    sizes = {r["list"]: r["count"] for r in placed.groupBy("list").count().collect()}
    found = materialize(probed(placed, queries, index, sizes, k, probes, part_rows), "neighbours")
    if probes < n_lists:
        found_by = found.groupBy("query_row").agg(F.count(F.lit(1)).alias("found"))
        short = materialize(queries.join(found_by, queries["row"] == found_by["query_row"], "left").where(F.coalesce("found", F.lit(0)) < k).select("vec_id", "vector", "row"), "short-queries")
        if short.take(1):
            again = probed(placed, short, index, sizes, k, n_lists, part_rows)
            found = found.join(short.select(F.col("row").alias("query_row")), "query_row", "left_anti").unionByName(again)
    return found.select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def probed(placed: DataFrame, queries: DataFrame, index: Index, sizes: dict[int, int], k: int, probes: int, part_rows: int) -> DataFrame:
    """(query_row, query_id, rank, vec_id, score): the nearest that each query finds in its ``probes`` nearest lists; exact if these are all."""
    every = probes >= len(index.centroids)

    def route(batches):
        for batch in batches:
            if len(batch):
                x = _stack(batch["vector"])
                lists = index.order(x)[:, :probes]
                yield batch.assign(radius=np.inf if every else index.radius(batch["row"].to_numpy(), x, lists, k), lists=list(lists))

    schema = "vec_id long, vector array<double>, row long, radius double, lists array<int>"
    routed = materialize(queries.select("vec_id", "vector", "row").mapInPandas(route, schema).select("vec_id", "vector", "row", "radius", F.explode("lists").alias("list")), "routed")
    asked = {r["list"]: r["count"] for r in routed.groupBy("list").count().collect()}
    parts = {c: (-(-sizes.get(c, 1) // part_rows), -(-asked.get(c, 1) // part_rows)) for c in range(len(index.centroids))}
    grid = F.create_map(*[x for c, (a, b) in parts.items() for x in (F.lit(c), F.struct(F.lit(a).alias("c"), F.lit(b).alias("q")))])[F.col("list")]
    hashed = lambda n: F.pmod(F.xxhash64("row"), n).cast("int")
    cell = lambda c, q: F.concat_ws("-", "list", c, q)
    left = placed.where(F.col("list").isin([c for c in asked])).select("vec_id", "vector", "row", F.explode(F.transform(F.sequence(F.lit(0), grid["q"] - 1), lambda q: cell(hashed(grid["c"]), q))).alias("cell"))
    right = routed.select("vec_id", "vector", "row", "radius", F.explode(F.transform(F.sequence(F.lit(0), grid["c"] - 1), lambda c: cell(c, hashed(grid["q"])))).alias("cell"))

    def scan(candidates: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        if not len(candidates) or not len(asking):
            return pd.DataFrame({c: pd.Series(dtype="int64" if c != "score" else "float64") for c in ("query_row", "query_id", "vec_id", "score")})
        ids, rows, x, q = candidates["vec_id"].to_numpy(), candidates["row"].to_numpy(), _stack(candidates["vector"]), _stack(asking["vector"])
        turned, q_turned = x @ index.rotation, q @ index.rotation
        asked_rows, asked_ids, radii = asking["row"].tolist(), asking["vec_id"].to_numpy(), asking["radius"].tolist()
        found = [adaptive_scan(ids, rows, x, turned, own, q[j], q_turned[j], radii[j], k) for j, own in enumerate(asked_rows)]
        n = [len(f[0]) for f in found]
        return pd.DataFrame({"query_row": np.repeat(asked_rows, n), "query_id": np.repeat(asked_ids, n), "vec_id": np.concatenate([f[0] for f in found]), "score": np.concatenate([f[1] for f in found])})

    found = left.groupBy("cell").cogroup(right.groupBy("cell")).applyInPandas(scan, "query_row long, query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = valid_vectors(read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding"]))
    return search(vectors, vectors.where(F.col("vec_id") % 100 == 0))
