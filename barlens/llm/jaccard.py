"""Links between sets of shingles by exact Jaccard similarity, from bands that collide.

Groups of buckets go to tasks, which verify every pair that is not linked yet and return a spanning forest, not all links. A bucket larger than a
group is thinned first, in rounds that compare all its sets with one of them, its centre. Jaccard distance is a metric: what is linked to the centre can be
near none of the rest but those that are near enough to the centre themselves, so most of it is done with one comparison. What is
still large after the rounds is dealt out as pairs of tiles; tiles by number of shingles whose ratio rules out the threshold are not paired.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import materialize

THRESHOLD = 0.8
#: Rows of a group of buckets on average, and those from which a bucket is large.
GROUP_ROWS = 1024
ROUNDS = 6
#: Centres' shingles are broadcast up to so many bytes, else joined.
MAX_BROADCAST_BYTES = 16 << 20


def verified_forest(ids: np.ndarray, sets: list[frozenset[int]], bucket: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest over all pairs within a bucket with at least that Jaccard similarity."""
    labels = np.arange(len(ids))
    size = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
    order = np.lexsort((size, bucket))
    ends = np.searchsorted(bucket[order], bucket[order], side="right")
    for x, i in enumerate(order.tolist()):
        rest = order[x + 1 : ends[x]]
        rest = rest[(labels[rest] != labels[i]) & (size[rest] * threshold <= size[i])]
        for j in rest.tolist():
            if labels[j] != labels[i]:
                common = len(sets[i] & sets[j])
                if common >= threshold * (len(sets[i]) + len(sets[j]) - common):
                    labels[labels == max(labels[i], labels[j])] = min(labels[i], labels[j])
    moved = labels != np.arange(len(ids))
    return ids[moved], ids[labels[moved]]


@F.pandas_udf(T.StructType([T.StructField("common", T.LongType()), T.StructField("whole", T.LongType())]))
def overlap(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """Sizes of the intersection and the union of two sets of 32-bit shingles, each kept in order without repeats."""
    out = []
    for x, y in zip(a, b, strict=True):
        x, y = np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4")
        common = len(np.intersect1d(x, y, assume_unique=True))
        out.append((common, len(x) + len(y) - common))
    return pd.DataFrame(out, columns=["common", "whole"])


def thinned(colliding: DataFrame, sets: DataFrame, threshold: float, large: int, rounds: int = ROUNDS) -> tuple[list[DataFrame], DataFrame]:
    """Links (u, v) found in rounds, and the rows (id, bucket) of ``colliding`` that are still to be compared.

    A linked set leaves its bucket unless some set that is not linked could be near it: that is so only where the two differences from the centre are
    no further apart than the threshold allows."""
    reach, links = 1 - threshold, []
    for _ in range(rounds):
        hot = materialize(colliding.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("centre")).where(F.col("n") > large).drop("n"), "hot-buckets")
        if not hot.take(1):
            break
        centres = hot.select("centre").distinct().join(sets, F.col("centre") == F.col("id")).select("centre", F.col("shingles").alias("own"))
        if (centres.agg(F.sum(F.length("own"))).first()[0] or 0) <= MAX_BROADCAST_BYTES:
            centres = F.broadcast(centres)
        rows = colliding.join(hot, "bucket").join(sets, "id").join(centres, "centre")
        o = overlap("own", "shingles")
        judged = materialize(rows.select("bucket", "id", "centre", o.alias("o")).select("bucket", "id", "centre", (F.col("o.common") >= threshold * F.col("o.whole")).alias("linked"), (1 - F.col("o.common") / F.col("o.whole")).alias("d")), "judged")
        links.append(judged.where("linked AND id <> centre").select(F.col("id").alias("u"), F.col("centre").alias("v")))
        nearest = judged.where("NOT linked").groupBy("bucket").agg(F.min("d").alias("nearest"))
        rest = judged.join(nearest, "bucket").where((F.col("id") != F.col("centre")) & (~F.col("linked") | (F.col("d") >= F.col("nearest") - reach - 1e-9)))
        colliding = materialize(colliding.join(hot.select("bucket"), "bucket", "left_anti").select("id", "bucket").unionByName(rest.select("id", "bucket")), "thinned")
    return links, colliding


def near_links(found: DataFrame, threshold: float = THRESHOLD, group_rows: int = GROUP_ROWS, bucket_rows: int = GROUP_ROWS, rounds: int = ROUNDS, more: DataFrame | None = None) -> DataFrame:
    """(u, v) ids: links with the components of all pairs of the distinct sets of ``found`` (id long, bands, shingles of 4 bytes) that are that similar and collide
    in a band or in a bucket of ``more`` (id, bucket)."""
    keys = found.select("id", F.explode("bands").alias("bucket"))
    if more is not None:
        keys = keys.unionByName(more)
    own = F.hash("id")
    shared = materialize(keys.groupBy("bucket").agg(F.min(own).alias("a"), F.max(own).alias("b")).where("a <> b").select("bucket"), "shared-buckets")
    colliding = materialize(keys.join(shared, "bucket").distinct().select("id", "bucket"), "colliding")
    # Written first, so that the joins with them are planned by their true sizes.
    wanted = materialize(colliding.select("id").distinct(), "colliding-ids")
    sets = materialize(found.select("id", "shingles").join(wanted, "id", "left_semi").groupBy("id").agg(F.first("shingles").alias("shingles")), "shingles")
    links, colliding = thinned(colliding, sets, threshold, bucket_rows, rounds)
    n = colliding.count()
    hot = materialize(colliding.groupBy("bucket").agg(F.count(F.lit(1)).alias("count")).where(F.col("count") > bucket_rows), "hot-buckets")
    # Classes of size: sets that reach the threshold are at most one class apart.
    kind = F.floor(F.log(F.length("shingles") / 4) / math.log(1 / threshold)).cast("int")
    parts = F.ceil(F.col("count") / bucket_rows).cast("int")
    part = F.pmod(F.xxhash64("id"), parts).cast("int")
    tile = lambda c, p: c * F.lit(1 << 20) + p
    mine = tile(kind, part)
    others = F.flatten(F.transform(F.array(kind - 1, kind, kind + 1), lambda c: F.transform(F.sequence(F.lit(0), parts - 1), lambda p: tile(c, p))))
    pairs = F.transform(others, lambda o: F.concat_ws("-", F.least(o, mine), F.greatest(o, mine)))
    groups = max(1, -(-n // group_rows))
    together = F.array(F.pmod(F.xxhash64("bucket"), F.lit(groups)).cast("string"))
    spread = F.transform(pairs, lambda p: F.concat_ws("/", "bucket", p))
    dealt = colliding.join(hot, "bucket", "left").join(sets, "id").select("id", "shingles", "bucket", F.explode(F.when(F.col("count").isNull(), together).otherwise(spread)).alias("g"))

    def verify(rows: pd.DataFrame) -> pd.DataFrame:
        sets = [frozenset(np.frombuffer(s, dtype="<u4").tolist()) for s in rows["shingles"]]
        u, v = verified_forest(rows["id"].to_numpy(), sets, rows["bucket"].to_numpy(), threshold)
        return pd.DataFrame({"u": u, "v": v})

    out = dealt.groupBy("g").applyInPandas(verify, "u long, v long")
    for some in links:
        out = out.unionByName(some)
    return out
