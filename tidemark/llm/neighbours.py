"""Nearest neighbours by collision counting over single projections.

Vectors are dealt into blocks by a hash.  A block keeps, for each of M random projections, its vectors
sorted by their projection.  A query opens on every projection a window centred on its own projection and
widens all windows together (virtual rehashing: the radius grows by a factor, the windows are the projections
within the radius).  A vector whose projections lie in enough of the windows is verified: its exact distance
is computed in double precision.  A vector at the radius collides on 68.3 % of the projections on average;
``SHARE`` lies ``MARGIN`` deviations of that number below, so that it is found with a chance of nine in ten or more
and farther ones seldom are.  A query is done with a block when its k-th verified distance is within
the radius (the radius never grows past that distance), or when every vector is verified.  The best of all
blocks are merged.

Equal vectors are searched once: of each distinct vector the k + 1 smallest ids are candidates, which is exact
since ties go to the smaller id, and equal queries share their search.  So a vector that a third of all rows have costs
no more than others.  Queries come in blocks as well; a task holds a block of each.

Vectors that are null, zero, or hold null or non-finite components take no part.  Vectors of different dimensions
never meet: each searches within its own.  Repeated rows of one id count once; an id with several vectors is as
near as its nearest, as query and as candidate.  A query's own id is no candidate.  Null ids take no part.
Ties go to the smaller id.  Very long vectors are read whole.  No queries or no candidates: an empty result.
Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm import common

PROJECTIONS, INSIDE, MARGIN, GROWTH = 128, 0.6827, 1.5, 1.1
SHARE = INSIDE - MARGIN * (INSIDE * (1 - INSIDE) / PROJECTIONS) ** 0.5
DATA_BLOCK, QUERY_BLOCK = 16_384, 16_384


def usable(vectors: DataFrame, ident: str, vector: str) -> DataFrame:
    """(id, v, d, h, g): the vectors that take part, in double precision, with their dimension and a 128-bit hash."""
    ok = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    good = vectors.select(F.col(ident).alias("id"), F.col(vector).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull()).where(ok)
    return good.select(F.col("id").cast("long").alias("id"), "v", F.size("v").alias("d"), F.xxhash64("v").alias("h"), F.xxhash64(F.lit(1), "v").alias("g"))


class Index:
    """The sorted projections of one block of vectors, end to end in one array."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, seed: int = 5) -> None:
        self.x, self.ids = x, ids
        self.repeated = len(np.unique(ids)) < len(ids)
        self.a = np.random.default_rng(seed).normal(size=(x.shape[1], PROJECTIONS))
        h = (x @ self.a).T
        order = np.argsort(h, axis=1)
        self.order = order.ravel()
        line = np.take_along_axis(h, order, axis=1)
        self.low, self.high = line[:, 0].min(), line[:, -1].max()
        self.step = 4 * (self.high - self.low + 1.0)  # the lines of two projections don't touch
        self.line = (line + self.step * np.arange(PROJECTIONS)[:, None]).ravel()
        self.first = np.arange(PROJECTIONS) * len(x)
        self.start = {}
        self.need = int(np.ceil(SHARE * PROJECTIONS))

    def radius(self, k: int) -> float:
        """Where queries begin: a little under what the k nearest of most vectors of the block lie within, by 32 of them."""
        if k not in self.start:
            some = self.x[np.linspace(0, len(self.x) - 1, min(len(self.x), 32)).astype(int)]
            far = [float(np.partition(np.sqrt(((self.x - q) ** 2).sum(axis=1)), min(k, len(self.x)) - 1)[min(k, len(self.x)) - 1]) for q in some]
            self.start[k] = max(0.95 * float(np.quantile(far, 0.2)), 1e-12)
        return self.start[k]

    def nearest(self, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Places and distances of the k nearest ids found (more if they tie), and how many vectors were verified."""
        n, shift = len(self.x), self.step * np.arange(PROJECTIONS)
        hq = q @ self.a
        hits, seen = np.zeros(n, np.int64), np.zeros(n, bool)
        here, far = np.zeros(0, np.int64), np.zeros(0)
        lo = hi = np.searchsorted(self.line, np.clip(hq, self.low, self.high) + shift)
        radius = self.radius(k)
        while True:
            left = np.maximum(np.searchsorted(self.line, np.maximum(hq - radius, self.low) + shift, side="left"), self.first)
            right = np.minimum(np.searchsorted(self.line, np.minimum(hq + radius, self.high) + shift, side="right"), self.first + n)
            left, right = np.minimum(left, lo), np.maximum(right, hi)
            fresh = [self.order[a:b] for a, b in zip(left.tolist(), lo.tolist()) if b > a] + [self.order[a:b] for a, b in zip(hi.tolist(), right.tolist()) if b > a]
            lo, hi = left, right
            if fresh:
                hits += np.bincount(np.concatenate(fresh), minlength=n)
                new = np.flatnonzero((hits >= self.need) & ~seen)
                seen[new] = True
                here, far = np.append(here, new), np.append(far, np.sqrt(((self.x[new] - q) ** 2).sum(axis=1)))
            once = self.once(here, far)
            bound = np.partition(far[once], k - 1)[k - 1] if len(once) >= k else np.inf
            if bound <= radius or len(here) == n:
                break
            radius = min(radius * GROWTH, bound)
        best = once[far[once] <= bound]
        return here[best], far[best], len(here)

    def once(self, here: np.ndarray, far: np.ndarray) -> np.ndarray:
        """Where each id has its nearest vector."""
        if not self.repeated:
            return np.arange(len(here))
        order = np.argsort(far, kind="stable")
        return order[np.unique(self.ids[here[order]], return_index=True)[1]]


def nearest(vectors: DataFrame, is_query: Column, k: int, ident: str = "vec_id", vector: str = "embedding", data_block: int = DATA_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score) for every usable row that ``is_query`` (of the column id) holds for."""
    rows = common.cut(usable(vectors, ident, vector))
    same = W.partitionBy("d", "h", "g").orderBy("id")
    least = rows.dropDuplicates(["id", "h", "g"]).withColumn("place", F.row_number().over(same)).where(F.col("place") <= k + 1)
    points = common.cut(least.select("id", "d", "h", "g", "v", "place"))
    asking = common.cut(rows.where(is_query).select("id", "d", "h", "g").distinct())
    asked = asking.select("d", "h", "g").distinct().join(points.where("place = 1").select("d", "h", "g", "v"), ["d", "h", "g"])
    blocks = max(1, -(-points.count() // data_block))
    parts = max(1, -(-asking.count() // query_block))
    deal = lambda n: F.pmod(F.col("g"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    data = points.select("d", deal(blocks).alias("block"), every(parts).alias("part"), F.lit(False).alias("asks"), "h", "g", "v", "id")
    asks = asked.select("d", every(blocks).alias("block"), deal(parts).alias("part"), F.lit(True).alias("asks"), "h", "g", "v", F.lit(0).cast("long").alias("id"))
    schema = "h long, g long, d int, score double, vec_id long"

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        asks = group["asks"].to_numpy()
        ask, have = np.flatnonzero(asks), np.flatnonzero(~asks)
        v = group["v"].combine_chunks().flatten().to_numpy().reshape(len(asks), -1)
        who, score, at = [], [], []
        if len(ask) and len(have):
            index = Index(v[have], group["id"].to_numpy()[have])
            for i in ask:
                places, far, _ = index.nearest(v[i], k + 1)
                who.append(np.full(len(places), i))
                score.append(far)
                at.append(have[places])
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        who, score, at = join(who, np.int64), join(score, float), join(at, np.int64)
        take = lambda c, i: group[c].combine_chunks().take(pa.array(i))
        return pa.table({"h": take("h", who), "g": take("g", who), "d": take("d", who), "score": pa.array(score), "vec_id": take("id", at)})

    near = data.unionByName(asks).groupBy("d", "block", "part").applyInArrow(run, schema)
    near = near.groupBy("d", "h", "g", "vec_id").agg(F.min("score").alias("score"))
    place = F.row_number().over(W.partitionBy("d", "h", "g").orderBy("score", "vec_id"))
    near = near.withColumn("place", place).where(F.col("place") <= k + 1)
    out = asking.withColumnRenamed("id", "query_id").join(near, ["d", "h", "g"]).where("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(common.table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("id") % 100 == 0, 10)
