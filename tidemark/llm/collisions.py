"""Near-duplicate embeddings by counting collisions on one-dimensional projections.

Vectors are scaled to length 1 and projected on many random lines.  Two vectors at cosine c lie sqrt(2 - 2c) apart, and on every line
their projections differ by a normal variable of that deviation, on each line anew.  In a task the vectors of a block are sorted on
each of ``LINES`` lines, a window of ``WIDTH`` deviations is centred on every vector as a query, and its collisions with the others are
counted.  A pair at the least cosine collides on a binomial number of lines; the count asked for is the largest that such a pair falls
short of with a chance of ``MISS`` at most.  Pairs with that count are verified: their cosine is computed in double precision.

So that not every block meets every other, vectors first fall into cells: in each of several rounds a vector's cell is the side of the middle on which
it lies on a few further lines.  The lines of a round are as many as make cells of ``CELL`` vectors on average, and the rounds
as many as leave a pair at the least cosine apart in all of them with a chance of ``APART`` at most; both follow from the number of vectors.
A cell with many vectors, as of near copies, is dealt into blocks of ``BLOCK``, of which every two meet in a task of their own.  A pair counts in the first
round that it shares a cell in.  Tasks return for each vector the number of its links and one edge to its
component in the block, never the pairs, so that g near copies make g rows a block and not g x g.

Equal vectors are one point with a weight and link with each other.  Every row is a vector: repeated rows and ids are vectors of their own, and rows that share an
id share nothing else.  Vectors that are null, zero, or hold null or non-finite components link with nothing, like those alone: a component each.
Vectors of different dimensions never link.  component_id is the least id that isn't null, null where there is none, and then nothing is kept.
Ties cannot occur: all links of a cosine of ``least`` or more count.  Very long vectors are read whole.  An empty table gives no rows.
Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import common, neardup

LEAST, LINES, WIDTH, MISS = 0.9, 32, 2.0, 1e-4
CELL, BLOCK, APART, MOST_LINES = 1024, 2048, 1e-3, 31


def needed(lines: int = LINES, width: float = WIDTH, miss: float = MISS) -> int:
    """The largest count that a pair at the least cosine falls short of with a chance of ``miss`` at most."""
    inside, below = math.erf(width / math.sqrt(2)), 0.0
    for count in range(lines + 1):
        below += math.comb(lines, count) * inside**count * (1 - inside) ** (lines - count)
        if below > miss:
            return count
    return lines


def rounds(n: int, least: float, cell: int = CELL, apart: float = APART) -> tuple[int, int]:
    """(lines a round, rounds) for n vectors."""
    lines = min(MOST_LINES, max(0, math.ceil(math.log2(max(n, 1) / cell))))
    same = (1 - math.acos(least) / math.pi) ** lines
    return lines, 1 if lines == 0 else math.ceil(math.log(apart) / math.log1p(-same))


def gaussian(seed: int, dimension: int, lines: int) -> np.ndarray:
    return np.random.default_rng([seed, dimension]).normal(size=(dimension, lines))


def rows_of(column: pa.Array) -> np.ndarray:
    """A list column, whose rows have one length, as a matrix in double precision."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def usable(vectors: DataFrame, vector: str) -> DataFrame:
    """The rows whose vector takes part."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0)
    return vectors.where(F.col(vector).isNotNull()).where(fine)


def celled(points: DataFrame, lines: int, turns: int, seed: int) -> DataFrame:
    """``points`` with ``cells``: for each round the sides of its lines on which the vector ``v`` lies, as bits."""
    schema = T.StructType([*points.schema.fields, T.StructField("cells", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(batch.column("v").offsets.to_numpy())
            for d in np.unique(sizes):
                part = batch.take(pa.array(np.flatnonzero(sizes == d)))
                side = (unit(rows_of(part.column("v"))) @ gaussian(seed, int(d), lines * turns) > 0).reshape(part.num_rows, turns, lines)
                cells = (side.astype(np.int64) << np.arange(lines)).sum(axis=2).astype(np.int32)
                made = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1) * turns, pa.int32()), pa.array(cells.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns, made], names=schema.names)

    return points.mapInArrow(run, schema)


def collisions(queries: np.ndarray, others: np.ndarray, window: float, need: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (query, other) that collide on ``need`` lines or more; both are (lines x vectors) of projections.

    The vectors of a line are sorted, and a query's window is a run of them; the vectors of a run are a difference of two
    sets of bits, those before its ends.  Counts are kept bit by bit: one plane of the sets holds one binary digit of all counts.
    """
    n = len(others[0])
    planes: list[np.ndarray] = []
    wide = -(-n // 64) * 8
    for q, x in zip(queries, others):
        order = np.argsort(x, kind="stable")
        rank = np.empty(n, np.uint16 if n < 65536 else np.int64)
        rank[order] = np.arange(n)
        before = np.zeros((n + 1, wide), np.uint8)
        packed = np.packbits(rank[None, :] < np.arange(n + 1, dtype=rank.dtype)[:, None], axis=1)
        before[:, : packed.shape[1]] = packed
        before = before.view(np.uint64)
        line = x[order]
        carry = before[np.searchsorted(line, q - window, side="left")] ^ before[np.searchsorted(line, q + window, side="right")]
        for i, plane in enumerate(planes):
            planes[i], carry = plane ^ carry, plane & carry
        if len(planes) < len(queries).bit_length():
            planes.append(carry)
    more, same = np.zeros_like(planes[0]), np.full_like(planes[0], np.iinfo(np.uint64).max)  # count > need, count == need so far
    for i in range(len(planes) - 1, -1, -1):
        if need >> i & 1:
            same &= planes[i]
        else:
            more |= same & planes[i]
            same &= ~planes[i]
    enough = (more | same) if need >> len(planes) == 0 else np.zeros_like(more)
    row, word = np.nonzero(enough)
    bits = np.unpackbits(enough[row, word].view(np.uint8).reshape(-1, 8), axis=1)
    hit, bit = np.nonzero(bits)
    return row[hit], word[hit] * 64 + bit


def verified(group: pa.Table, turn: int, least: float, lines: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (i, j) of the rows of two blocks (or one) that first share a cell in this round."""
    block = group["block"].to_numpy()
    x = unit(rows_of(group["v"]))
    cells = group["cells"].combine_chunks().flatten().to_numpy().reshape(len(x), -1)
    lo, hi = group["lo"][0].as_py(), group["hi"][0].as_py()
    left, right = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
    if not len(left) or not len(right):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = (x @ gaussian(seed + 1, x.shape[1], lines)).T.astype(np.float32)
    a, b = collisions(h[:, left], h[:, right], WIDTH * math.sqrt(2 - 2 * least), needed(lines))
    i, j = left[a], right[b]
    found = []
    for at in range(0, len(i), 1 << 16):
        p, q = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
        keep = (lo != hi) | (p < q)
        keep &= ~(cells[p, :turn] == cells[q, :turn]).any(axis=1)
        p, q = p[keep], q[keep]
        near = np.einsum("ij,ij->i", x[p], x[q]) >= least
        found.append((p[near], q[near]))
    return tuple(np.concatenate(s) if s else np.zeros(0, np.int64) for s in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def least_reached(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n places the least place that the pairs (a, b) connect it with."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        while (new != new[new]).any():
            new = new[new]
        if (new == label).all():
            return label
        label = new


def partial_links(dealt: DataFrame, least: float, lines: int, seed: int) -> DataFrame:
    """(node, links, root): for every point with a link in a task, how many vectors it links with there and a point of its component."""

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        node, weight = group["node"].to_numpy(), group["weight"].to_numpy()
        i, j = verified(group, group["turn"][0].as_py(), least, lines, seed)
        links = np.zeros(len(node), np.int64)
        np.add.at(links, i, weight[j])
        np.add.at(links, j, weight[i])
        root = node[least_reached(len(node), i, j)]
        some = np.flatnonzero(links)
        return pa.table({"node": node[some], "links": links[some], "root": root[some]})

    return dealt.groupBy("d", "turn", "cell", "lo", "hi").applyInArrow(run, "node long, links long, root long")


def dealt_blocks(points: DataFrame, block: int = BLOCK) -> DataFrame:
    """``points`` once for each task: a cell's points lie in blocks of about ``block``, and every two blocks (lo, hi) meet."""
    rows = points.select("node", "weight", "d", "v", "cells", F.posexplode("cells").alias("turn", "cell"))
    sizes = points.select("d", F.posexplode("cells").alias("turn", "cell")).groupBy("d", "turn", "cell").agg(F.count(F.lit(1)).alias("size"))
    sizes = sizes.where("size > 1").withColumn("blocks", F.ceil(F.col("size") / block).cast("int")).drop("size")
    met = rows.join(sizes, ["d", "turn", "cell"]).withColumn("block", F.pmod(F.xxhash64("node", "turn"), F.col("blocks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    return met.withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")}).drop("other")


def linked(vectors: DataFrame, least: float = LEAST, ident: str = "vec_id", vector: str = "embedding", lines: int = LINES, cell: int = CELL, block: int = BLOCK, seed: int = 12) -> DataFrame:
    """(vec_id, n_links, component_id) of every row."""
    kind = vectors.schema[vector].dataType.elementType
    keep = vector if isinstance(kind, (T.FloatType, T.DoubleType)) else F.col(vector).cast("array<double>")
    rows = vectors.select(F.col(ident).cast("long").alias("id"), F.col(keep).alias("v") if isinstance(keep, str) else keep.alias("v"))
    rows = rows.withColumns({"h": F.xxhash64("v"), "g": F.xxhash64(F.lit(1), "v")})
    good = usable(rows, "v")
    points = good.groupBy("h", "g").agg(F.first("v").alias("v"), F.count(F.lit(1)).alias("weight"), F.min("id").alias("least"))
    points = common.cut(points.withColumn("node", F.monotonically_increasing_id()).withColumn("d", F.size("v")))
    sides, turns = rounds(points.count(), least, cell)
    placed = celled(points.select("node", "weight", "d", "v"), sides, turns, seed)
    parts = common.staged(partial_links(dealt_blocks(common.cut(placed), block), least, lines, seed), "links")
    counts = parts.groupBy("node").agg(F.sum("links").alias("links"))
    labels = neardup.components(parts.select(F.col("node").alias("a"), F.col("root").alias("b")).where("a <> b"))
    known = points.select("node", "h", "g", "weight", "least").join(counts, "node", "left").join(labels, "node", "left")
    known = common.cut(known.withColumn("comp", F.coalesce("comp", "node")))
    heads = known.groupBy("comp").agg(F.min("least").alias("component"))
    found = known.join(heads, "comp").select("h", "g", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"), "component")
    fits = rows.join(found, ["h", "g"], "left")
    n_links = F.coalesce("links", F.lit(0)).cast("long")
    return fits.select(F.col("id").alias("vec_id"), n_links.alias("n_links"), F.when(F.col("links").isNull(), F.col("id")).otherwise(F.col("component")).alias("component_id"))


def op12_linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linked(common.table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


ORACLE = """WITH RECURSIVE ok AS (SELECT row_number() OVER () AS rid, vec_id, embedding::DOUBLE[] AS v FROM embeddings),
un AS MATERIALIZED (SELECT rid, vec_id, len(v) AS d, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u FROM ok WHERE v IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
ln AS MATERIALIZED (SELECT a.rid AS a, b.rid AS b FROM un a JOIN un b ON a.d = b.d AND a.rid <> b.rid AND list_dot_product(a.u, b.u) >= 0.9),
rc AS (SELECT rid AS a, rid AS b FROM ok UNION SELECT rc.a, ln.b FROM rc JOIN ln ON rc.b = ln.a),
cm AS (SELECT rc.a, min(ok.vec_id) AS component_id FROM rc JOIN ok ON ok.rid = rc.b GROUP BY rc.a)
SELECT vec_id, (SELECT count(*) FROM ln WHERE ln.a = ok.rid) AS n_links, component_id, coalesce(vec_id = component_id, false) AS kept FROM ok JOIN cm ON cm.a = ok.rid"""
