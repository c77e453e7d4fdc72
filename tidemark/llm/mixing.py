"""Mixing sources to target weights by a low-discrepancy schedule.

Point t of the schedule is the golden-ratio point frac(t x phi); the cumulative weights map it
to a source, and its rank among the points of that source says which block of the source it
takes.  Points beyond a source's last block are left out, blocks without a point come last, and what remains is
numbered without gaps: the slots.  So every stretch of slots holds the sources in about their shares.  A source's documents are shuffled by a hash, laid end to end and cut into blocks of
equal words; the stream starts again when it is used up, and its last block ends exactly at
the source's target.

Targets share 150 % of all words by weight (5, 2, 1 and again, by source in code-point order,
null last); none exceeds twice its source's words, and what it would have more is reshared.
Null and blank texts have no words and take no part (taken 0, no slot).  Repeated rows are documents
of their own, which tie for their places: equal rows may swap theirs.  Sources whose caps tie fill up in code-point
order.  Of very long texts only the number of words matters; they span several blocks.  An empty table gives an
empty result.  Nothing depends on the partitioning.  Other columns are ignored, whatever their names; the stage hands them on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm import common

WEIGHTS = (5, 2, 1)
GOLDEN = 2654435769  # 2^32 / golden ratio
BLOCK_WORDS = 1024
CELLS = 4096
RUN = 1 << 16


def word_count(text: Column) -> Column:
    """How many runs of characters that aren't ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def targets(rows: DataFrame, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target, words) of each source: shares by weight, filled up to the cap."""
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (place % len(WEIGHTS) + 1).cast("int")).cast("double")
    sources = sources.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    by_fill = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = F.sum("cap").over(by_fill.rowsBetween(W.unboundedPreceding, 0)) - F.col("cap")
    after = F.sum("weight").over(by_fill.rowsBetween(0, W.unboundedFollowing))
    total = F.sum("source_size").over(W.partitionBy())
    level = (total * share - before) / after
    sources = sources.withColumn("level", F.when(level <= F.col("cap") / F.col("weight"), level))
    level = F.max("level").over(by_fill.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    target = F.least(F.col("cap"), F.coalesce(level * F.col("weight"), F.col("cap")))
    return sources.select("source", "source_size", target.alias("target"), F.round(target).cast("long").alias("words"))


def streamed(rows: DataFrame) -> DataFrame:
    """Lay the documents of each source end to end in hash order: ``start`` is a document's first word.

    ``rows`` is (doc_id, source, size).  Equal rows are counted first and unfolded last.  Sums over the 4096
    hash prefixes of each source replace one long running sum, so a source of very many rows is spread.
    """
    counted = rows.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("n"))
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":mix")).cast("binary"))
    dealt = common.cut(counted.withColumn("h", key).withColumn("cell", F.substring("h", 1, 3)).withColumn("all", F.col("n") * F.col("size")))
    source = F.struct("source").alias("s")  # a struct, so that null sources join
    sums = dealt.groupBy(source, "cell").agg(F.sum("all").alias("sum"))
    before = sums.select("s", "cell", (F.sum("sum").over(W.partitionBy("s").orderBy("cell")) - F.col("sum")).alias("before"))
    inside = W.partitionBy("s", "cell").orderBy("h", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)
    placed = dealt.withColumn("s", source).withColumn("at", F.sum("all").over(inside) - F.col("all")).join(before, ["s", "cell"])
    copy = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("copy")
    return placed.select("doc_id", "source", "size", (F.col("before") + F.col("at")).alias("first"), copy).withColumn("start", F.col("first") + F.col("copy") * F.col("size")).drop("first")


def schedule(spark: SparkSession, plan: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """(slot, s, rank): which block of which source each slot of the mix takes, slots from 0 without gaps.  ``plan`` has source and words."""
    sources = common.cut(plan.where("words > 0").select(F.struct("source").alias("s"), F.ceil(F.col("words") / block).alias("blocks")))
    slots = int(sources.agg(F.coalesce(F.sum("blocks"), F.lit(0))).first()[0])
    upto = F.sum("blocks").over(W.orderBy("s"))
    point = lambda c: F.floor(c * float(1 << 32) / max(1, slots)).cast("long")
    cuts = sources.select("s", "blocks", point(upto - F.col("blocks")).alias("lo"), point(upto).alias("hi"))
    width = (1 << 32) // CELLS
    cells = cuts.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))))
    drawn = spark.range(slots).select(F.col("id").alias("slot"), F.pmod(F.pmod(F.col("id"), F.lit(1 << 32)) * (GOLDEN % (1 << 31)) + F.pmod(F.col("id"), F.lit(2)) * (GOLDEN - GOLDEN % (1 << 31)), F.lit(1 << 32)).alias("u"))
    drawn = drawn.withColumn("cell", F.floor(F.col("u") / width)).join(cells, "cell").where("u >= lo and u < hi")
    drawn = common.cut(drawn.select("slot", "s", "blocks", F.floor(F.col("slot") / RUN).alias("run")))
    runs = drawn.groupBy("s", "run").agg(F.count(F.lit(1)).alias("n"))
    before = runs.select("s", "run", (F.sum("n").over(W.partitionBy("s").orderBy("run")) - F.col("n")).alias("before"))
    ranked = drawn.withColumn("at", F.row_number().over(W.partitionBy("s", "run").orderBy("slot")) - 1).join(before, ["s", "run"])
    ranked = ranked.select("slot", "s", (F.col("before") + F.col("at")).alias("rank"), "blocks").where("rank < blocks").drop("blocks")
    got = runs.groupBy("s").agg(F.sum("n").alias("got"))
    short = sources.join(got, "s", "left").withColumn("got", F.coalesce("got", F.lit(0))).where("got < blocks")
    open_ = F.col("blocks") - F.col("got")
    short = short.withColumn("at", slots + F.sum(open_).over(W.orderBy("s")) - open_)  # one row a source
    late = short.select("s", "got", "at", F.explode(F.sequence(F.col("got"), F.col("blocks") - 1)).alias("rank"))
    all_ = ranked.unionByName(late.select((F.col("at") + F.col("rank") - F.col("got")).cast("long").alias("slot"), "s", "rank"))
    all_ = common.cut(all_.withColumn("run", F.floor(F.col("slot") / RUN)))
    runs = all_.groupBy("run").agg(F.count(F.lit(1)).alias("n"))  # one row for 65,536 slots
    before = runs.select("run", (F.sum("n").over(W.orderBy("run")) - F.col("n")).alias("before"))
    place = F.row_number().over(W.partitionBy("run").orderBy("slot")) - 1
    return all_.withColumn("at", place).join(before, "run").select((F.col("before") + F.col("at")).alias("slot"), "s", "rank")


def mixed(spark: SparkSession, rows: DataFrame, block: int = BLOCK_WORDS) -> tuple[DataFrame, DataFrame]:
    """(documents, pieces): each document with its source's figures, and the mix itself.

    A piece is a run of a document's words in a slot: slot, doc_id, source, size, copy, round (0: first
    use, 1: second), skip (words of the document before it) and words.
    """
    plan = common.cut(targets(rows))
    key = F.struct("source").alias("s")
    placed = common.cut(streamed(rows).withColumn("s", key).join(plan.withColumn("s", key).drop("source"), "s"))
    use = placed.where("size > 0").withColumn("round", F.explode(F.array(F.lit(0), F.lit(1))))
    use = use.withColumn("from", F.col("start") + F.col("round") * F.col("source_size"))
    use = use.withColumn("to", F.least(F.col("from") + F.col("size"), F.col("words"))).where("from < to")
    ranks = F.sequence(F.floor(F.col("from") / block), F.floor((F.col("to") - 1) / block))
    cut = use.withColumn("rank", F.explode(ranks)).withColumn("lo", F.greatest(F.col("from"), F.col("rank") * block)).withColumn("hi", F.least(F.col("to"), (F.col("rank") + 1) * block))
    pieces = cut.join(schedule(spark, plan, block), ["s", "rank"])
    return placed, pieces.select("slot", "doc_id", "source", "size", "copy", "start", "round", (F.col("lo") - F.col("from")).alias("skip"), (F.col("hi") - F.col("lo")).alias("words"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's figures, the words that the mix takes of it and the first and last slot that it fills."""
    rows = common.table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    placed, pieces = mixed(spark, rows)
    names = ["doc_id", "source", "size", "copy", "start"]
    all_ = pieces.groupBy(*names).agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot"))
    key = F.struct(*names).alias("k")
    out = placed.select("size", "source_size", "target", key).join(all_.select("taken", "first_slot", "last_slot", key), "k", "left")
    return out.select("k.doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), "first_slot", "last_slot")


ORACLE = """
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
    md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':mix') AS h FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, 2.0::DOUBLE * source_size AS cap, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM s0),
s2 AS (SELECT *, sum(cap) OVER f - cap AS before, sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS after, sum(source_size) OVER () AS total
    FROM s1 WINDOW f AS (ORDER BY cap / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
s3 AS (SELECT *, max(CASE WHEN (total * 1.5::DOUBLE - before) / after <= cap / w THEN (total * 1.5::DOUBLE - before) / after END) OVER () AS level FROM s2),
s4 AS (SELECT source, source_size, least(cap, coalesce(level * w, cap)) AS target FROM s3),
p AS (SELECT d.*, sum(size) OVER (PARTITION BY source ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS a, row_number() OVER () AS r FROM d),
b0 AS (SELECT source, CAST(ceil(round(target) / 1024.0::DOUBLE) AS BIGINT) AS blocks FROM s4 WHERE round(target) > 0),
b1 AS (SELECT *, CAST(sum(blocks) OVER (ORDER BY source NULLS FIRST) AS BIGINT) AS upto, CAST(sum(blocks) OVER () AS BIGINT) AS points FROM b0),
b2 AS (SELECT *, floor((upto - blocks) * 4294967296.0::DOUBLE / points) AS lo, floor(upto * 4294967296.0::DOUBLE / points) AS hi FROM b1),
pt AS (SELECT i, (i * 2654435769) % 4294967296 AS u FROM (SELECT unnest(range((SELECT CAST(coalesce(sum(blocks), 0) AS BIGINT) FROM b0))) AS i)),
pr AS (SELECT source, blocks, i, row_number() OVER (PARTITION BY source ORDER BY i) - 1 AS rank FROM pt JOIN b2 ON u >= lo AND u < hi),
gt AS (SELECT b2.source, b2.blocks, count(i) AS got FROM b2 LEFT JOIN pr ON pr.source IS NOT DISTINCT FROM b2.source GROUP BY b2.source, b2.blocks),
lt AS (SELECT source, unnest(range(got, blocks)) AS rank FROM gt WHERE got < blocks),
sl AS (SELECT source, rank, row_number() OVER (ORDER BY late, i, source NULLS FIRST, rank) - 1 AS slot
    FROM (SELECT source, rank, i, 0 AS late FROM pr WHERE rank < blocks UNION ALL SELECT source, rank, 0, 1 FROM lt)),
us AS (SELECT r, p.source, unnest(range(CAST(f // 1024 AS BIGINT), CAST((t - 1) // 1024 + 1 AS BIGINT))) AS rank
    FROM (SELECT r, p.source, CAST(a + round_ * source_size AS BIGINT) AS f, CAST(least(a + round_ * source_size + size, round(target)) AS BIGINT) AS t
        FROM p JOIN s4 ON p.source IS NOT DISTINCT FROM s4.source, (VALUES (0), (1)) x(round_)) p WHERE f < t),
ps AS (SELECT r, CAST(min(slot) AS BIGINT) AS first_slot, CAST(max(slot) AS BIGINT) AS last_slot FROM us JOIN sl ON us.source IS NOT DISTINCT FROM sl.source AND us.rank = sl.rank GROUP BY r)
SELECT doc_id, size, source_size, target,
    CAST(greatest(0, least(a + size, round(target)) - a) + greatest(0, least(a + size + source_size, round(target)) - a - source_size) AS BIGINT) AS taken, first_slot, last_slot
FROM p JOIN s4 ON p.source IS NOT DISTINCT FROM s4.source LEFT JOIN ps ON ps.r = p.r
"""


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix uses at least half of its words, by the first slot of each use."""
    whole = docs.select(F.struct(*docs.columns).alias("row"), word_count(F.col("text")).alias("size"))
    marked = whole.select("row", F.struct("row.doc_id", "row.source", "size").alias("id"), F.xxhash64("row.text").alias("hash"))
    _, pieces = mixed(spark, marked.select("id.*"))
    uses = pieces.groupBy("doc_id", "source", "size", "copy", "round").agg(F.sum("words").alias("w"), F.min("slot").alias("slot")).where("2 * w >= size")
    uses = uses.select(F.struct("doc_id", "source", "size", "copy").alias("k"), "slot", "round")
    # Rows that share id, source and size are copies 0, 1, ... by a hash of their text, numbered within hash buckets.
    marked = marked.withColumn("cell", F.pmod("hash", F.lit(1024)))
    cells = marked.groupBy("id", "cell").agg(F.count(F.lit(1)).alias("n"))
    before = cells.select("id", "cell", (F.sum("n").over(W.partitionBy("id").orderBy("cell")) - F.col("n")).alias("before"))
    place = F.row_number().over(W.partitionBy("id", "cell").orderBy("hash")) - 1
    marked = marked.join(before, ["id", "cell"]).withColumn("copy", F.col("before") + place)
    marked = marked.select("row", F.struct("id.doc_id", "id.source", "id.size", "copy").alias("k"))
    return marked.join(uses, "k").orderBy("slot", "k", "round").select("row.*")
