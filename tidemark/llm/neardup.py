"""Near-duplicate detection with ProbMinHash.

Texts are weighted sets of five-word shingles (weight: how often the shingle occurs).
Their ProbMinHash registers are cut into bands; texts that share a band are candidates;
a candidate pair is a link where its exact probability Jaccard is 0.8 or more.  Groups
are the connected components of the links.

Work is done once per distinct text.  In each band bucket the most connected text leads
and is compared with the other members, so that a bucket of n near copies costs n and not
n x n comparisons.  Buckets whose members then still lie in different components are
compared exhaustively between components, block of members by block of members (the largest
component only against the others), on finer
sketches (four bits of each of 960 registers).  Registers of a pair agree independently, each with
its probability Jaccard, and bits that agree by chance only add candidates: a pair is verified
unless more registers differ than 5.5 standard deviations above what 0.8 gives, which loses one
link in 20 million at exactly 0.8, however short the texts.

Texts made from one template share bands, though few of them are near copies.  A bucket of which more than a block of members
lie outside the largest component is therefore thinned by a prefix filter, which loses nothing: a link's common shingles have at least
0.8 of the weight of either text, so in any order of shingles its first common one comes when 0.2 of the weight has passed at most.
Shingles are ordered by how many texts have them, rarest first; members meet only where such first shingles are the same.

With 40 bands of 6 registers a pair at exactly 0.8 shares no band with a chance of 5 in a
million.  ``sketched=False`` verifies every pair of a bucket that lies in two components, without sketches.

Texts that are equal and have a word are always one group, repeated rows included.  Null, empty and blank
texts have no shingles: each such doc_id is a group of its own.  A doc_id may repeat with other texts: classes are those
of texts, so its rows may lie in several classes, and no class depends on it.  Very long texts are read whole, a block of texts at a
time; a text counts as one row of its own block.  Of ties for a bucket's lead the greater node leads, which changes no group.
An empty table gives an empty result.  Other columns of the input, maps included, are ignored, whatever
their names; the stage hands them on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import common, shingles

REGISTERS, ROWS, LEAST = 240, 6, 0.8
FINE, BITS, BLOCK = 960, 4, 1024


def banded(docs: DataFrame, registers: int = REGISTERS, rows: int = ROWS) -> DataFrame:
    """(fp, bands) of every text that has a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.small_batches(batches):
            data, offsets = common.text_bytes(batch.column("text"))
            text, shingle, weight = shingles.weighted_shingles(data, offsets)
            used, at = np.unique(text, return_inverse=True)
            keys = shingles.band_keys(shingles.signatures(at, shingle, weight, len(used), registers), rows)
            bands = pa.ListArray.from_arrays(pa.array(np.arange(len(used) + 1) * keys.shape[1], pa.int32()), pa.array(keys.ravel(), pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("fp").take(pa.array(used)), bands], names=["fp", "bands"])

    return docs.select("fp", "text").mapInArrow(run, "fp string, bands array<long>")


def sketches(texts: DataFrame, registers: int = FINE) -> DataFrame:
    """(node, sketch) from (node, text): the ``BITS`` low bits of each register, as planes of bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.small_batches(batches, max_bytes=1 << 20):
            text, shingle, weight = shingles.weighted_shingles(*common.text_bytes(batch.column("text")))
            got = shingles.signatures(text, shingle, weight, batch.num_rows, registers)
            planes = np.concatenate([np.packbits((got >> np.uint64(b)).astype(np.uint8) & 1, axis=1) for b in range(BITS)], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([r.tobytes() for r in planes], pa.binary())], names=["node", "sketch"])

    return texts.select("node", "text").mapInArrow(run, "node long, sketch binary")


def verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of text nodes whose probability Jaccard is ``least`` or more.

    ``texts`` is (node, text), one row a node.  Pairs are dealt by their b text first and
    then by a; a leader of very many pairs is split by Spark's skew join.
    """
    left = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    both = left.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.small_batches(batches, "text_b", 1 << 20):
            for part in common.small_batches(iter([batch]), "text_a", 1 << 20):
                a, b = part.column("a").to_numpy(), part.column("b").to_numpy()
                leaders, at = np.unique(a, return_index=True)
                sides = []
                for column in (part.column("text_a").take(pa.array(at)), part.column("text_b")):
                    text, shingle, weight = shingles.weighted_shingles(*common.text_bytes(column))
                    cuts = np.searchsorted(text, np.arange(len(column) + 1))
                    sides.append((cuts, shingle, weight))
                (ca, sa, wa), (cb, sb, wb) = sides
                row = np.searchsorted(leaders, a)
                near = np.array([shingles.probability_jaccard(sa[ca[i] : ca[i + 1]], wa[ca[i] : ca[i + 1]], sb[cb[k] : cb[k + 1]], wb[cb[k] : cb[k + 1]]) for k, i in enumerate(row)])
                keep = near >= least - 1e-12
                yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], names=["a", "b"])

    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def meetings(members: DataFrame, block: int = BLOCK) -> DataFrame:
    """``members`` with the tasks (key, lo, hi) that they are sent to, so that every two of different components meet.

    The largest component of a bucket and its other members are dealt into parts of ``block`` rows on average.  Every part of
    the others meets all parts; parts of the largest component don't meet each other.
    """
    sizes = members.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("size"))
    sides = sizes.groupBy("key").agg(F.max(F.struct("size", "comp")).alias("main"), F.sum("size").alias("all"))
    sides = sides.where(F.col("all") > F.col("main.size")).select("key", F.col("main.comp").alias("main"), F.ceil(F.col("main.size") / block).cast("int").alias("mains"), F.ceil((F.col("all") - F.col("main.size")) / block).cast("int").alias("others"))
    dealt = members.join(sides, "key").withColumn("in_main", F.col("comp") == F.col("main"))
    place = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    dealt = dealt.withColumn("part", F.when(F.col("in_main"), place("mains")).otherwise(F.col("mains") + place("others")))
    met = F.sequence(F.when(F.col("in_main"), F.col("mains")).otherwise(F.lit(0)), F.col("mains") + F.col("others") - 1)
    meets = dealt.withColumn("other", F.explode(met))
    return meets.select("key", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "part", "node", "comp", "bands", "sketch")


def first_shingles(texts: DataFrame, least: float = LEAST) -> DataFrame:
    """(node, key) from (node, text): the shingles that can be the first common one of a text and another with a probability Jaccard of ``least``.

    Texts linked by ``least`` or more share a key.  The order is by the number of texts that have a shingle; shingles of one text alone have no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.small_batches(batches):
            text, shingle, weight = shingles.weighted_shingles(*common.text_bytes(batch.column("text")))
            total = np.bincount(text, weight, batch.num_rows)
            node = batch.column("node").take(pa.array(text))
            yield pa.RecordBatch.from_arrays([node, pa.array(shingle.astype(np.int64)), pa.array(weight / total[text])], names=["node", "key", "share"])

    each = texts.select("node", "text").mapInArrow(run, "node long, key long, share double")
    common_ones = each.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = each.join(common_ones, "key")
    node = W.partitionBy("node")
    upto = F.sum("share").over(node.orderBy("n", "key").rowsBetween(W.unboundedPreceding, 0))
    before = 1 - F.sum("share").over(node) + upto - F.col("share")  # what the text has alone comes first
    return rows.withColumn("before", before).where(F.col("before") <= 1 - least + 1e-9).select("node", "key")


def thinned(members: DataFrame, texts: DataFrame, least: float = LEAST, block: int = BLOCK) -> DataFrame:
    """(key, node, comp): ``members`` (key, node, comp, others) of mixed buckets, those of crowded buckets keyed by first shingles instead.

    A bucket is crowded if more than ``block`` members lie outside its largest component (``others``).  First shingles that the same texts
    have are one key, and those of one component none.  Where more than ``block`` texts have a first shingle they stay in their bucket.
    """
    crowded = members.where(F.col("others") > block).select("key", "node", "comp")
    if crowded.isEmpty():
        return members.select("key", "node", "comp")
    nodes = common.cut(crowded.select("node", "comp").distinct())
    firsts = common.cut(first_shingles(texts.join(nodes.select("node"), "node"), least).join(nodes, "node"))
    marks = [F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"x{k}") for k in (1, 2)]
    sets = firsts.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), *marks).where("lo < hi")
    few = sets.where(F.col("size") <= block).groupBy("size", "x1", "x2").agg(F.min("key").alias("key")).select("key")
    many = firsts.join(sets.where(F.col("size") > block).select("key"), "key").select("node").distinct()
    stay = crowded.join(many, "node", "left_semi")
    calm = members.where(F.col("others") <= block)
    return calm.select("key", "node", "comp").unionByName(stay).unionByName(firsts.join(few, "key").select("key", "node", "comp"))


def across(members: DataFrame, least: float = LEAST, registers: int = FINE, block: int = BLOCK, sketched: bool = True) -> DataFrame:
    """Pairs (a < b) of nodes of one bucket, but of different components, whose sketches agree nearly as ``least`` asks (all, unless ``sketched``).

    ``members`` is (key, node, comp, bands, sketch).  Every two parts of ``meetings`` meet in a task of their own,
    which holds 2 x block members at most on average.  A pair is reported by the first band that it shares, and by each first shingle (``thinned``).
    """
    meets = meetings(members, block)
    differ = (1 - least + 5.5 * np.sqrt(least * (1 - least) / registers)) * registers if sketched else registers

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        key, lo, hi = group["key"][0].as_py(), group["lo"][0].as_py(), group["hi"][0].as_py()
        node, comp, part = (group[c].to_numpy() for c in ("node", "comp", "part"))
        bands = group["bands"].combine_chunks().flatten().to_numpy().reshape(len(node), -1)
        planes = np.split(np.frombuffer(b"".join(group["sketch"].to_pylist()), np.uint64).reshape(len(node), -1), BITS, axis=1)
        band = next(iter(np.flatnonzero((bands == key).all(axis=0))), None)
        left, right = sorted((np.flatnonzero(part == lo), np.flatnonzero(part == hi)), key=len)
        found = []
        for i in left:
            j = right[(comp[right] != comp[i]) & ((node[right] > node[i]) | (lo != hi))]
            j = j[np.bitwise_count(np.bitwise_or.reduce([plane[j] ^ plane[i] for plane in planes])).sum(axis=1, dtype=np.int64) <= differ]
            if band is None:
                j = j[(bands[j] == bands[i]).any(axis=1)]
            else:
                j = j[~(bands[j, :band] == bands[i, :band]).any(axis=1)]
            found.append(np.stack([np.minimum(node[i], node[j]), np.maximum(node[i], node[j])]))
        a, b = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return meets.groupBy("key", "lo", "hi").applyInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node with an edge; comp is the same for connected nodes.

    Every round sends each node to the neighbour that comes first in an order, follows that twice and
    rewrites the edges.  The first two rounds order by node, which ends stars at once; the others by a
    hash, new in each round, which merges a constant share of the nodes on average, whatever the shape,
    so that long chains take some log(nodes) rounds.
    """
    edges = common.cut(edges.select("a", "b").where("a <> b"))
    labels, turn = None, 0
    while not edges.isEmpty():
        ends = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        order = lambda c: F.struct((F.xxhash64(c, F.lit(turn)) if turn > 1 else F.lit(0).cast("long")).alias("h"), F.col(c).alias("n"))  # noqa: B023, E731
        first = ends.groupBy("a").agg(F.min(order("b")).alias("m"))
        step = first.select(F.col("a").alias("node"), F.least(order("a"), F.col("m"))["n"].alias("up"))
        above = step.select(F.col("node").alias("up"), F.col("up").alias("parent"))
        parent = common.cut(step.join(above, "up").select("node", "parent"))
        if labels is None:
            labels = parent.select("node", F.col("parent").alias("comp"))
        else:
            moved = parent.select(F.col("node").alias("comp"), "parent")
            labels = common.cut(labels.join(moved, "comp", "left").select("node", F.coalesce("parent", "comp").alias("comp")))
        low = edges.join(parent.select(F.col("node").alias("a"), F.col("parent").alias("pa")), "a")
        low = low.join(parent.select(F.col("node").alias("b"), F.col("parent").alias("pb")), "b")
        edges = common.cut(low.where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
        turn += 1
    return labels if labels is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("comp"))


def groups(docs: DataFrame, least: float = LEAST, registers: int = REGISTERS, rows: int = ROWS, sketched: bool = True, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(classes, links): node, fp and class of every distinct text that has a word, and the links that were verified.

    The links connect every class; pairs inside a class that other links join already aren't all tried.
    """
    spark = docs.sparkSession
    source = docs.select(F.md5(F.col("text").cast("binary")).alias("fp"), "text").where(F.col("text").isNotNull())
    reps = banded(source, registers, rows).groupBy("fp").agg(F.first("bands").alias("bands"))
    reps = common.cut(reps.select(F.monotonically_increasing_id().alias("node"), "fp", "bands"))
    keys = reps.select("node", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    buckets = common.cut(keys.join(shared, "key"))
    central = buckets.groupBy("node").agg(F.sum("n").alias("links"))
    leaders = buckets.join(central, "node").groupBy("key").agg(F.max(F.struct("links", "node"))["node"].alias("a"))
    tried = common.cut(buckets.join(leaders, "key").where("a <> node").select("a", F.col("node").alias("b")).distinct())
    used = buckets.select("node").distinct().join(reps.select("node", "fp"), "node")
    texts = source.join(used, "fp", "left_semi").groupBy("fp").agg(F.first("text").alias("text")).join(used, "fp")
    folder = common.fresh_folder(spark, "texts")
    texts.select("node", "text").write.parquet(folder)
    texts = spark.read.parquet(folder)
    links = common.cut(verified(tried, texts, least))
    labels = components(links)
    # Buckets that still hold more than one component.
    placed = buckets.join(labels, "node", "left").select("key", "node", F.coalesce("comp", "node").alias("comp"))
    sizes = placed.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("size"))
    mixed = sizes.groupBy("key").agg((F.sum("size") - F.max("size")).alias("others")).where("others > 0")
    open_ = common.cut(thinned(common.cut(placed.join(mixed, "key")), texts, least, block))
    nodes = open_.select("node").distinct()
    fine = common.cut(sketches(texts.join(nodes, "node")))
    open_ = open_.join(reps.select("node", "bands"), "node").join(fine, "node")
    done = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = common.cut(across(open_, least, block=block, sketched=sketched).distinct().join(done, ["a", "b"], "left_anti"))
    if not rest.isEmpty():
        links = common.cut(links.unionByName(verified(rest, texts, least)))
        labels = components(links)
    common.remove_folder(spark, folder)
    classes = reps.select("node", "fp").join(labels, "node", "left").select("node", "fp", F.coalesce("comp", "node").alias("comp"))
    return classes, links


def classified(docs: DataFrame, least: float = LEAST, sketched: bool = True, block: int = BLOCK) -> DataFrame:
    """doc_id, fp and comp of every row; comp is null where the text has no word."""
    classes, _ = groups(docs, least, sketched=sketched, block=block)
    rows = docs.select("doc_id", F.md5(F.col("text").cast("binary")).alias("fp"))
    return rows.join(classes.select("fp", "comp"), "fp", "left")


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and class_id of every document, with the class's least doc_id and its rows.

    A class_id is the number of a text of the class; below 0, -1 - doc_id, where the text has no word.
    """
    rows = common.cut(classified(common.table(spark, sf_dir, "documents")))
    heads = rows.where("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("head"), F.count(F.lit(1)).alias("class_size"))
    out = rows.join(heads, "comp", "left")
    alone = F.lit(-1) - F.pmod(F.coalesce(F.col("doc_id"), F.lit((1 << 63) - 1)), F.lit((1 << 63) - 1))
    return out.select("doc_id", F.coalesce("comp", alone).alias("class_id"), F.coalesce("head", "doc_id").alias("head_id"), F.coalesce("class_size", F.lit(1)).alias("class_size"))


def orderable(kind: T.DataType) -> bool:
    """Whether Spark can order values of this type."""
    if isinstance(kind, T.ArrayType):
        return orderable(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(orderable(f.dataType) for f in kind.fields)
    return not isinstance(kind, (T.MapType, T.VariantType))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, the one with the least doc_id; of rows that share it the first by all columns that have an order."""
    names, fp = docs.columns, common.fresh(docs, "__fp")
    classes, _ = groups(docs)
    marked = docs.withColumn(fp, F.md5(F.col("text").cast("binary")))
    members = marked.select(F.col(fp).alias("fp"), "doc_id").join(classes.select("fp", "comp"), "fp")
    heads = members.groupBy("comp").agg(F.min(F.struct("doc_id", "fp")).alias("h")).select("h.doc_id", "h.fp")
    kept = marked.alias("d").join(heads.alias("h"), (F.col(f"d.{fp}") == F.col("h.fp")) & F.col("d.doc_id").eqNullSafe(F.col("h.doc_id")), "left_semi")
    by = [f.name for f in docs.schema.fields if orderable(f.dataType)]
    one = kept.groupBy(fp).agg(F.min_by(F.struct(*names), F.struct(*by)).alias("row")).select("row.*")
    return one.unionByName(blank(docs)).select(*names)


def blank(docs: DataFrame) -> DataFrame:
    """The documents whose text is null or has no word."""
    return docs.where(F.col("text").isNull() | ~F.col("text").rlike("[^\\x20\\x09-\\x0D]"))
