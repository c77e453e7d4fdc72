"""Toxicity scoring with subword bags.

A word is the mean of the embeddings of its hashed byte n-grams (bounds included), so an
unseen misspelling or inflection shares most of its vector with the words it comes from.
A bag is the mean of ``passage`` words in a row (0: of the whole text), and a linear softmax turns it into class logits.
A text is as toxic as its most toxic bags: training pools the bags of a text by a softmax whose sharpness grows from
the mean to nearly the maximum, and scoring takes the maximum.  Bags of one word are the default: the README has
the figures of larger ones, the whole text included.  Embeddings, softmax and
bias are trained jointly in numpy on a bounded sample of labelled rows.

Null and empty texts score 0.  Repeated rows score alike; rows labelled twice with
different labels count as toxic; null labels are ignored.  Ties for the sample go by a hash of the id, then by text.
Whole texts are scored in blocks of bounded memory.  Without toxic and clean examples every score is 0.  An empty table gives an
empty result.  Other columns are ignored, whatever their names, unless they are asked for; the stage hands them on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import common, grams

ORDERS = range(3, 7)
FOLD = grams.folding(punctuation_to_space=True)
BLANK = 32


@dataclass(frozen=True)
class ToxicityModel:
    """One number per n-gram bucket (embedding times the difference of the two softmax columns) and a bias."""

    grams: np.ndarray
    bias: float
    known: bool
    passage: int = 1


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word (run of non-blank bytes inside one text) and its text's index."""
    full = data != BLANK
    begin = full.copy()
    begin[1:] &= ~full[:-1]
    inner = offsets[:-1][np.diff(offsets) > 0]
    begin[inner] = full[inner]
    stop = full.copy()
    stop[:-1] &= ~full[1:]
    last = offsets[1:][np.diff(offsets) > 0] - 1
    stop[last] = full[last]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def word_means(data: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean n-gram value of every word, its neighbouring blanks included, and the word's text."""
    starts, ends, text = words_of(data, offsets)
    a = np.maximum(starts - 1, offsets[text])
    b = np.minimum(ends + 1, offsets[text + 1])
    sums, count = np.zeros(len(starts)), np.zeros(len(starts))
    for first, end, order, ids in grams.gram_blocks(data, ORDERS, len(rows)):
        lo, hi = np.searchsorted(b, first, side="right"), np.searchsorted(a, end, side="left")
        running = np.zeros(end - first + 1)
        np.cumsum(rows[ids], dtype=np.float64, out=running[1:])
        x = np.clip(a[lo:hi], first, end) - first
        y = np.maximum(np.clip(b[lo:hi] - order + 1, first, end) - first, x)
        sums[lo:hi] += running[y] - running[x]
        count[lo:hi] += y - x
    return sums / np.maximum(count, 1), text


def bags(text: np.ndarray, passage: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word and number of words of every bag, and its text, from the words' texts."""
    firsts = np.flatnonzero(np.diff(text, prepend=-1))
    if passage == 1:
        return np.arange(len(text)), np.ones(len(text)), text
    if passage > 1:
        inside = np.arange(len(text)) - np.repeat(firsts, np.diff(np.append(firsts, len(text))))
        firsts = np.flatnonzero(inside % passage == 0)
    return firsts, np.diff(np.append(firsts, len(text))).astype(float), text[firsts]


def peaks(data: np.ndarray, offsets: np.ndarray, rows: np.ndarray, passage: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts that have a word, and the greatest value of their bags."""
    value, text = word_means(data, offsets, rows)
    if not len(value):
        return np.zeros(0, np.int64), value
    at, size, text = bags(text, passage)
    firsts = np.flatnonzero(np.diff(text, prepend=-1))
    return text[firsts], np.maximum.reduceat(np.add.reduceat(value, at) / size, firsts)


def fit(rows: list[tuple[str, int]], buckets: int = 1 << 18, dim: int = 8, epochs: int = 40, rate: float = 0.3, seed: int = 11, passage: int = 1) -> ToxicityModel:
    """Joint training on (text, 0 or 1) rows with Adagrad; classes weigh the same."""
    rows = [(t, y) for t, y in rows if t and FOLD[np.frombuffer(t.encode(), np.uint8)].max(initial=BLANK) > BLANK]
    label = np.array([y for _, y in rows], float)
    if not len(label) or label.min() == label.max():
        return ToxicityModel(np.zeros(buckets), 0.0, False)
    draw = np.random.default_rng(seed)
    raw = [t.encode() for t, _ in rows]
    data = FOLD[np.frombuffer(b"".join(raw), np.uint8)]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    starts, ends, text = words_of(data, offsets)
    flat = data.tobytes()
    vocabulary: dict[bytes, int] = {}
    word = np.fromiter((vocabulary.setdefault(flat[a:b], len(vocabulary)) for a, b in zip(starts, ends)), np.int64, len(starts))
    word = word.astype(np.int32)
    text = text.astype(np.int32)
    del flat, raw
    padded = b"".join(b" %b " % w for w in vocabulary)
    sizes = np.fromiter((len(w) + 2 for w in vocabulary), np.int64, len(vocabulary))
    del vocabulary
    cuts = np.concatenate([[0], np.cumsum(sizes)])
    owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    parts = []  # (n-gram bucket, word) pairs, a block and an order at a time
    for first, end, order, got in grams.gram_blocks(np.frombuffer(padded, np.uint8), ORDERS, buckets):
        inside = np.arange(first, end) + order <= cuts[owner[first:end] + 1]
        parts.append((got[inside], owner[first:end][inside]))
    del padded, owner
    per_word = np.maximum(sum(np.bincount(own, minlength=len(sizes)) for _, own in parts), 1)
    used = sum(np.bincount(gram, minlength=buckets) for gram, _ in parts) > 0
    embed = draw.normal(0, 0.1, (buckets, dim)) * used[:, None]
    weight = draw.normal(0, 0.5, dim)  # of class 1 less class 0
    bias, seen_e, seen_w, seen_b = 0.0, np.full_like(embed, 1e-8), np.full(dim, 1e-8), 1e-8
    at, many, text = bags(text, passage)
    firsts = np.flatnonzero(np.diff(text, prepend=-1))
    share = np.where(label == 1, 0.5 / label.sum(), 0.5 / (len(label) - label.sum()))
    for epoch in range(epochs):
        sharp = 0.5 + 4.0 * epoch / max(1, epochs - 1)
        table = embed @ weight
        value = sum(np.bincount(own, weights=table[gram], minlength=len(sizes)) for gram, own in parts) / per_word
        token = value[word] if passage == 1 else np.add.reduceat(value[word], at) / many
        top = np.maximum.reduceat(token, firsts)
        pull = np.exp(sharp * (token - top[text]))
        pull /= np.add.reduceat(pull, firsts)[text]
        pooled = np.add.reduceat(pull * token, firsts)
        p = 1 / (1 + np.exp(-np.clip(pooled + bias, -30, 30)))
        error = (p - label) * share
        drive = pull * error[text]
        drive = drive if passage == 1 else np.repeat(drive / many, many.astype(np.int64))
        per_vocab = np.bincount(word, weights=drive, minlength=len(sizes)) / per_word
        per_gram = sum(np.bincount(gram, weights=per_vocab[own], minlength=buckets) for gram, own in parts)
        grad_e, grad_w, grad_b = per_gram[:, None] * weight, per_gram @ embed, error.sum()
        seen_e += grad_e**2
        seen_w += grad_w**2
        seen_b += grad_b**2
        embed -= rate * grad_e / np.sqrt(seen_e)
        weight -= rate * grad_w / np.sqrt(seen_w)
        bias -= rate * grad_b / np.sqrt(seen_b)
    table = embed @ weight
    # What a text's maximum means: a logistic curve over the sample's maxima, classes weighing the same.
    reach = peaks(data, offsets, table, passage)[1]
    mid, spread = np.average(reach, weights=share), max(reach.std(), 1e-9)
    x, slope, level = (reach - mid) / spread, 1.0, 0.0
    for _ in range(100):  # Newton's method with a small ridge
        p = 1 / (1 + np.exp(-np.clip(slope * x + level, -30, 30)))
        curve = share * p * (1 - p)
        hess = np.array([[(curve * x * x).sum() + 2e-3, (curve * x).sum()], [(curve * x).sum(), curve.sum() + 1e-6]])
        step = np.linalg.solve(hess, np.array([(share * (p - label) * x).sum() + 2e-3 * slope, (share * (p - label)).sum()]))
        slope, level = slope - np.clip(step[0], -1, 1), level - np.clip(step[1], -1, 1)
    return ToxicityModel(table * (slope / spread), float(level - slope * mid / spread), True, passage)


def training_rows(docs: DataFrame, labels: DataFrame, usable, per_class: int, longest: int = 1 << 15) -> list[tuple[str, int]]:
    """At most ``per_class`` labelled rows of each class of at most ``longest`` bytes, chosen by a hash of the id: the documented bound of the sample."""
    known = labels.where(F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.select("doc_id", "toxic", F.xxhash64("doc_id", F.lit(23)).alias("h")).where(usable)
    picked = [known.where(F.col("toxic") == y).orderBy("h").limit(per_class) for y in (0, 1)]
    chosen = F.broadcast(picked[0].unionByName(picked[1]))  # at most 2 x per_class rows of three numbers
    rows = docs.select("doc_id", "text").where(F.col("text").isNotNull() & (F.octet_length("text") <= longest)).join(chosen, "doc_id")
    place = F.row_number().over(W.partitionBy("toxic").orderBy("h", "text"))  # ids may repeat
    return [(r["text"], r["toxic"]) for r in rows.withColumn("place", place).where(F.col("place") <= per_class).orderBy("h", "text").select("text", "toxic").collect()]


def score(docs: DataFrame, model: ToxicityModel, keep: list[str], out: str = "score") -> DataFrame:
    """The columns ``keep`` with the probability of the toxic class."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # one number per bucket: a fixed size
    source = docs.select(*keep, *([] if "text" in keep else ["text"]))
    kept = [f for f in source.schema.fields if f.name in keep]
    schema = T.StructType([*kept, T.StructField(out, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        rows = m.grams.astype(np.float32)
        for batch in common.small_batches(batches, max_bytes=2 << 20):
            data, offsets = common.text_bytes(batch.column("text"))
            found = np.zeros(batch.num_rows)
            if m.known and len(data):
                text, top = peaks(FOLD[data], offsets, rows, m.passage)
                found[text] = 1 / (1 + np.exp(-np.clip(top + m.bias, -30, 30)))
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in kept], pa.array(found, pa.float64())], names=schema.names)

    return source.mapInArrow(run, schema)


def train(spark: SparkSession, docs: DataFrame, sf_dir: str, per_class: int = 1500) -> ToxicityModel:
    usable = common.key_bucket(F.col("doc_id"), 4) != 2
    return fit(training_rows(docs, common.table(spark, sf_dir, "labels").select("doc_id", "toxic"), usable, per_class))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    held = common.key_bucket(F.col("doc_id"), 4) == 2
    return score(docs, train(spark, docs, sf_dir), ["doc_id"]).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.3; the toxic go."""
    names = docs.columns
    out = common.fresh(docs, "__toxicity")
    return score(docs, train(spark, docs, sf_dir), names, out).where(F.col(out) < 0.3).select(*names)
