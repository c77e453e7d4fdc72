"""Language identification.

A text is the mean of the embeddings of its hashed byte n-grams; a linear softmax over
that mean gives the language.  Embeddings and softmax are trained together by stochastic
gradient descent in numpy on a bounded sample of labelled rows.  A temperature, fitted on
rows kept out of the descent, calibrates the probability; a text is rejected where the
calibrated probability lies under a bound that only ``reject_share`` of those rows miss.

Null texts, empty texts and texts without a letter are ``und`` with score 0 and rejected.
Repeated rows each get their own, equal, prediction.  Of languages that tie in probability the first by name is taken.  An empty table gives an empty
result.  Texts of any length are read whole, in blocks of bounded memory.  Other columns are ignored, whatever their
names, unless they are asked for; the stage hands them on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import common, grams

ORDERS = range(2, 5)
FOLD = grams.folding(punctuation_to_space=False)


@dataclass(frozen=True)
class LanguageModel:
    """labels; one row of logits per n-gram bucket (embedding times softmax weights); bias; calibration."""

    labels: tuple[str, ...]
    logits: np.ndarray
    bias: np.ndarray
    temperature: float
    least: float


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def features(text: bytes, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram buckets of one text and their shares."""
    data = FOLD[np.frombuffer(text, np.uint8)]
    counts = np.zeros(buckets, np.int64)
    for first, end, order, ids in grams.gram_blocks(data, ORDERS, buckets):
        counts += np.bincount(ids[: max(0, min(end, len(data) - order + 1) - first)], minlength=buckets)
    ids = np.flatnonzero(counts)
    return ids.astype(np.int32), (counts[ids] / max(1, counts.sum())).astype(np.float32)


def fit(rows: list[tuple[str, str]], buckets: int = 1 << 14, dim: int = 16, epochs: int = 6, rate: float = 8.0, reject_share: float = 0.001, seed: int = 7) -> LanguageModel:
    """Train on (text, label) rows: each whole text and two random snippets of it, so that short texts work as well."""
    labels = tuple(sorted({y for _, y in rows}))
    if not labels:
        return LanguageModel((), np.zeros((buckets, 0)), np.zeros(0), 1.0, 0.0)
    draw = np.random.default_rng(seed)
    examples: list[tuple[np.ndarray, np.ndarray, int]] = []
    held: list[tuple[np.ndarray, np.ndarray, int]] = []
    for i, (text, label) in enumerate(rows):
        raw, y = text.encode(), labels.index(label)
        pieces = [raw]
        for _ in range(2):
            size = int(draw.integers(12, 160))
            at = int(draw.integers(0, max(1, len(raw) - size)))
            pieces.append(raw[at : at + size])
        for piece in pieces:
            ids, share = features(piece, buckets)
            if len(ids):
                (held if i % 8 == 0 else examples).append((ids, share, y))
    embed = draw.normal(0, 0.1, (buckets, dim))
    weights = draw.normal(0, 0.1, (dim, len(labels)))
    bias = np.zeros(len(labels))
    steps, step = epochs * max(1, len(examples)), 0
    for _ in range(epochs):
        for k in draw.permutation(len(examples)):
            ids, share, y = examples[k]
            pace = rate * (1 - step / steps)
            step += 1
            hidden = share @ embed[ids]
            p = softmax((hidden @ weights + bias)[None])[0]
            p[y] -= 1
            back = weights @ p
            weights -= 0.05 * pace * np.outer(hidden, p)
            bias -= 0.01 * pace * p
            embed[ids] -= pace * share[:, None] * back
    logits = embed @ weights
    held = held or examples
    z = np.array([share @ logits[ids] + bias for ids, share, _ in held]).reshape(-1, len(labels))
    y = np.array([y for *_, y in held], int)
    grid = np.exp(np.linspace(np.log(0.2), np.log(20), 60))
    loss = [-np.log(np.maximum(softmax(z / t)[np.arange(len(y)), y], 1e-12)).mean() for t in grid] if len(y) else [0.0]
    temperature = float(grid[int(np.argmin(loss))])
    p = softmax(z / temperature)
    right = p.max(axis=1)[p.argmax(axis=1) == y] if len(y) else np.zeros(0)
    least = float(min(np.quantile(right, reject_share), 0.6)) if len(right) else 0.0
    return LanguageModel(labels, logits, bias, temperature, least)


def training_rows(docs: DataFrame, usable: Column, per_label: int, longest: int = 1 << 15, labels: int = 1000, all_rows: int = 60_000, all_bytes: int = 128 << 20) -> list[tuple[str, str]]:
    """At most ``per_label`` rows of at most ``longest`` bytes of each of the ``labels`` commonest labels, chosen by a hash
    of the row: the documented bounds of the sample.

    The driver holds ``all_rows`` rows and ``all_bytes`` bytes of text at most: each label gets an equal share of both, and one row at least.
    """
    known = docs.where(usable & F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.octet_length("text") <= longest))
    sizes = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(labels).collect()
    if not sizes:
        return []
    per_label, most = min(per_label, max(1, all_rows // len(sizes))), all_bytes // len(sizes)
    shares = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1.0, 1.2 * per_label / r["count"]))])
    point = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 30)) / float(1 << 30)
    picked = known.where(point < shares[F.col("lang")]).select("text", "lang", F.xxhash64("doc_id", "lang", "text").alias("h"))
    by_hash = W.partitionBy("lang").orderBy("h", "text")
    size = F.sum(F.octet_length("text")).over(by_hash.rowsBetween(W.unboundedPreceding, 0))
    chosen = picked.withColumn("place", F.row_number().over(by_hash)).withColumn("size", size)
    chosen = chosen.where((F.col("place") <= per_label) & ((F.col("size") <= most) | (F.col("place") == 1)))
    return [(r["text"], r["lang"]) for r in chosen.orderBy("h", "text").collect()]


def predict(docs: DataFrame, model: LanguageModel, keep: list[str], out: tuple[str, str, str] = ("lang_pred", "score", "rejected")) -> DataFrame:
    """The columns ``keep`` with the predicted language, its calibrated probability and whether it is rejected."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # buckets x labels numbers: a fixed size
    letters_in = common.fresh(docs, "__letters")
    source = docs.select(*keep, *([] if "text" in keep else ["text"]), F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False)).alias(letters_in))
    kept = [f for f in source.schema.fields if f.name in keep]
    schema = T.StructType([*kept, T.StructField(out[0], T.StringType()), T.StructField(out[1], T.DoubleType()), T.StructField(out[2], T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        rows = m.logits.astype(np.float32)
        for batch in common.small_batches(batches):
            data, offsets = common.text_bytes(batch.column("text"))
            letters = batch.column(letters_in).to_numpy(zero_copy_only=False).astype(bool)
            if m.labels:
                mean, _ = grams.mean_rows(FOLD[data], offsets, ORDERS, rows)
                p = softmax((mean + m.bias) / m.temperature)
                best, score = p.argmax(axis=1), np.where(letters, p.max(axis=1), 0.0)
            else:
                letters, best, score = np.zeros(len(letters), bool), np.zeros(len(letters), int), np.zeros(len(letters))
            names = pa.array([m.labels[k] if ok else "und" for k, ok in zip(best, letters)], pa.string())
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in kept], names, pa.array(score, pa.float64()), pa.array(~letters | (score < m.least))], names=schema.names)

    return source.mapInArrow(run, schema)


def identify(docs: DataFrame, held_out: Column, keep: list[str], per_label: int = 600) -> DataFrame:
    """Train on the labelled rows that are not held out, then predict every row."""
    return predict(docs, fit(training_rows(docs, ~held_out, per_label)), keep)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = common.key_bucket(F.col("doc_id"), 5) == 0
    return identify(docs, held, ["doc_id"]).select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; the rejected go."""
    names = docs.columns
    held = common.key_bucket(F.col("doc_id"), 5) == 0
    model = fit(training_rows(docs.select("doc_id", "text", "lang"), ~held, 600))
    lang, score, rejected = (common.fresh(docs, n) for n in ("__lang", "__score", "__rejected"))
    return predict(docs, model, names, (lang, score, rejected)).where(~F.col(rejected)).select(*names)
