"""Phrase collocations by the stripes pattern.

A stripe is a prefix of none to four words with an associative counter of the words that follow it.  A task keeps the stripes of
its texts and adds them up element by element; so are those of all tasks, which meet by prefix and, where a counter is long, by shares of it, so that a prefix which half of all text has is no single row.  What tasks add up is bounded, and its sums are added up by entry.  The entry of a word in a stripe is the count of the prefix and the word, hence the
total of the stripe that this longer prefix has; so merged stripes give the counts of all extensions, the totals of all prefixes and, as
the largest entry of a stripe and the largest entry that ends in the same words, how often a phrase is part of a longer one.

Phrases of 2, 3, 4 and 5 words are counted by hash before, each where its first and its last words but one are frequent, as those of every frequent
phrase are (of a pair, both words); those whose hash occurs ``least`` times enter the stripes, which have their words.  Tasks know what is frequent
by a bitmap of hashes of a fixed size, which may let others through, never stops one of them, and changes the work and not the counts.

Texts are lower-cased in A-Z, cut into pieces at . , ; : ! ? and line ends, and pieces into words at blanks and tabs.  A null
text has no words; a null language is ``und``.  Repeated rows count again, whatever their ids.  Very long texts are read whole, as a block of their own.
Ties of the score go to the more frequent phrase, then to the one that comes first in UTF-8 bytes; the lowest-scoring cut that is shortest counts.
No words give no rows.  Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm import common

LEAST, LONGEST, TOP = 100, 5, 2000
BITS = 1 << 26  # of the bitmap of a level: 8 MB, whatever the corpus
BITMAP = 32768  # bits of one row of Spark's bitmaps
BLOCK, SALTS = 2 << 20, 64
COUNTER, SHARES = 64, 16  # a longer counter is cut into so many shares
HELD = 1 << 19  # cells or pairs that a task holds, and those of a block, before it adds them up or hands them on

WORD, BLANK, BREAK = 0, 1, 2
KINDS = np.zeros(256, np.uint8)
KINDS[[0x20, 0x09]] = BLANK
KINDS[[*b".,;:!?\x0a\x0b\x0c\x0d"]] = BREAK
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


class Words:
    """The words of a block of texts: ``names`` and, for each word, which it is, the text's language and whether the next word follows in its piece."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        data, offsets = common.text_bytes(batch.column("text"))
        data = FOLD[data]
        kind = KINDS[data]
        inside = kind == WORD
        starts, ends = inside.copy(), inside.copy()
        starts[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        bounds = offsets[1:-1]
        bounds = bounds[(bounds > 0) & (bounds < len(data))]
        starts[bounds] |= inside[bounds]
        ends[bounds - 1] |= inside[bounds - 1]
        first, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        sizes = np.append(0, np.cumsum(end - first))
        array = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(sizes.astype(np.int64)), pa.py_buffer(data[inside])])
        coded = array.dictionary_encode()
        self.names = coded.dictionary.cast(pa.large_string())
        self.word = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        text = np.searchsorted(offsets, first, side="right") - 1
        piece = np.cumsum(kind == BREAK)[first] if len(first) else first
        self.joined = np.append((piece[1:] == piece[:-1]) & (text[1:] == text[:-1]), False)[: len(first)]
        langs = batch.column("lang").dictionary_encode()
        self.langs = langs.dictionary
        self.lang = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)[text]

    def hashes(self, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For 1 .. longest words: the hash of the phrase that starts at each word, with its language, and whether it lies in one piece."""
        word, lang = hashed(self.names)[self.word], hashed(self.langs)[self.lang]
        n, h, whole = len(word), common.mix64(lang + word), np.ones(len(word), bool)
        yield h, whole
        for k in range(1, longest):
            h, whole = h.copy(), whole.copy()
            whole[: n - k] &= self.joined[k - 1 : n - 1]
            whole[n - k :] = False
            h[: n - k] = common.mix64(h[: n - k] * np.uint64(31) + word[k:])
            yield h, whole

    def phrases(self, at: np.ndarray, k: int) -> pa.Array:
        """The k words from each place on, joined by blanks."""
        parts = [self.names.take(pa.array(self.word[at + j])) for j in range(k)]
        return (pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string())) if k > 1 else parts[0]).cast(pa.string())

    def ids(self, at: np.ndarray, k: int) -> np.ndarray:
        """Equal numbers for equal (language, k words)."""
        out = self.lang[at] * len(self.names) + self.word[at]
        for j in range(1, k):
            out = np.unique(out, return_inverse=True)[1] * len(self.names) + self.word[at + j]
        return out


def hashed(names: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string."""
    import pandas as pd

    return pd.util.hash_array(np.array(names.to_pylist(), object), categorize=False) if len(names) else np.zeros(0, np.uint64)


def slots(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64(BITS - 1)).astype(np.int64)


def known(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = slots(h)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, f) of (text, lang): the stripe of the empty prefix, entry by entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.small_batches(batches, max_bytes=BLOCK):
            words = Words(batch)
            ids, count = np.unique(words.lang * max(len(words.names), 1) + words.word, return_counts=True)
            lang, word = np.divmod(ids, max(len(words.names), 1))
            yield pa.RecordBatch.from_arrays([words.langs.take(pa.array(lang)), words.names.take(pa.array(word)).cast(pa.string()), pa.array(count)], names=["lang", "word", "c"])

    parts = docs.mapInArrow(run, "lang string, word string, c long")
    return parts.groupBy("lang", "word").agg(F.sum("c").alias("f"))


def word_slots(words: DataFrame) -> DataFrame:
    """(slot): where the bitmap has the words of (lang, word)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = common.mix64(hashed(batch.column("lang")) + hashed(batch.column("word")))
            yield pa.RecordBatch.from_arrays([pa.array(slots(h))], names=["slot"])

    return words.select("lang", "word").mapInArrow(run, "slot long")


def longer_phrases(words: Words, k: int, prefixes: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Where phrases of k + 1 words start, and their hashes: those whose first k words and last k words are frequent by the bitmap (all, without one)."""
    h = good = longer = whole = None
    for pair in words.hashes(k + 1):
        (h, good), (longer, whole) = (longer, whole), pair
    if prefixes is not None:
        good = good & known(prefixes, h)
        whole = whole & good
        whole[:-1] &= good[1:]
    at = np.flatnonzero(whole)
    return at, longer[at]


def frequent_slots(docs: DataFrame, k: int, prefixes: np.ndarray | None, least: int) -> DataFrame:
    """(slot): where the bitmap has the phrases of k + 1 words that may be frequent and whose hash occurs ``least`` times or more.

    Hashes are dealt to tasks before Spark adds them up: most of a task's occur in one of its blocks only, which have counted them, so that
    a map of them all would take a task's memory and leave their number as it is.
    """
    shared = docs.sparkSession.sparkContext.broadcast(prefixes)

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        ids, count = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(ids.view(np.int64)), pa.array(count)], names=["h", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in common.small_batches(batches, max_bytes=BLOCK):
            words = Words(batch)
            if len(words.word) > k:
                held.append(longer_phrases(words, k, shared.value)[1])
            if sum(map(len, held)) > HELD:
                yield counted(held)
                held = []
        if held:
            yield counted(held)

    sums = docs.mapInArrow(run, "h long, c long").repartition("h").groupBy("h").agg(F.sum("c").alias("c"))
    return sums.where(F.col("c") >= least).select(F.col("h").bitwiseAND(BITS - 1).alias("slot"))


def bitmap(found: DataFrame) -> np.ndarray:
    """The bitmap of slots; ``BITS`` bits reach the driver, however many slots there are."""
    rows = found.groupBy((F.floor(F.col("slot") / BITMAP)).alias("part")).agg(F.bitmap_construct_agg(F.col("slot") % BITMAP).alias("bits")).collect()
    out = np.zeros(BITS // 8, np.uint8)
    for part, bits in rows:
        out[part * (BITMAP // 8) : part * (BITMAP // 8) + len(bits)] = np.frombuffer(bytes(bits), np.uint8)
    return out


class Stripes:
    """The stripes of a task, as cells (lang, prefix, word, count); equal ones are added up when there are many."""

    def __init__(self) -> None:
        self.parts: list[pa.Table] = []
        self.rows = 0

    def add(self, cells: pa.Table) -> None:
        self.parts.append(cells)
        self.rows += cells.num_rows
        if self.rows > HELD:
            self.parts = [self.merged()]
            self.rows = self.parts[0].num_rows

    def full(self) -> bool:
        """Whether there are many even when they are added up."""
        return len(self.parts) == 1 and self.rows > HELD // 2

    def merged(self) -> pa.Table:
        return pa.concat_tables(self.parts).group_by(["lang", "prefix", "word"]).aggregate([("count", "sum")]).rename_columns(["lang", "prefix", "word", "count"])

    def cells(self) -> Iterator[pa.RecordBatch]:
        """The cells, added up; none are held afterwards."""
        if self.parts:
            yield from self.merged().to_batches(max_chunksize=10_000)
        self.parts, self.rows = [], 0

    def taken(self) -> Iterator[pa.RecordBatch]:
        """The stripes, (lang, prefix, share, words, counts), of which those of more than ``COUNTER`` words are cut into shares by the words; none are held afterwards."""
        if self.parts:
            names = ["lang", "prefix", "share", "words", "counts"]
            cells = self.merged()
            lang, prefix, word = (cells[c].combine_chunks().dictionary_encode() for c in ("lang", "prefix", "word"))
            owner = lang.indices.to_numpy().astype(np.int64) * len(prefix.dictionary) + prefix.indices.to_numpy()
            _, stripe, size = np.unique(owner, return_inverse=True, return_counts=True)
            share = np.where(size[stripe] > COUNTER, (hashed(word.dictionary) % np.uint64(SHARES)).astype(np.int32)[word.indices.to_numpy()], 0)
            stripes = cells.append_column("share", pa.array(share, pa.int32())).group_by(names[:3]).aggregate([("word", "list"), ("count", "list")])
            yield from stripes.rename_columns(names).to_batches(max_chunksize=10_000)
        self.parts, self.rows = [], 0


def stripes(docs: DataFrame, frequent: list[np.ndarray]) -> DataFrame:
    """(lang, prefix, share, words, counts): the stripes of each task, with the words that make a frequent phrase by the bitmaps of phrases of 2, 3, .. words."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def cells(words: Words, k: int, at: np.ndarray) -> pa.Table:
        """The stripes of the prefixes of k words at these places."""
        wide = len(words.names)
        _, here, prefix = np.unique(words.ids(at, k), return_index=True, return_inverse=True)
        cell, count = np.unique(prefix * wide + words.word[at + k], return_counts=True)
        owner, word = np.divmod(cell, wide)
        first, take = at[here], pa.array(owner)
        return pa.table([words.langs.take(pa.array(words.lang[first])).take(take), words.phrases(first, k).take(take), words.names.take(pa.array(word)).cast(pa.string()), pa.array(count, pa.int64())], names=["lang", "prefix", "word", "count"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, bits = Stripes(), shared.value
        for batch in common.small_batches(batches, max_bytes=BLOCK):
            words = Words(batch)
            for k, (h, whole) in enumerate(words.hashes(min(len(bits) + 1, max(len(words.word), 1)))):
                if k:
                    at = np.flatnonzero(whole)
                    kept.add(cells(words, k, at[known(bits[k - 1], h[at])]))
            if kept.full():
                yield from kept.taken()
        yield from kept.taken()

    return docs.mapInArrow(run, "lang string, prefix string, share int, words array<string>, counts array<long>")


def merged(parts: DataFrame, least: int) -> DataFrame:
    """(lang, prefix, word, f): stripes added element by element; entries under ``least`` are left out, since no frequent phrase holds them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = Stripes()
        for batch in batches:
            words, owner = batch.column("words"), pc.list_parent_indices(batch.column("words"))
            kept.add(pa.table([batch.column("lang").take(owner), batch.column("prefix").take(owner), pc.list_flatten(words), pc.list_flatten(batch.column("counts"))], names=["lang", "prefix", "word", "count"]))
            if kept.full():
                yield from kept.cells()
        yield from kept.cells()

    met = parts.repartition("lang", "prefix", "share").mapInArrow(run, "lang string, prefix string, word string, count long")
    return met.groupBy("lang", "prefix", "word").agg(F.sum("count").alias("f")).where(F.col("f") >= least)


def mined(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """(cells, sizes): the frequent entries (lang, prefix, word, f) of the merged stripes of all prefixes under ``longest`` words, and the number ``n`` of words of each language.

    ``docs`` is (text, lang).
    """
    counts = common.staged(word_counts(docs), "words")
    sizes = counts.groupBy("lang").agg(F.sum("f").alias("n"))
    cells = counts.where(F.col("f") >= least).select("lang", F.lit("").alias("prefix"), "word", "f")
    if longest < 2:
        return cells, sizes
    frequent = [bitmap(word_slots(cells))]
    for k in range(1, longest):
        frequent.append(bitmap(frequent_slots(docs, k, frequent[-1], least)))
    return cells.unionByName(common.staged(merged(stripes(docs, frequent[1:]), least), "stripes")), sizes


def entries(cells: DataFrame) -> DataFrame:
    """(lang, phrase, prefix, f): the phrases that entries of stripes stand for."""
    phrase = F.when(F.col("prefix") == "", F.col("word")).otherwise(F.concat_ws(" ", "prefix", "word"))
    return cells.select("lang", phrase.alias("phrase"), "prefix", "f")


def subsumed(cells: DataFrame) -> DataFrame:
    """(lang, phrase, within): the most frequent phrase that has one word more, before or after.

    It is the largest entry of the phrase's own stripe, or of the entries whose words but the first are the phrase.
    """
    longer = entries(cells.where("prefix <> ''"))
    rest = F.expr("substring(phrase, instr(phrase, ' ') + 1)")
    both = longer.select("lang", F.col("prefix").alias("phrase"), "f").unionByName(longer.select("lang", rest.alias("phrase"), "f"))
    return both.groupBy("lang", "phrase").agg(F.max("f").alias("within"))


def scored(cells: DataFrame, sizes: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score, within) of every frequent phrase of two words and more, by its lowest-scoring cut.

    The score is floor(1000 a n / (l r)) in decimal arithmetic of 38 digits.
    """
    totals = entries(cells).select("lang", F.col("phrase").alias("part"), "f")
    phrases = entries(cells.where("prefix <> ''")).select("lang", "phrase", F.col("f").alias("a"))
    words = F.split("phrase", " ")
    cut = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.size(words) - 1)))
    cut = cut.withColumn("left", F.concat_ws(" ", F.slice(words, 1, F.col("k")))).withColumn("right", F.concat_ws(" ", F.slice(words, F.col("k") + 1, F.size(words))))
    cut = cut.join(totals.select("lang", F.col("part").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cut = cut.join(totals.select("lang", F.col("part").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    cut = cut.join(F.broadcast(sizes) if bounded(sizes) else sizes, "lang")
    exact = lambda c, digits: F.col(c).cast(f"decimal({digits},0)")
    cut = cut.withColumn("__top", (F.lit(1000).cast("decimal(4,0)") * exact("a", 17) * exact("n", 17)).cast("decimal(38,0)")).withColumn("__by", (exact("l", 19) * exact("r", 19)).cast("decimal(38,0)"))
    cut = cut.withColumn("score", F.expr("__top div __by"))
    best = cut.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))
    out = best.select("lang", "phrase", "a", "c.l", "c.r", "n", "c.score")
    return out.join(subsumed(cells), ["lang", "phrase"], "left")


def bounded(sizes: DataFrame, most: int = 1 << 16) -> bool:
    """Whether there are few enough languages to hand their sizes to every task."""
    return len(sizes.limit(most + 1).select("lang").collect()) <= most


def top_phrases(found: DataFrame, top: int) -> DataFrame:
    """The first ``top`` phrases of each language, with ``rank``: those of each of ``SALTS`` shares first, so that no task ranks a whole language."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    share = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    some = found.withColumn("share", share).withColumn("place", F.row_number().over(W.partitionBy("lang", "share").orderBy(*order))).where(F.col("place") <= top)
    return some.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top).drop("share", "place")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of (text, lang): phrases that aren't part of a longer one wherever they occur."""
    cells, sizes = mined(docs, least, longest)
    kept = scored(cells, sizes).where("within is null or within < a")
    return top_phrases(kept, top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return collocations(docs.select("text", F.coalesce("lang", F.lit("und")).alias("lang")))


ORACLE = """WITH pc AS (SELECT lang, row_number() OVER () AS pid, w FROM (SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')), '[^\\x20\\x09]+') AS w
    FROM (SELECT coalesce(lang, 'und') AS lang, text FROM documents))),
ph AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pc), range(1, 6) t(k) WHERE i + k - 1 <= len(w)),
nn AS (SELECT lang, count(*) AS n FROM ph WHERE k = 1 GROUP BY lang),
fr AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM ph GROUP BY lang, k, phrase HAVING count(*) >= 100),
cd AS MATERIALIZED (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM fr WHERE k >= 2),
ct AS (SELECT cd.lang, cd.phrase, a, j, array_to_string(w[:j], ' ') AS lp, array_to_string(w[j + 1:], ' ') AS rp FROM cd, range(1, 5) t(j) WHERE j < cd.k),
sc AS (SELECT ct.lang, ct.phrase, a, j, x.f AS l, y.f AS r, n, CAST((1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f) AS BIGINT) AS score FROM ct JOIN fr x ON x.lang = ct.lang AND x.phrase = lp JOIN fr y ON y.lang = ct.lang AND y.phrase = rp JOIN nn ON nn.lang = ct.lang),
bs AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
sb AS (SELECT DISTINCT s.lang, s.phrase FROM (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, a FROM cd, range(1, 6) t(i), range(2, 5) u(m) WHERE m < k AND i + m - 1 <= k) s JOIN fr ON fr.lang = s.lang AND fr.phrase = s.phrase AND s.a >= fr.f)
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT bs.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, CAST(phrase AS BLOB)) AS rank FROM bs ANTI JOIN sb ON sb.lang = bs.lang AND sb.phrase = bs.phrase) WHERE rank <= 2000"""
