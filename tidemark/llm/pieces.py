"""SentencePiece encoding and decoding by shared-prefix Viterbi.

A text is a blank (the dummy prefix) and its characters; it is cut into marked words, each a run
of blanks with the characters up to the next blank.  No piece of the vocabulary crosses such a
cut, so the best segmentation of a text is that of its words.  The distinct words of a batch are
sorted, which lays their trie out depth-first: a word keeps the forward scores, back pointers and
open vocabulary nodes of the prefix that it shares with the word before, and only walks the rest.
The segmentation maximises the sum of the pieces' log probabilities; of equal ones the longest
last piece wins.  A unigram model has them as scores.  A BPE model only ranks its pieces (scores
0, -1, -2, ...); there a piece of rank r counts as likely as Zipf's law says, in proportion to 1 / (r + 2).  A character that is no piece becomes its UTF-8 bytes, at the least score less 10.

Decoding joins pieces and bytes and drops the dummy prefix: every text comes back exactly,
literal U+2581 included (it is written as bytes).  Null stays null; the empty text has no pieces.
Words over 64 characters aren't cached.  Words over 4,096, such as very long texts without blanks, are walked alone and
keep a score, a length and an id for each character, 16 bytes, instead of shared nodes.

Ties go to the longest last piece.  Repeated rows each get a row.  An empty table gives an empty result.  Other
columns are ignored, whatever their names, unless they are asked for; the stage hands them on, but for ``ids`` and
``exact``, which it writes anew.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tidemark.llm import common

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
WORD = re.compile(" *[^ ]+| +$")
CACHE_WORDS, CACHE_CHARS, LONG_CHARS = 400_000, 64, 4096


@dataclass
class Vocabulary:
    """piece: (id, score); bytes: the id of each byte; text: what each id decodes to."""

    pieces: dict[str, tuple[int, float]]
    byte_ids: list[int]
    text: dict[int, bytes]
    trie: list = field(default=None, repr=False)
    unknown: float = 0.0

    def grow(self) -> None:
        """The trie of the pieces: a node is [children, id, score]."""
        self.trie = [{}, -1, 0.0]
        for piece, (ident, score) in self.pieces.items():
            node = self.trie
            for c in piece:
                node = node[0].setdefault(c, [{}, -1, 0.0])
            node[1], node[2] = ident, score
        self.unknown = min((s for _, s in self.pieces.values()), default=0.0) - 10.0


def load(path: str = MODEL) -> Vocabulary:
    """Read a vocabulary of some ten thousand pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    plain = [i for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    pieces = {model.id_to_piece(i).replace(MARK, " "): (i, model.get_score(i)) for i in plain}
    if any(re.search("[^ ] ", p) for p in pieces) or not all(model.is_byte(i) for i in byte_ids):
        raise ValueError("the vocabulary has pieces that cross words, or lacks bytes")
    scores = np.array([s for _, s in pieces.values()])
    if (scores <= 0).all() and (scores == np.round(scores)).all():
        total = float(np.log((1 / (2.0 - scores)).sum()))
        pieces = {p: (i, -float(np.log(2.0 - s)) - total) for p, (i, s) in pieces.items()}
    text = {i: p.encode() for p, (i, _) in pieces.items()} | {i: bytes([b]) for b, i in enumerate(byte_ids)}
    return Vocabulary(pieces, byte_ids, text)


def segment(words: list[str], vocabulary: Vocabulary) -> Iterator[tuple[str, list[int]]]:
    """(word, ids) for sorted distinct words, each reusing what it shares with the one before."""
    root, unknown, byte_ids = vocabulary.trie, vocabulary.unknown, vocabulary.byte_ids
    first = root[0]
    best, back, ident, open_ = [0.0], [0], [0], [[]]
    before = ""
    for word in words:
        shared = 0
        for x, y in zip(word, before):
            if x != y:
                break
            shared += 1
        del best[shared + 1 :], back[shared + 1 :], ident[shared + 1 :], open_[shared + 1 :]
        nodes = open_[shared]
        for i in range(shared, len(word)):
            c = word[i]
            alive, top, at, piece = [], -1e300, i, -1
            for start, node in nodes:
                node = node[0].get(c)
                if node is not None:
                    alive.append((start, node))
                    if node[1] >= 0:
                        score = best[start] + node[2]
                        if score > top:
                            top, at, piece = score, start, node[1]
            node = first.get(c)
            if node is not None:
                alive.append((i, node))
            if node is None or node[1] < 0:
                score = best[i] + unknown
                if score > top:
                    top, at, piece = score, i, -1
            else:
                score = best[i] + node[2]
                if score > top:
                    top, at, piece = score, i, node[1]
            best.append(top)
            back.append(at)
            ident.append(piece)
            open_.append(alive)
            nodes = alive
        before = word
        ids, end = [], len(word)
        while end:
            if ident[end] >= 0:
                ids.append(ident[end])
            else:
                ids.extend(byte_ids[b] for b in reversed(word[end - 1].encode()))
            end = back[end]
        ids.reverse()
        yield word, ids


def segment_long(word: str, vocabulary: Vocabulary) -> array:
    """The same segmentation of one long word, in arrays."""
    first, unknown, byte_ids = vocabulary.trie[0], vocabulary.unknown, vocabulary.byte_ids
    best, size, ident, nodes = array("d", [0.0]), array("i", [0]), array("i", [0]), []
    for i, c in enumerate(word):
        alive, top, at, piece = [], -1e300, i, -1
        for start, node in nodes:
            node = node[0].get(c)
            if node is not None:
                alive.append((start, node))
                if node[1] >= 0 and best[start] + node[2] > top:
                    top, at, piece = best[start] + node[2], start, node[1]
        node = first.get(c)
        if node is not None:
            alive.append((i, node))
        score, one = (best[i] + unknown, -1) if node is None or node[1] < 0 else (best[i] + node[2], node[1])
        if score > top:
            top, at, piece = score, i, one
        best.append(top)
        size.append(i + 1 - at)
        ident.append(piece)
        nodes = alive
    ids, end = array("i"), len(word)
    while end:
        if ident[end] >= 0:
            ids.append(ident[end])
        else:
            ids.extend(byte_ids[b] for b in reversed(word[end - 1].encode()))
        end -= size[end]
    ids.reverse()
    return ids


def encode(texts: list[str | None], vocabulary: Vocabulary, cache: dict[str, list[int]]) -> list[list[int] | None]:
    """Ids of every text; ``cache`` keeps words between calls and is bounded."""
    if vocabulary.trie is None:
        vocabulary.grow()
    cut = [WORD.findall(f" {t}") if t else [] for t in texts]
    fresh = set(chain.from_iterable(cut)).difference(cache)
    if len(cache) + len(fresh) > CACHE_WORDS:
        cache.clear()
        fresh = set(chain.from_iterable(cut))
    long = {w for w in fresh if len(w) > LONG_CHARS}
    cache.update(segment(sorted(fresh - long), vocabulary))
    cache.update((w, segment_long(w, vocabulary)) for w in long)
    out = [None if t is None else list(chain.from_iterable(map(cache.__getitem__, words))) for t, words in zip(texts, cut)]
    for word in fresh:
        if len(word) > CACHE_CHARS:
            del cache[word]
    return out


def decode(ids: list[int], vocabulary: Vocabulary) -> str:
    return b"".join(map(vocabulary.text.__getitem__, ids))[1:].decode()


def pieced(docs: DataFrame, vocabulary: Vocabulary, keep: list[str], out: tuple[str, str] = ("ids", "exact")) -> DataFrame:
    """The columns ``keep`` with the ids of the text and whether decoding them gave the text back."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # the vocabulary: a fixed size
    source = docs.select(*keep, *([] if "text" in keep else ["text"]))
    kept = [f for f in source.schema.fields if f.name in keep]
    schema = T.StructType([*kept, T.StructField(out[0], T.ArrayType(T.IntegerType())), T.StructField(out[1], T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, cache = shared.value, {}
        for batch in common.small_batches(batches):
            texts = batch.column("text").to_pylist()
            ids = encode(texts, v, cache)
            exact = pa.array([None if t is None else decode(x, v) == t for t, x in zip(texts, ids)], pa.bool_())
            sizes = np.array([len(x or []) for x in ids])
            flat = pa.array(np.fromiter(chain.from_iterable(x or [] for x in ids), np.int32, int(sizes.sum())))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), flat, mask=pa.array([x is None for x in ids]))
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in kept], lists, exact], names=schema.names)

    return source.mapInArrow(run, schema)


def op7_sentencepiece(spark: SparkSession, sf_dir: str, model: str = MODEL) -> DataFrame:
    return pieced(common.table(spark, sf_dir, "documents").select("doc_id", "text"), load(model), ["doc_id"])


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, model: str = MODEL) -> DataFrame:
    """Every document with its ids."""
    return pieced(docs, load(model), [c for c in docs.columns if c not in ("ids", "exact")])
