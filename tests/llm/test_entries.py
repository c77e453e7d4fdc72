"""Every query and stage as registered: on odd and empty tables with clashing columns, and on the given ones against brute force."""

import hashlib
import json
import math
import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import langid, pieces, queries, telephony, toxicity

DATA = "/root/testdata/sf0.001"
given = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
CLASH = ["key", "node", "fp", "comp", "bands", "shard", "slot", "size", "score", "ids", "h", "s", "k", "place", "level", "position", "rate", "bad", "site", "host", "copy", "start", "text_crc32", "held_out", "lang_pred", "predicted", "feature", "rejected", "block", "part", "v", "d", "g", "rank", "index", "row", "id", "cell", "hash", "__n", "__k", "__score", "__fp", "__letters", "__toxicity"]
#: Columns that every query has at least, and the number of rows it gives for n rows of its table (None: tested apart).
CONTRACT = {
    "op1_near_duplicates": ("doc_id class_id", "documents"), "op2_sharding": ("doc_id size text_crc32 law shard slot grown_shard", "documents"), "op3_tool_calls": ("conv_id turn kind call_id level position status line", None),
    "op4_language_id": ("doc_id held_out lang_pred score", "documents"), "op5_url_filter": ("page_id host path rule verdict", "pages"), "op6_nearest": ("query_id rank vec_id score", None),
    "op7_sentencepiece": ("doc_id ids exact", "documents"), "op8_toxicity": ("doc_id held_out score predicted", "documents"),
    "op9_telephony": ("doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature", "documents"), "op10_mixing": ("doc_id size source_size target taken", "documents"),
    "op11_collocations": ("lang rank phrase a l r n score", None), "op12_linked": ("vec_id n_links component_id kept", "embeddings"), "op13_manifest": ("doc_id leaf subroot root proof_sha256 folded_root verified", "documents"),
}


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    docs = [
        (1, "one two three four five six seven", "en", "a", 5), (1, "one two three four five six seven", "en", "a", 5), (None, "one two three four five six seven", "en", None, None), (1, "another text under the same id", "en", "a", 6),
        (2, None, None, None, None), (3, "", "en", "b", 0), (4, " \n\t ", "de", "b", 4), (5, "kurz", "de", None, 5), (6, "12 34 !!", "fr", "c", 8), (7, "word " * 60_000, "en", "a", 300_000), (8, "x" * 50_000, "en", "b", 9), (9, "ünï ▁ 😀 x", None, "b", 9), (10, None, "de", "b", None),
    ]
    tables = {
        "documents": (docs, "doc_id long, text string, lang string, source string, n_chars long"),
        "labels": ([(1, 1, 0), (1, 1, 1), (None, 0, 1), (3, None, None), (5, 0, 0), (6, 1, None), (77, 0, 1)], "doc_id long, quality int, toxic int"),
        "pages": ([(1, "http://A.net/x", "h"), (1, "http://A.net/x", "h"), (2, None, None), (None, "no scheme", ""), (3, "http://u@10.0.0.1:80/y?z", None), (5, "http://" + "a." * 20_000 + "org/fr/", "")], "page_id long, url string, html string"),
        "conversations": ([(1, 0, "user", "hello"), (1, 0, "user", "hello"), (1, 1, "assistant", "hi"), (1, 2, "user", None), (None, None, None, None), (2, 1, "assistant", "orphan"), (3, None, "user", "x" * 100_000)], "conv_id long, turn long, role string, text string"),
        "embeddings": ([(0, [1.0, 2.0], 0), (0, [1.0, 2.0], 0), (100, None, 1), (200, [1.0, 2.5], None), (None, [1.0, 1.0], 0), (3, [0.0, 0.0], 1), (4, [None, 1.0], 1), (5, [1.0, 2.0, 3.0], 1)], "vec_id long, embedding array<float>, label int"),
    }
    out = {}
    for kind in ("odd", "empty"):
        out[kind] = str(tmp_path_factory.mktemp(kind))
        for name, (rows, schema) in tables.items():
            df = spark.createDataFrame(rows, schema)
            for c in CLASH:
                if c not in df.columns:
                    df = df.withColumn(c, F.lit("clash"))
            df = df.withColumn("mapped", F.create_map(F.lit("a"), F.lit(1)))
            (df if kind == "odd" else df.where("false")).write.parquet(f"{out[kind]}/{name}.parquet")
    out["sizes"] = {name: len(rows) for name, (rows, _) in tables.items()}
    return out


@pytest.mark.parametrize("name", sorted(CONTRACT))
def test_odd_and_empty_tables(spark, folders, name):
    columns, table = CONTRACT[name]
    odd = queries.QUERIES[name](spark, folders["odd"])
    assert set(columns.split()) <= set(odd.columns)
    n = len(odd.collect())
    assert n == folders["sizes"][table] if table else n > 0
    assert queries.QUERIES[name](spark, folders["empty"]).collect() == []


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_on_odd_and_empty_tables(spark, folders, name, stage):
    docs = spark.read.parquet(f"{folders['odd']}/documents.parquet")
    got = stage(spark, docs, folders["odd"])
    assert got.columns == ([c for c in docs.columns if c != "ids"] + ["ids", "exact"] if name == "sentencepiece" else docs.columns)
    assert {r.doc_id for r in got.collect()} <= {r.doc_id for r in docs.collect()}
    empty = spark.read.parquet(f"{folders['empty']}/documents.parquet")
    assert stage(spark, empty, folders["empty"]).collect() == []


def rows_of(spark, name):
    return [r.asDict() for r in queries.QUERIES[name](spark, DATA).collect()]


@pytest.fixture(scope="module")
def documents(spark):
    return [r.asDict() for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]


def bucket(doc_id, n):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % n


@given
def test_sharding_equals_brute_force(spark, documents):
    def shard(doc_id, n):
        point = lambda i: (int(hashlib.md5(f"{doc_id}:{i}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48
        return max(range(n), key=lambda i: (-1 / math.log(point(i)), -i))

    want = Counter()
    for r in documents:
        raw = (r["text"] or "").encode()
        want[(r["doc_id"], len(raw) + 1, zlib.crc32(raw), "key", shard(r["doc_id"], 8), shard(r["doc_id"], 9))] += 1
    got = rows_of(spark, "op2_sharding")
    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["law"], r["shard"], r["grown_shard"]) for r in got) == want
    by_shard = defaultdict(list)
    for r in got:
        by_shard[r["shard"]].append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in by_shard.values())
    assert all(r["grown_shard"] in (r["shard"], 8) for r in got)


@given
def test_telephony_equals_brute_force(spark, documents):
    texts = {r["doc_id"]: r["text"] for r in documents}
    got = rows_of(spark, "op9_telephony")
    assert len(got) == len(documents)
    for r in got:
        raw = (texts[r["doc_id"]] or "").encode()
        payload = raw + b" " * ((-len(raw)) % 192 or (0 if raw else 192))
        codec = telephony.CODECS[zlib.crc32(payload) % 3]
        media = telephony.store(codec, payload)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest()) and r["feature"].startswith(codec)


@given
def test_neighbours_recall_on_the_given_table(spark):
    rows = [r for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect() if r.embedding is not None]
    x, ids = np.array([r.embedding for r in rows], float), np.array([r.vec_id for r in rows])
    got = defaultdict(list)
    for r in rows_of(spark, "op6_nearest"):
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == {i for i in ids.tolist() if i % 100 == 0}
    hits = 0
    for q, found in got.items():
        far = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
        order = [i for i in np.lexsort((ids, far)) if ids[i] != q][:10]
        assert [r for r, *_ in sorted(found)] == list(range(1, 11)) and all(abs(far[ids == v][0] - s) < 1e-12 for _, v, s in found)
        hits += len({v for _, v, _ in found} & set(ids[order].tolist()))
    assert hits / (10 * len(got)) >= 0.9


@given
def test_language_equals_a_scalar_scorer(spark, documents):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang")
    held = langid.common.key_bucket(F.col("doc_id"), 5) == 0
    model = langid.fit(langid.training_rows(docs, ~held, 600))
    got = {r["doc_id"]: r for r in rows_of(spark, "op4_language_id")}
    right = total = 0
    for r in documents:
        out, text = got[r["doc_id"]], r["text"]
        assert out["held_out"] == (bucket(r["doc_id"], 5) == 0) and 0 <= out["score"] <= 1
        if text is None or not any(c.isalpha() for c in text):
            assert out["lang_pred"] == "und"
            continue
        ids, share = langid.features(text.encode(), len(model.logits))
        p = langid.softmax(((share.astype(float) @ model.logits[ids] + model.bias) / model.temperature)[None])[0]
        assert abs(p.max() - out["score"]) < 1e-3 and (out["lang_pred"] == model.labels[int(p.argmax())] or abs(np.sort(p)[-1] - np.sort(p)[-2]) < 1e-3)
        if out["held_out"] and r["lang"] is not None and len(text) > 40:
            right, total = right + (out["lang_pred"] == r["lang"]), total + 1
    assert total == 0 or right / total >= 0.9


def by_hand(model, text):
    """A text's toxicity, word by word: the mean of the table's values over the word's n-grams with a blank on each side, the greatest of them, a logistic curve."""
    folded = "".join(chr(c + 32) if 65 <= c <= 90 else chr(c) if chr(c).isalnum() and c < 128 or c >= 128 else " " for c in (text or "").encode())
    best = None
    for word in folded.split(" "):
        if not word:
            continue
        padded, values = f" {word} ", []
        for n in range(3, 7):
            for i in range(len(padded) - n + 1):
                h = 0
                for k, c in enumerate(padded[i : i + n]):
                    h = ((h ^ ord(c)) * 16777619) & 0xFFFFFFFF
                    h ^= h >> 13
                values.append(model.grams[((h * (2654435769 + 2 * n)) & 0xFFFFFFFF) >> (32 - len(model.grams).bit_length() + 1)])
        value = sum(values) / len(values)
        best = value if best is None else max(best, value)
    return 0.0 if best is None else 1 / (1 + math.exp(-max(-30, min(30, best + model.bias))))


@given
def test_toxicity_equals_a_score_by_hand(spark, documents):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    model = toxicity.train(spark, docs, DATA)
    got = {r["doc_id"]: r for r in rows_of(spark, "op8_toxicity")}
    assert len(got) == len(documents)
    for r in documents:
        out = got[r["doc_id"]]
        assert out["held_out"] == (bucket(r["doc_id"], 4) == 2) and out["predicted"] == int(out["score"] >= 0.3)
    # A word at a text's end has no blank beyond it, so these texts have one on either side.
    padded = spark.createDataFrame([(r["doc_id"], " " + (r["text"] or "") + " ") for r in documents[:100]], "doc_id long, text string")
    for r in toxicity.score(padded, model, ["doc_id", "text"]).collect():
        assert abs(by_hand(model, r.text) - r.score) < 1e-5


@given
def test_near_duplicates_lose_no_link(spark):
    """Every id divisible by 4 against all rows: no pair at a probability Jaccard of 0.8 or more lies in two classes."""
    folder = "/root/testdata/sf0.01"
    rows = [r for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect() if r.text]
    comp = {r.doc_id: r.class_id for r in queries.QUERIES["op1_near_duplicates"](spark, folder).collect()}

    def bag(text):
        words = re.findall(r"[^\x20\x09-\x0d]+", text)
        return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()

    def jaccard(a, b):
        """The sum over shared x of 1 / (the sum over y of max(a[y] / a[x], b[y] / b[x]))."""
        names = list(a.keys() | b.keys())
        x, y = np.array([a[n] for n in names], float), np.array([b[n] for n in names], float)
        both = np.flatnonzero((x > 0) & (y > 0))
        return sum(1 / np.maximum(x / x[i], y / y[i]).sum() for i in both)

    bags = {r.doc_id: bag(r.text) for r in rows}
    holders = defaultdict(set)
    for ident, b in bags.items():
        for x in b:
            holders[x].add(ident)
    links = lost = 0
    for ident in (i for i in bags if i % 4 == 0):
        shared = Counter(other for x in bags[ident] for other in holders[x] if other != ident)
        for other, n in shared.items():
            if n > 0 and jaccard(bags[ident], bags[other]) >= 0.8 + 1e-9:
                links, lost = links + 1, lost + (comp[ident] != comp[other])
    assert links > 15 and lost == 0


@given
def test_pieces_of_the_given_table(spark, documents):
    vocabulary = pieces.load()
    got = {r["doc_id"]: r for r in rows_of(spark, "op7_sentencepiece")}
    for r in documents:
        out = got[r["doc_id"]]
        assert (out["ids"] is None and r["text"] is None) or (out["exact"] and pieces.decode(out["ids"], vocabulary) == r["text"])


@given
def test_lines_are_canonical(spark):
    for r in rows_of(spark, "op3_tool_calls"):
        assert json.dumps(json.loads(r["line"]), sort_keys=True, separators=(",", ":"), ensure_ascii=False) == r["line"]
