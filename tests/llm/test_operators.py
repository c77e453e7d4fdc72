"""Each operator on small tables with nulls, empties, repeats and clashing names, and against brute force."""

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import chat, langid, mixing, neardup, neighbours, pieces, sharding, shingles, telephony, toxicity, urls

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(draw, n):
    return " ".join(draw.choice(WORDS) + str(draw.randrange(40)) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty, blank and long texts, repeated rows."""
    rows = [
        (1, "one two three four five six", "en", "a", 5), (1, "one two three four five six", "en", "a", 5), (None, "one two three four five six", "en", None, None),
        (2, None, None, None, None), (3, "", "en", "b", 0), (4, " \n\t ", "de", "b", 4), (5, "short", "de", None, 5), (6, "12 34 !!", "fr", "c", 8), (7, "word " * 60_000, "en", "a", 300_000), (8, "ünï ▁ 😀\x00 x", None, "b", 9),
    ]
    return spark.createDataFrame(rows, DOCS).withColumns({"key": F.lit("k"), "node": F.lit(1), "fp": F.lit("f"), "shard": F.lit("s"), "slot": F.lit(0), "size": F.lit("x"), "score": F.lit("y"), "ids": F.lit("z")})


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


def count(df):
    return len(df.collect())


# --- 1 -------------------------------------------------------------------------------------------


def weights(text):
    w = text.split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def jp(a, b):
    a, b = weights(a), weights(b)
    if not a.keys() & b.keys():
        return 0.0
    return sum(1 / sum(max(a[j] / a[i], b[j] / b[i]) for j in a.keys() | b.keys()) for i in a.keys() & b.keys())


def near_corpus():
    draw = random.Random(3)
    texts = [prose(draw, draw.randrange(5, 150)) for _ in range(40)]
    for t in texts[:15]:
        w = t.split()
        for cut in (1, 2, 9):
            x = w[:]
            for _ in range(cut):
                x[draw.randrange(len(x))] = "changed" + str(draw.randrange(99))
            texts.append(" ".join(x))
    base = prose(draw, 200).split()
    for _ in range(25):  # siblings of one text that are less alike than each is to it
        x = base[:]
        for k in draw.sample(range(0, 200, 6), 3):
            x[k] = "s" + str(draw.randrange(999))
        texts.append(" ".join(x))
    texts.append(" ".join(base))
    return texts + texts[:5]


@pytest.mark.parametrize("block", [neardup.BLOCK, 3])
def test_near_duplicates_equal_brute_force(spark, block):
    texts = near_corpus()
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.comp for r in neardup.classified(docs, block=block).collect()}
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        if texts[i] == texts[j] or jp(texts[i], texts[j]) >= 0.8:
            parent[root(i)] = root(j)
    want, have = {}, {}
    for i in range(len(texts)):
        want.setdefault(root(i), set()).add(i)
        have.setdefault(got[i], set()).add(i)
    assert sorted(map(sorted, want.values())) == sorted(map(sorted, have.values()))


def test_repeated_ids_do_not_join_classes(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(30)) for c in "ab")
    docs = spark.createDataFrame([(1, a), (1, b), (2, b), (3, a)], "doc_id long, text string")
    rows = neardup.classified(docs).collect()
    assert sorted(sorted(r.doc_id for r in rows if r.comp == c) for c in {r.comp for r in rows}) == [[1, 2], [1, 3]]


def test_links_between_short_texts_are_all_compared(spark):
    draw = random.Random(11)
    texts = []
    for k in range(600):  # 8 words and the same with a ninth: 4 of 5 shingles, 0.8 exactly
        words = [f"w{k}x{draw.randrange(10**6)}" for _ in range(9)]
        texts += [(2 * k, " ".join(words[:8])), (2 * k + 1, " ".join(words))]
    docs = spark.createDataFrame(texts, "node long, text string")
    bands = {int(r.fp): r.bands for r in neardup.banded(docs.select(F.col("node").cast("string").alias("fp"), "text")).collect()}
    shared = {k: [x for x, y in zip(bands[2 * k], bands[2 * k + 1]) if x == y] for k in range(600)}
    rows = [(keys[0], 2, 2 * k + i, 2 * k + i, bands[2 * k + i]) for k, keys in shared.items() if keys for i in (0, 1)]
    members = spark.createDataFrame(rows, "key long, n long, node long, comp long, bands array<long>").join(neardup.sketches(docs), "node")
    got = {(r.a, r.b) for r in neardup.across(members).collect()}
    assert len(rows) > 1190 and got == {(r[2], r[2] + 1) for r in rows if r[2] % 2 == 0}


def test_a_stray_member_does_not_multiply_its_bucket(spark):
    base = [f"w{i}" for i in range(60)]
    texts = [(i, " ".join([*base, f"x{i}"])) for i in range(300)]
    docs = spark.createDataFrame(texts, "node long, text string")
    bands = {int(r.fp): r.bands for r in neardup.banded(docs.select(F.col("node").cast("string").alias("fp"), "text")).collect()}
    band, (key, _) = max(((k, Counter(b[k] for b in bands.values()).most_common(1)[0]) for k in range(40)), key=lambda x: x[1][1])
    inside = sorted(n for n, b in bands.items() if b[band] == key)
    stray, second = inside[:1], inside[1:6]
    rows = [(key, len(inside), n, n if n in stray else 1000 if n in second else 2000, bands[n]) for n in inside]
    members = spark.createDataFrame(rows, "key long, n long, node long, comp long, bands array<long>").join(neardup.sketches(docs), "node")
    assert len(inside) > 150
    assert neardup.meetings(members, 8).count() <= 3 * len(inside)
    first = {(r.a, r.b) for r in neardup.across(members, block=8).collect()}
    comp = {r[2]: r[3] for r in rows}
    shares = lambda a, b: any(x == y for x, y in zip(bands[a][:band], bands[b][:band]))
    assert first == {(a, b) for a, b in itertools.combinations(inside, 2) if comp[a] != comp[b] and not shares(a, b)}


def templated(share, n=64, words=60):
    """Texts of one template, of which ``share`` of each is its own; every eighth is a near copy of the one before it."""
    draw, out = random.Random(5), []
    base = [f"w{i}" for i in range(words)]
    for k in range(n):
        if k % 8 == 7:
            out.append(out[-1] + " end")
        else:
            out.append(" ".join(base + [f"u{draw.randrange(10**9)}" for _ in range(int(words * share / (1 - share)))]))
    return out


@pytest.mark.parametrize("share, stays", [(0.3, False), (0.15, True)])
def test_templates_are_thinned_without_losing_a_link(spark, share, stays):
    texts = templated(share)
    docs = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    bands = neardup.banded(docs.select(F.col("node").cast("string").alias("fp"), "text"))
    members = bands.select(F.explode("bands").alias("key"), F.col("fp").cast("long").alias("node"), F.col("fp").cast("long").alias("comp"), F.lit(99).alias("others"))
    got = neardup.thinned(members, docs, block=16).collect()
    if not stays:  # only near copies meet
        assert 16 <= len(got) <= 4 * len(texts) and members.count() == 40 * len(texts)
    meet = {}
    for r in got:
        meet.setdefault(r.key, set()).add(r.node)
    for i, j in itertools.combinations(range(len(texts)), 2):
        if jp(texts[i], texts[j]) >= 0.8:
            assert any({i, j} <= m for m in meet.values()), (i, j)
    assert all(jp(texts[i - 1], texts[i]) >= 0.8 for i in range(7, len(texts), 8))


def test_signatures_estimate_probability_jaccard():
    a, b = "a b c d e f g h i j k l m n o p q r s t u v w x y z " * 2, "a b c d e f g h i j k l m n o p q r s t u v w x y z a b c k l m n o p"
    data = np.frombuffer((a + b).encode(), np.uint8)
    offsets = np.array([0, len(a), len(a) + len(b)])
    t, s, w = shingles.weighted_shingles(data, offsets)
    sig = shingles.signatures(t, s, w, 2, 4096)
    i, j = t == 0, t == 1
    exact = shingles.probability_jaccard(s[i], w[i], s[j], w[j])
    assert math.isclose(exact, jp(a, b), rel_tol=1e-9)
    assert abs((sig[0] == sig[1]).mean() - exact) < 0.03


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 201), (201, 202), (202, 200)]
    random.Random(1).shuffle(edges)
    got = {}
    for r in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect():
        got.setdefault(r.comp, set()).add(r.node)
    assert sorted(map(len, got.values())) == [3, 30, 41]


def test_near_duplicates_of_odd_rows(odd, none, spark):
    rows = neardup.classified(odd).collect()
    assert len(rows) == odd.count()
    assert len({r.comp for r in rows if r.doc_id in (1, None)}) == 1 and all(r.comp is None for r in rows if r.doc_id in (2, 3, 4))
    assert count(neardup.classified(none)) == 0 and count(neardup.near_duplicate_stage(spark, none, "")) == 0
    kept = neardup.near_duplicate_stage(spark, odd, "")
    assert kept.columns == odd.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["2", "3", "4", "5", "6", "7", "8", "None"]


# --- 2 -------------------------------------------------------------------------------------------


def shard(key, weights):
    points = [(int(hashlib.md5(f"{key}:{i}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48 for i in range(len(weights))]
    return max(range(len(weights)), key=lambda i: (-weights[i] / math.log(points[i]), -i))


def test_shards(spark):
    rows = spark.range(4000).select(F.col("id").alias("doc_id"))
    got = sharded = sharding.sharded(rows, "doc_id", [1.0, 2.0, 1.0]).collect()
    assert all(r.shard == shard(r.doc_id, [1.0, 2.0, 1.0]) for r in got)
    sizes = Counter(r.shard for r in sharded)
    assert abs(sizes[1] - 2000) < 150
    grown = {r.doc_id: r.shard for r in sharding.sharded(rows, "doc_id", [1.0, 2.0, 1.0, 1.0]).collect()}
    moved = [r for r in got if grown[r.doc_id] != r.shard]
    assert all(grown[r.doc_id] == 3 for r in moved) and abs(len(moved) - 800) < 120


def test_slots_are_gapless(odd, none):
    rows = sharding.sharded(odd.select("doc_id", "text"), "doc_id", [1.0] * 8)
    out = sharding.slots(rows, "shard", ["doc_id", "text"]).collect()
    assert len(out) == odd.count()
    for _, group in itertools.groupby(sorted((r.shard, r.slot) for r in out), key=lambda x: x[0]):
        assert [s for _, s in group] == list(range(len(list(filter(lambda r: r.shard == _, out)))))
    assert count(sharding.slots(sharding.sharded(none.select("doc_id"), "doc_id", [1.0]), "shard", ["doc_id"])) == 0


# --- 3 -------------------------------------------------------------------------------------------


def test_tool_calls(spark):
    calls = spark.createDataFrame([
        (1, 0, "a", "search", '{"turn":0, "query":"x"}', None), (1, 2, "b", "search", '{"query":"x","turn":1,"z":2}', "a"), (1, 4, "c", "compose", '{"query":"x","turn":4}', "b"), (1, 5, "d", "nothing", "{}", "c"),
        (1, 6, "a", "search", '{"query":"again","turn":6}', None), (1, 7, "e", "search", "not json", "missing"), (1, 8, "f", "search", '{"query":"q","turn":"8"}', None), (1, 9, "g", "search", '{"query":"q","turn":9}', "missing"),
        (2, 0, "p", "search", '{"query":"q","turn":1}', "q"), (2, 1, "q", "search", '{"query":"q","turn":1}', "p"), (2, 2, "r", "search", '{"turn":1}', None), (2, 3, "s", "search", '{"query":"q","turn":1}', None), (None, None, None, None, None, None),
    ], "conv_id long, turn long, call_id string, name string, arguments string, depends_on string")
    results = spark.createDataFrame([(1, 1, "a", "first"), (1, 2, "a", "second"), (1, 3, "zz", None), (2, 2, "p", "x"), (2, 2, "q", "x")], "conv_id long, turn long, call_id string, text string")
    messages = spark.createDataFrame([(1, 0, "system", "hé\n\"q\""), (3, 0, None, None)], "conv_id long, turn long, role string, text string")
    out = chat.linked(calls, results, messages).collect()
    got = {(r.conv_id, r.turn, r.kind): r for r in out}
    state = {k[:2]: (r.status, r.level) for k, r in got.items() if k[2] == "call"}
    assert state[(1, 0)] == ("ok", 0) and state[(1, 2)] == ("invalid", 1) and state[(1, 4)] == ("invalid", 2) and state[(1, 5)][1] == 3
    assert state[(1, 6)][0] == "duplicate" and state[(1, 7)] == ("invalid", 0) and state[(1, 8)][0] == "invalid" and state[(1, 9)] == ("dangling", 0)
    assert state[(2, 0)] == ("cycle", None) and state[(2, 1)][0] == "cycle" and state[(2, 2)][0] == "invalid" and state[(2, 3)] == ("no_result", 0)
    assert got[(1, 0, "call")].line == '{"arguments":{"query":"x","turn":0},"errors":[],"id":"a","level":0,"name":"search","result":"first","status":"ok"}'
    assert '"errors":["extra"]' in got[(1, 2, "call")].line and '"errors":["query:missing"]' in got[(2, 2, "call")].line
    assert got[(1, 3, "result")].line == '{"id":"zz","result":null,"status":"orphan"}'
    assert got[(1, 0, "message")].line == '{"role":"system","text":"hé\\n\\"q\\""}' and got[(3, 0, "message")].line == '{"role":null,"text":null}'
    assert len(out) == 13 + 1 + 2
    places = {k[:2]: r.position for k, r in got.items() if k[2] == "call"}
    assert [t for c, t in sorted((k for k in places if k[0] == 1), key=places.get)] == [0, 6, 7, 8, 9, 2, 4, 5]
    assert sorted(p for k, p in places.items() if k[0] == 2) == [0, 1, 2, 3] and {places[(2, 0)], places[(2, 1)]} == {2, 3}
    empty = chat.linked(calls.where("false"), results.where("false"), messages.where("false"))
    assert count(empty) == 0


def test_long_chain_of_calls(spark):
    rows = spark.range(200).select(F.col("id").alias("key"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"))
    assert all(r.level == r.key and not r.cyclic for r in chat.levels(rows).collect())


# --- 4 and 8 -------------------------------------------------------------------------------------


def test_languages(spark, odd, none):
    draw = random.Random(1)
    make = {"xx": "abcde", "yy": "fghij", "zz": "éèêôû"}
    word = lambda k: "".join(draw.choice(make[k]) for _ in range(draw.randrange(2, 8)))
    rows = [(i, " ".join(word(k) for _ in range(draw.randrange(3, 60))), k) for i in range(120) for k in make]
    model = langid.fit([(t, k) for _, t, k in rows[:240]], buckets=1 << 12, epochs=4)
    docs = spark.createDataFrame(rows[240:], "doc_id long, text string, lang string")
    got = langid.predict(docs, model, ["doc_id", "lang"]).collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.98 and all(0 <= r.score <= 1 for r in got)
    strange = {r.doc_id: r for r in langid.predict(odd, model, ["doc_id"]).collect()}
    assert all(strange[i].lang_pred == "und" and strange[i].rejected and strange[i].score == 0 for i in (2, 3, 4, 6)) and strange[7].lang_pred in make
    assert count(langid.predict(none, model, ["doc_id"])) == 0
    untrained = langid.predict(odd, langid.fit([]), ["doc_id"]).collect()
    assert {r.lang_pred for r in untrained} == {"und"}


def test_blocks_do_not_change_a_mean(monkeypatch):
    from tidemark.llm import grams

    data = np.frombuffer(prose(random.Random(2), 400).encode(), np.uint8)
    offsets = np.array([0, 0, 17, 900, len(data), len(data)])
    rows = np.random.default_rng(0).normal(size=(1 << 10, 3))
    want, counts = grams.mean_rows(data, offsets, range(2, 5), rows)
    value, text = toxicity.word_means(data, offsets, rows[:, 0])
    monkeypatch.setattr(grams, "BLOCK", 64)
    got, _ = grams.mean_rows(data, offsets, range(2, 5), rows)
    assert np.allclose(want, got) and counts[0] == 0
    again, where = toxicity.word_means(data, offsets, rows[:, 0])
    assert np.allclose(value, again) and (text == where).all()


def test_toxicity(spark, odd, none):
    draw = random.Random(5)
    rows = []
    for i in range(400):
        words = prose(draw, draw.randrange(20, 120)).split()
        toxic = i % 2
        if toxic:
            words.insert(draw.randrange(len(words)), draw.choice(["grumblewort", "snarlfang"]) + draw.choice(["", "s", "ing", "ed", "x"]))
        rows.append((i, " ".join(words), toxic))
    model = toxicity.fit([(t, y) for _, t, y in rows[:300]], buckets=1 << 14)
    got = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame(rows[300:], "doc_id long, text string, toxic int"), model, ["doc_id"]).collect()}
    assert all((got[i] >= 0.3) == bool(y) for i, _, y in rows[300:])
    unseen = spark.createDataFrame([(1, prose(draw, 50) + " grumblewortish"), (2, prose(draw, 50))], "doc_id long, text string")
    s = {r.doc_id: r.score for r in toxicity.score(unseen, model, ["doc_id"]).collect()}
    assert s[1] > 0.3 > s[2]
    strange = toxicity.score(odd, model, ["doc_id", "score"], "toxicity").collect()
    assert len(strange) == odd.count() and all(r.toxicity == 0 for r in strange if r.doc_id in (2, 3, 4))
    assert count(toxicity.score(none, model, ["doc_id"])) == 0
    assert all(r.score == 0 for r in toxicity.score(odd.drop("score"), toxicity.fit([]), ["doc_id"]).collect())


def test_toxicity_sample_is_bounded(spark):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("text").alias("text"), F.lit(1).alias("toxic"))
    labels = spark.range(300).select(F.col("id").alias("doc_id"), (F.col("id") % 3 == 0).cast("int").alias("toxic"))
    rows = toxicity.training_rows(docs, labels, F.col("doc_id") % 4 != 2, 40)
    assert Counter(y for _, y in rows) == {0: 40, 1: 40}


# --- 5 -------------------------------------------------------------------------------------------


def test_url_parts_and_rules(spark):
    rows = [
        ("http://A.Example.NET/en/x?q#f", "a.example.net", "/en/x", "example.net/en/"), ("https://example.net/de/", "example.net", "/de/", "net/"), ("x://m.example.com/de/a", "m.example.com", "/de/a", "example.com/de/"),
        ("http://example.org?x=/fr/", "example.org", "", None), ("http://badexample.com/de/", "badexample.com", "/de/", None), ("no scheme", "", "", None), (None, "", "", None), ("http://net/", "net", "/", "net/"), ("http://a.org/fr/://b.net/", "a.org", "/fr/://b.net/", "org/fr/"),
        ("http://ÄB.net", "Äb.net", "", None),
    ]
    df = spark.createDataFrame([(u,) for u, *_ in rows], "url string").select(urls.host_of(F.col("url")).alias("host"), urls.path_of(F.col("url")).alias("path"))
    rule, _ = urls.rule_of(F.col("host"), F.col("path"))
    assert [tuple(r) for r in df.select("host", "path", rule).collect()] == [tuple(r[1:]) for r in rows]


def test_registered_domains(spark):
    rows = [("a.b.co.uk", "co.uk", "b.co.uk"), ("b.co.uk:80", "co.uk", "b.co.uk"), ("10.0.0.1:8080", "ip", "10.0.0.1"), ("[::1]:80", "ip", "[::1]"), ("u:p@x.com:", "com", "x.com"), ("m.x.com", "com", "x.com"), ("localhost", "localhost", "localhost"), ("", "", ""), ("co.uk", "co.uk", "co.uk")]
    df = spark.createDataFrame([(h,) for h, *_ in rows], "host string").select("host", urls.site_of(F.col("host")).alias("site"))
    assert [tuple(r) for r in df.select("host", urls.suffix_of(F.col("site")), urls.domain_of(F.col("site"))).collect()] == rows


def test_reputation_shrinks(spark):
    rows = [("bad.a.com", 1)] * 60 + [("good.a.com", 0)] * 60 + [("few.a.com", 1)] * 1 + [("other.b.org", 0)] * 200 + [("unseen.b.org", None)] * 3 + [("", 1)]
    got = {r.host: r for r in urls.reputations(spark.createDataFrame(rows, "host string, bad int")).collect()}
    assert got["bad.a.com"].reputation == "block" and got["good.a.com"].reputation == "allow" and got["unseen.b.org"].reputation == "allow"
    assert got["few.a.com"].bad_rate < 1 and got["unseen.b.org"].n == 0 and len(got) == 6
    assert count(urls.reputations(spark.createDataFrame([], "host string, bad int"))) == 0


# --- 6 -------------------------------------------------------------------------------------------


@pytest.mark.parametrize("blocks", [(8192, 1024), (300, 7)])
def test_neighbours_recall(spark, blocks):
    draw = np.random.default_rng(1)
    centres = draw.normal(size=(30, 16)) * 3
    x = (centres[draw.integers(0, 30, 1500)] + draw.normal(size=(1500, 16))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {}
    for r in neighbours.nearest(df, F.col("id") % 50 == 0, 10, data_block=blocks[0], query_block=blocks[1]).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hits = 0
    wide = x.astype(np.float64)
    for q in range(0, 1500, 50):
        far = np.sqrt(((wide - wide[q]) ** 2).sum(axis=1))
        far[q] = np.inf
        best = set(np.argsort(far, kind="stable")[:10].tolist())
        rows = sorted(got[q])
        assert [r for r, *_ in rows] == list(range(1, 11)) and all(abs(far[v] - s) < 1e-12 for _, v, s in rows)
        hits += len(best & {v for _, v, _ in rows})
    assert hits / 300 >= 0.95


def test_neighbours_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [1.0, 2.0, 3.0]), (9, [4.0, 4.0]), (None, [1.0, 1.0]), (10, [5.0, 4.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"id": F.lit("x"), "v": F.lit("y"), "block": F.lit(0)})
    got = sorted((r.query_id, r.rank, r.vec_id) for r in neighbours.nearest(df, F.col("id") % 5 == 0, 3).collect())
    assert got == [(0, 1, 1), (0, 2, 2), (0, 3, 9), (10, 1, 9), (10, 2, 0), (10, 3, 1)]
    more = df.select("vec_id", "embedding").unionByName(spark.createDataFrame([(15, [1.0, 2.0, 4.0]), (0, [5.0, 4.5]), (9, [0.0, 1.0])], "vec_id long, embedding array<float>"))
    got = sorted((r.query_id, r.rank, r.vec_id, round(r.score, 6)) for r in neighbours.nearest(more, F.col("id") % 5 == 0, 3).collect())
    assert got == [(0, 1, 1, 0.0), (0, 2, 2, 0.0), (0, 3, 10, 0.5), (10, 1, 0, 0.5), (10, 2, 9, 1.0), (10, 3, 1, 5.656854), (15, 1, 8, 1.0)]  # two vectors of 0 and 9; 8 and 15 have a dimension of their own
    assert count(neighbours.nearest(df.where("false"), F.col("id") % 5 == 0, 3)) == 0
    assert count(neighbours.nearest(df.where("vec_id = 0"), F.col("id") % 5 == 0, 3)) == 0


def test_a_very_common_vector_is_searched_once(spark):
    draw = np.random.default_rng(2)
    x = draw.normal(size=(400, 8))
    x[100:300] = x[0]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.nearest(df, F.col("id") % 10 == 0, 5).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    for q in range(100, 300, 10):
        assert [v for _, v in sorted(got[q])] == [i for i in (0, *range(100, 300)) if i != q][:5]
    assert len(got) == 40


def test_collision_counting_verifies_few():
    draw = np.random.default_rng(3)
    x = draw.normal(size=(6000, 24))
    index, hits, verified = neighbours.Index(x, np.arange(6000)), 0, 0
    for q in x[:40]:
        places, far, n = index.nearest(q, 10)
        exact = np.argsort(((x - q) ** 2).sum(axis=1), kind="stable")[:10]
        hits += len(set(places[np.argsort(far, kind="stable")[:10]].tolist()) & set(exact.tolist()))
        verified += n
    assert hits / 400 >= 0.9 and verified / 40 / len(x) < 0.2


# --- 7 -------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.load()


def test_segmentation_is_the_best(vocabulary):
    draw = random.Random(4)
    letters = "abcd"
    small = {"".join(p): (i, -draw.random() * 5) for i, p in enumerate(itertools.chain(itertools.product(" " + letters, repeat=1), [" a", "ab", "abc", "bcd", " ab", "cd", "dab"]))}
    v = pieces.Vocabulary(small, list(range(1000, 1256)), {})
    v.grow()

    def best(word):
        top = [0.0] + [-math.inf] * len(word)
        for end in range(1, len(word) + 1):
            for start in range(end):
                part = word[start:end]
                s = small[part][1] if part in small else v.unknown if end == start + 1 else -math.inf
                top[end] = max(top[end], top[start] + s)
        return top[-1]

    words = sorted({" " * draw.randrange(0, 3) + "".join(draw.choice(letters + "é") for _ in range(draw.randrange(1, 12))) for _ in range(300)})
    score = {i: s for i, s in small.values()}
    for word, ids in pieces.segment(words, v):
        unknown = sum(c not in small for c in word)
        got = sum(score[i] for i in ids if i < 1000) + unknown * v.unknown
        assert math.isclose(got, best(word), abs_tol=1e-9)
    assert [w for w, _ in pieces.segment(words, v)] == words


def test_pieces_round_trip(odd, none, vocabulary):
    out = pieces.pieced(odd, vocabulary, ["doc_id", "ids"], ("pieces", "exact")).collect()
    assert len(out) == odd.count()
    for r in out:
        assert (r.pieces is None and r.exact is None) if r.doc_id == 2 else r.exact
    assert next(r for r in out if r.doc_id == 3).pieces == []
    assert count(pieces.pieced(none, vocabulary, ["doc_id"])) == 0
    draw = random.Random(8)
    texts = ["".join(draw.choice(" ab\n▁é\U0001f600\t") for _ in range(draw.randrange(0, 40))) for _ in range(300)]
    cache = {}
    assert [pieces.decode(i, vocabulary) for i in pieces.encode(texts, vocabulary, cache)] == texts
    assert pieces.encode(texts, vocabulary, {}) == pieces.encode(texts, vocabulary, cache)


def test_long_words_are_segmented_alike(vocabulary, monkeypatch):
    draw = random.Random(9)
    texts = ["".join(draw.choice("abeinrst_é😀") for _ in range(draw.randrange(1, 400))) for _ in range(40)]
    want = pieces.encode(texts, vocabulary, {})
    monkeypatch.setattr(pieces, "LONG_CHARS", 8)
    assert pieces.encode(texts, vocabulary, {}) == want and [pieces.decode(i, vocabulary) for i in want] == texts


# --- 9 -------------------------------------------------------------------------------------------


def test_codec_tables():
    m, a = telephony.TABLES["mulaw"], telephony.TABLES["alaw"]
    assert m[0xFF] == 0 and m[0x00] == -32124 and m[0x80] == 32124 and a[0xD5] == 8 and a[0x55] == -8 and a[0xAA] == 32256
    assert len(set(m.tolist())) == 255 and len(set(a.tolist())) == 256


def scalar_adpcm(block):
    value = index = 0
    out = [0]
    for code in [c for b in block for c in (b & 15, b >> 4)]:
        step = int(telephony.STEPS[index])
        diff = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
        value = max(-32768, min(32767, value - diff if code & 8 else value + diff))
        index = max(0, min(88, index + int(telephony.INDEX[code & 7])))
        out.append(value)
    return out


def test_adpcm_equals_a_scalar_decoder():
    blocks = np.random.default_rng(0).integers(0, 256, (9, telephony.UNIT), dtype=np.uint8)
    assert telephony.adpcm(blocks).tolist() == [scalar_adpcm(b.tolist()) for b in blocks]


def test_telephone(odd, none, tmp_path):
    rows = telephony.telephone(odd, ["doc_id"], with_pcm=True).collect()
    texts = {r.doc_id: r.text for r in odd.collect()}
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        payload = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        codec, back = telephony.read(r.media)
        assert back == payload and (r.n_bytes, r.payload_bytes) == (len(raw), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-16:])
        assert r.media_bytes == len(r.media) and r.media_sha256 == hashlib.sha256(r.media).hexdigest()
        pcm = np.frombuffer(r.pcm, np.int16)
        flat = telephony.decode(codec, np.frombuffer(payload, np.uint8))
        assert (pcm[0::2] == flat).all() and (pcm[1:-1:2] == (flat[:-1].astype(int) + flat[1:]) >> 1).all() and pcm[-1] == flat[-1]
        assert r.feature.startswith(f"{codec} samples={len(pcm)} peak={np.abs(pcm.astype(int)).max()} ")
        assert (r.pcm_bytes, r.pcm_sha256) == (len(r.pcm), hashlib.sha256(r.pcm).hexdigest())
    assert len({r.feature for r in rows if r.doc_id in (1, None)}) == 1
    assert sorted(map(str, telephony.telephone(odd, ["doc_id"], True, piece=400).collect())) == sorted(map(str, rows))  # long texts in pieces
    path = str(tmp_path / "sounds")
    assert sorted(str((r.doc_id, r.media, r.pcm)) for r in telephony.sounds(odd, ["doc_id"], path).collect()) == sorted(str((r.doc_id, r.media, r.pcm)) for r in rows)
    assert count(telephony.telephone(none, ["doc_id"])) == 0
    assert {telephony.read(telephony.store(c, b"x" * 384)) for c in telephony.CODECS} == {(c, b"x" * 384) for c in telephony.CODECS}


# --- 10 ------------------------------------------------------------------------------------------


def water(sizes, weights, total):
    caps = [2.0 * s for s in sizes]
    capped = set()
    while True:
        free = [i for i in range(len(sizes)) if i not in capped]
        left = total - sum(caps[i] for i in capped)
        share = {i: left * weights[i] / sum(weights[k] for k in free) for i in free}
        over = {i for i in free if share[i] > caps[i] + 1e-9}
        if not over:
            return [caps[i] if i in capped else share[i] for i in range(len(sizes))]
        capped |= over


def test_targets_fill_up(spark):
    draw = random.Random(2)
    names = [None, "B", "a", "é", "src1", "src10", "src2", "z"]
    rows = [(n, draw.randrange(0, 400)) for n in names for _ in range(draw.randrange(1, 30))]
    got = {r.source: r for r in mixing.targets(spark.createDataFrame(rows, "source string, size long")).collect()}
    order = sorted(n for n in names if n is not None) + [None]
    sizes = [sum(s for n, s in rows if n == name) for name in order]
    want = water(sizes, [(5, 2, 1)[i % 3] for i in range(len(order))], 1.5 * sum(sizes))
    assert all(math.isclose(got[n].target, w, rel_tol=1e-9) for n, w in zip(order, want)) and math.isclose(sum(want), 1.5 * sum(sizes))


def test_mix_takes_what_it_should(spark):
    draw = random.Random(7)
    rows = [(i % 150, draw.choice(["a", "a", "a", "b", "c", None]), draw.randrange(0, 90)) for i in range(400)] + [(9, "a", 40)] * 5
    placed, piece = mixing.mixed(spark, spark.createDataFrame(rows, "doc_id long, source string, size long"), block=64)
    placed, piece = placed.collect(), piece.collect()
    assert len(placed) == len(rows)
    taken, targets = Counter(), {r.s.source: (r.words, r.source_size) for r in placed}
    for p in piece:
        taken[(p.doc_id, p.source, p.size, p.copy)] += p.words
        assert 0 < p.words <= 64 and 0 <= p.skip < p["size"]
    assert all(n <= 2 * k[2] for k, n in taken.items())
    for source, (words, _) in targets.items():
        assert sum(n for k, n in taken.items() if k[1] == source) == words
    assert {p.slot for p in piece} == set(range(sum(-(-w // 64) for w, _ in targets.values())))
    # low discrepancy: in every prefix a source has about its share of the slots
    by_slot = {p.slot: p.source for p in piece}
    order = [by_slot[s] for s in sorted(by_slot)]
    share = Counter(order)
    for n in (len(order) // 3, len(order) // 2):
        assert all(abs(Counter(order[:n])[s] - n * c / len(order)) < 6 for s, c in share.items())


def test_mix_is_written_by_slot(spark):
    words = [50 + 7 * k for k in range(40)]
    docs = spark.createDataFrame([(i, "abcdefgh"[i % 8], "w " * (300 + words[i % 40])) for i in range(160)], "doc_id long, source string, text string")
    _, piece = mixing.mixed(spark, docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size")))
    slots = {}
    for p in piece.collect():
        slots.setdefault(p.doc_id, {}).setdefault(p.round, []).append(p.slot)
    order = [r.doc_id for r in mixing.mixing_stage(spark, docs, "").collect()]
    use = Counter()
    at = []
    for d in order:
        rounds = sorted(min(x) for x in slots[d].values())
        at.append(rounds[min(use[d], len(rounds) - 1)])
        use[d] += 1
    assert sum(x > y for x, y in zip(at, at[1:])) <= len(order) // 20


def test_late_blocks_have_slots_of_their_own(spark):
    plan = [(f"s{i}", 64 * (1 + i % 3)) for i in range(60)]
    got = mixing.schedule(spark, spark.createDataFrame(plan, "source string, words long"), 64).collect()
    assert len(got) == sum(w // 64 for _, w in plan) == len({r.slot for r in got})
    assert len({(r.s.source, r["rank"]) for r in got}) == len(got) and sorted(r.slot for r in got) == list(range(len(got)))


def test_mix_of_odd_rows(spark, odd, none):
    size = mixing.word_count(F.col("text"))
    placed, piece = mixing.mixed(spark, odd.select("doc_id", "source", size.alias("size")))
    assert placed.count() == odd.count() and piece.where("doc_id in (2, 3, 4)").isEmpty()
    placed, piece = mixing.mixed(spark, none.select("doc_id", "source", size.alias("size")))
    assert count(placed) == 0 and count(piece) == 0
    out = mixing.mixing_stage(spark, odd, "")
    assert out.columns == odd.columns and all(n <= 4 for n in Counter(r.doc_id for r in out.collect()).values())
    assert count(mixing.mixing_stage(spark, none, "")) == 0


def test_language_sample_is_bounded(spark):
    rows = [(i, f"text {i} " * 50, f"l{i % 40}", None, None) for i in range(2000)]
    docs = spark.createDataFrame(rows, DOCS)
    everything = F.lit(True)
    assert len(langid.training_rows(docs, everything, 600)) == 2000
    found = Counter(lang for _, lang in langid.training_rows(docs, everything, 600, all_rows=400))
    assert len(found) == 40 and max(found.values()) <= 10
    few = langid.training_rows(docs, everything, 600, all_bytes=100_000)
    assert len({lang for _, lang in few}) == 40 and sum(len(t) for t, _ in few) <= 100_000
    assert len(langid.training_rows(docs, everything, 600, all_bytes=1)) == 40
