"""Collocations, linked embeddings and the Merkle manifest against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import collisions, collocations, merkle

# --- collocations --------------------------------------------------------------------------------


def phrases_by_hand(docs, least, longest, top):
    counts, n = Counter(), Counter()
    for text, lang in docs:
        for piece in re.split("[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = tuple(re.findall("[^\x20\x09]+", piece))
            n[lang] += len(w)
            counts.update((lang, w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    frequent = {x: f for x, f in counts.items() if f >= least}
    out = defaultdict(list)
    for (lang, w), a in frequent.items():
        if len(w) < 2:
            continue
        cuts = [(1000 * a * n[lang] // (frequent[lang, w[:k]] * frequent[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        longer = [f for (other, v), f in frequent.items() if other == lang and len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v) - len(w) + 1))]
        if not any(100 * f >= 100 * a for f in longer):
            out[lang].append((-score, -a, " ".join(w).encode(), frequent[lang, w[:k]], frequent[lang, w[k:]]))
    return {(lang, i, p.decode(), -a, left, right, n[lang], -s) for lang, rows in out.items() for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1)}


def test_collocations_equal_plain_counts(spark):
    rng = np.random.default_rng(4)
    words = ["The", "quick", "ÄB", "fox", "fox.", "a,b", "über", "x\ty", "end\n", "😀", "Straße"]
    docs = [(" ".join(rng.choice(words, rng.integers(0, 60))), str(rng.choice(["en", "de", "und"]))) for _ in range(300)]
    docs += [("New York City never sleeps; New York", "en")] * 40 + [(None, "en"), ("", "de"), (" \t\n.,", "fr"), ("solo", "fr"), ("to be or not " * 5000, "en"), ("ha " * 300, "de")]
    df = spark.createDataFrame(docs, "text string, lang string").repartition(4)
    got = [tuple(r) for r in collocations.collocations(df, least=20, longest=5, top=50).collect()]
    want = phrases_by_hand(docs, 20, 5, 50)
    assert len(got) == len(set(got)) and set(got) == want


def test_collocations_count_pairs_of_frequent_words_only(spark):
    """A pair of which a word is rare is not handed on, a word that another language has often included; hashes are dealt before they are added up."""
    docs = [("a b a b", "en")] * 10 + [("a x", "en"), ("b y. a c", "en"), ("a c", "de")] + [("c", "de")] * 20
    df = spark.createDataFrame(docs, "text string, lang string")
    words = collocations.word_counts(df).where("f >= 10")
    bits = collocations.bitmap(collocations.word_slots(words))
    assert {(r.lang, r.word) for r in words.collect()} == {("en", "a"), ("en", "b"), ("de", "c")} and np.unpackbits(bits).sum() == 3
    block = collocations.Words(collocations.pa.RecordBatch.from_pylist([{"text": t, "lang": lang} for t, lang in docs]))
    at, _ = collocations.longer_phrases(block, 1, bits)
    assert Counter(block.phrases(at, 2).to_pylist()) == {"a b": 20, "b a": 10} and len(collocations.longer_phrases(block, 1, None)[0]) == 34
    found = collocations.frequent_slots(df, 1, bits, 10)
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "Exchange" in plan and "Aggregate" not in plan.split("Exchange", 1)[1]
    assert found.count() == 2


def test_collocations_read_all_bitmaps_alike(spark, monkeypatch):
    docs = [("one two three four five six", "en")] * 30 + [("two three", "en")] * 30 + [("x" + str(i), "en") for i in range(500)]
    df = spark.createDataFrame(docs, "text string, lang string")
    want = {tuple(r) for r in collocations.collocations(df, 20).collect()}
    assert want == phrases_by_hand(docs, 20, 5, 2000)
    monkeypatch.setattr(collocations, "bitmap", lambda found: np.full(collocations.BITS // 8, 255, np.uint8))  # every phrase passes
    assert {tuple(r) for r in collocations.collocations(df, 20).collect()} == want


def test_stripes_of_a_task_add_up(monkeypatch):
    monkeypatch.setattr(collocations, "HELD", 6)
    kept, out = collocations.Stripes(), Counter()
    for i in range(20):
        kept.add(collocations.pa.table({"lang": ["en"] * 3, "prefix": ["a", "a", "b"], "word": ["x", str(i % 4), "x"], "count": [1, 2, 3]}))
        if kept.rows > 4:
            for r in (x for b in kept.taken() for x in b.to_pylist()):
                out.update({(r["prefix"], w): c for w, c in zip(r["words"], r["counts"])})
    for r in (x for b in kept.taken() for x in b.to_pylist()):
        out.update({(r["prefix"], w): c for w, c in zip(r["words"], r["counts"])})
    assert out == {("a", "x"): 20, ("b", "x"): 60, **{("a", str(i)): 10 for i in range(4)}}


def test_stripes_of_tasks_meet_before_they_become_entries(spark, monkeypatch):
    """No more entries than tasks that add them up have different ones, however many tasks' stripes hold them; a long counter is no single row."""
    monkeypatch.setattr(collocations, "HELD", 1000)
    kept = collocations.Stripes()
    kept.add(collocations.pa.table({"lang": ["en"] * 102, "prefix": ["a"] * 100 + ["a b"] * 2, "word": [f"w{i}" for i in range(100)] + ["x", "y"], "count": [1] * 102}))
    rows = [r for b in kept.taken() for r in b.to_pylist()]
    assert len([r for r in rows if r["prefix"] == "a"]) == len({r["share"] for r in rows}) == collocations.SHARES and [r["words"] for r in rows if r["prefix"] == "a b"] == [["x", "y"]]
    kind = "lang string, prefix string, share int, words array<string>, counts array<long>"
    parts = spark.createDataFrame(rows * 40, kind).repartition(8)
    found = collocations.merged(parts, 40)
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
    assert {(r.prefix, r.word): r.f for r in found.collect()} == {**{("a", f"w{i}"): 40 for i in range(100)}, ("a b", "x"): 40, ("a b", "y"): 40}
    assert collocations.merged(parts, 41).isEmpty()
    kept.add(collocations.pa.table({"lang": ["en"] * 2, "prefix": ["a"] * 2, "word": ["x"] * 2, "count": [1, 2]}))
    assert [r["count"] for b in kept.cells() for r in b.to_pylist()] == [3] and list(kept.cells()) == [] and kept.rows == 0


def test_scores_are_exact_beyond_64_bits(spark):
    cells = [("en", "", "p", 3_000_000_019), ("en", "", "q", 7_000_000_001), ("en", "p", "q", 2_999_999_999)]
    got = collocations.scored(spark.createDataFrame(cells, "lang string, prefix string, word string, f long"), spark.createDataFrame([("en", 90_000_000_000_007)], "lang string, n long")).collect()
    assert [(r.a, r.l, r.r, r.score) for r in got] == [(2_999_999_999, 3_000_000_019, 7_000_000_001, 1000 * 2_999_999_999 * 90_000_000_000_007 // (3_000_000_019 * 7_000_000_001))]


def test_no_words_give_no_phrases(spark):
    for docs in ([], [(None, "en"), ("", "en"), (" . ", "de")]):
        assert collocations.collocations(spark.createDataFrame(docs, "text string, lang string"), 1).collect() == []


# --- linked embeddings ---------------------------------------------------------------------------


def links_by_hand(rows, least):
    """(vec_id, n_links, component_id) of rows (vec_id, vector or None), by position."""
    good = [i for i, (_, v) in enumerate(rows) if v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    near, label = defaultdict(set), list(range(len(rows)))
    for i in good:
        for j in good:
            if i < j and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1]), np.array(rows[j][1])
                if a @ b / math.sqrt(a @ a) / math.sqrt(b @ b) >= least:
                    near[i].add(j)
                    near[j].add(i)
    changed = True
    while changed:
        changed = False
        for i in near:
            low = min([label[i], *(label[j] for j in near[i])])
            changed, label[i] = changed or low != label[i], low
    ids = defaultdict(list)
    for i, (ident, _) in enumerate(rows):
        ids[label[i]] += [ident] if ident is not None else []
    return Counter((ident, len(near[i]), min(ids[label[i]], default=None)) for i, (ident, _) in enumerate(rows))


def planted(rng, groups, size, cosine, dimension=64):
    """Vectors around centres, at ``cosine`` of the centre each."""
    unit = lambda x: x / np.sqrt((x * x).sum(axis=-1, keepdims=True))
    centre = unit(rng.normal(size=(groups, 1, dimension)))
    noise = rng.normal(size=(groups, size, dimension))
    noise = unit(noise - (noise * centre).sum(axis=2, keepdims=True) * centre)
    return (cosine * centre + math.sqrt(1 - cosine**2) * noise).reshape(-1, dimension), centre[:, 0]


@pytest.mark.parametrize("cell,block", [(4096, 2048), (16, 8)])
def test_links_equal_all_pairs(spark, cell, block):
    rng = np.random.default_rng(1)
    near, centre = planted(rng, 20, 6, 0.97)
    chain = [[math.cos(0.4 * i), math.sin(0.4 * i), 0.0] for i in range(12)]  # each links with the next alone
    rows = [(i, v) for i, v in enumerate([*near.tolist(), *centre.tolist(), *rng.normal(size=(150, 64)).tolist(), *chain])]
    rows += [(900, [1.0, 2.0]), (900, [1.0, 2.0]), (901, [2.0, 4.0]), (901, [-2.0, 1.0]), (None, [1.0, 2.01]), (None, [0.0, -1.0]), (902, None), (903, [0.0, 0.0]), (904, [math.nan, 1.0]), (905, [None, 1.0]), (906, []), (907, [math.inf, 1.0]), (None, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("node", F.lit("clash"))
    got = Counter(tuple(r) for r in collisions.linked(df, cell=cell, block=block).collect())
    assert got == links_by_hand(rows, 0.9)


def test_recall_at_the_least_cosine(spark):
    """Pairs at 0.9 to 0.91, the hardest, in many small cells: at least 99 % are found."""
    rng = np.random.default_rng(2)
    near, centre = planted(rng, 400, 1, 0.905)
    x = np.concatenate([near, centre, rng.normal(size=(1200, 64))])
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = collisions.linked(df, cell=32)
    assert got.agg(F.sum("n_links")).first()[0] >= 0.99 * 800
    assert collisions.linked(df.where("false")).collect() == []


def test_collisions_count_windows():
    rng = np.random.default_rng(3)
    for queries, others, lines, need in ((5, 7, 8, 6), (70, 130, 33, 20), (3, 64, 1, 1), (1, 1, 4, 0)):
        q, x = rng.normal(size=(lines, queries)), rng.normal(size=(lines, others))
        counts = (np.abs(q[:, :, None] - x[:, None, :]) <= 0.7).sum(axis=0)
        a, b = collisions.collisions(q, x, 0.7, need)
        inside = (a < queries) & (b < others)
        assert set(zip(a[inside].tolist(), b[inside].tolist())) == set(zip(*[s.tolist() for s in np.nonzero(counts >= need)])) and (inside.all() or need == 0)


# --- Merkle manifest -----------------------------------------------------------------------------


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def manifest_by_hand(docs):
    """op13's rows from (doc_id, source, lang, n_chars, text)."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: H(*map(field, r))

    def tree(leaves):
        levels = [leaves]
        while len(levels[-1]) > 1:
            levels.append([H(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
        return levels

    def climb(levels, at, start):
        around = ""
        for level in levels[:-1]:
            run = level[at // 8 * 8 : at // 8 * 8 + 8]
            around += "".join(run[: at % 8] + run[at % 8 + 1 :])
            start, at = H(*run[: at % 8], start, *run[at % 8 + 1 :]), at // 8
        return around, start

    by = defaultdict(list)
    for r in docs:
        by[r[2]].append(r)
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: tree([leaf(r) for r in sorted(by[x], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))]) for x in langs}
    top = tree([trees[x][-1][0] for x in langs])
    out = Counter()
    for i, x in enumerate(langs):
        for at, r in enumerate(sorted(by[x], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))):
            changed = r
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None:
                changed = (*r[:4], re.sub("[A-Z]", lambda m: m[0].lower(), r[4]))
            around, sub = climb(trees[x], at, leaf(changed))
            more, root = climb(top, i, sub)
            out[(r[0], leaf(r), trees[x][-1][0], top[-1][0], H(around + more), root, root == top[-1][0])] += 1
    return out


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


@pytest.mark.parametrize("sizes", [{"en": 1}, {"en": 9}, {None: 1, "de": 8, "en": 65, "fr": 64, "zz": 520}, {f"l{i}": 1 + i % 3 for i in range(30)}])
def test_manifest_equals_plain_hashes(spark, tmp_path, sizes):
    docs, i = [], 0
    for lang, n in sizes.items():
        for _ in range(n):
            docs.append((i * 7, f"s{i % 3}" if i % 5 else None, lang, i if i % 4 else None, None if i % 11 == 3 else f"Text Nr. {i} Ä" if i % 2 else f"lower {i}"))
            i += 1
    spark.createDataFrame(docs, "doc_id long, source string, lang string, n_chars long, text string").withColumn("lo", F.lit(1)).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter(tuple(r[c] for c in COLUMNS) for r in merkle.op13_manifest(spark, str(tmp_path)).collect())
    assert got == manifest_by_hand(docs)


def test_manifest_of_repeated_rows_and_null_keys(spark, tmp_path):
    docs = [(5, "a", "en", 1, "Same")] * 30 + [(None, "a", "en", 1, "Null key")] * 3 + [(5, "a", "en", 2, ""), (6, None, None, None, None), (7, "a", "en", 3, "long " * 100_000)]
    spark.createDataFrame(docs, "doc_id long, source string, lang string, n_chars long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter(tuple(r[c] for c in COLUMNS) for r in merkle.op13_manifest(spark, str(tmp_path)).collect())
    assert got == manifest_by_hand(docs)


def test_nodes_are_nested_intervals(spark):
    leaves = spark.range(150).select(F.lit(0).cast("long").alias("tree"), F.lit(150).cast("long").alias("n"), F.col("id").alias("lo"), merkle.leaf([F.col("id")]).alias("digest"))
    proofs, nodes = merkle.manifest(leaves)
    rows = [r for r in nodes.collect() if r.tree == 0]
    for level in range(4):
        spans = sorted((r.lo, r.hi) for r in rows if r.level == level)
        assert spans == [(i, min(i + 8**level, 150)) for i in range(0, 150, 8**level)]
    assert {bytes(r.root) for r in proofs.collect()} == {bytes(r.digest) for r in rows if r.level == 3}
    assert all(sum(len(x.left) + len(x.right) for x in r.path) % 32 == 0 and len(r.path) == 3 for r in proofs.collect())
