"""A Merkle manifest of a data set, as nested intervals of leaf ranks.

Every row is a leaf; the leaves of a tree (one value of a column) are ranked by their key.  Each node
carries the interval [lo, hi) of the ranks that it covers, the digests of its children end to end, and its own digest:
``FAN`` consecutive nodes of a level, fewer at the end, make one of the next, while a tree has several.  The roots of the trees
are the leaves of a last tree.  At a level whose nodes cover w ranks a node's place is lo // w, so a containment join
is an equal join on (tree, place): each level hands its siblings and those above it to the level below, and what a parent
covers less what a child covers are the child's siblings, to its left and to its right.  No task holds more
than ``FAN`` nodes of a parent, and no row more than ``FAN`` digests a level.

Rows are ranked by a range sort, one count a part and tree; no tree passes through one task.  Equal rows are counted
first and unfolded last: they are neighbours that cover an interval together.

Null values hash as ``-``.  A null tree comes first; rows with a null key come first in their tree.  Rows that tie in the key are ordered by
their digests.  Repeated rows are leaves of their own.  Empty and very long texts are hashed whole.  An empty table has no root and gives no rows.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm import common
from tidemark.operators.ranks import placed, with_index

FAN, DIGEST = 8, 32
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(content: Column) -> Column:
    """sha256 as 32 bytes."""
    return F.unhex(F.sha2(content, 256))


def text_of(digests: Column) -> Column:
    """Digests as lowercase hex text."""
    return F.lower(F.hex(digests))


def parent_of(digests: Column) -> Column:
    """The digest of a node whose children's digests lie end to end; they count as hex text."""
    return digest(text_of(digests).cast("binary"))


def field(value: Column) -> Column:
    """``-`` if null, else UTF-8 byte count, ``:`` and the value."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(values: list[Column]) -> Column:
    return digest(F.concat(*[field(v) for v in values]).cast("binary"))


def ranked(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """``rows`` with ``tree`` replaced by its number among the trees, in order, and with ``lo``, the rank in the tree, and ``n``, its leaves.

    Equal rows are counted, so that a row which very many share is one in between.
    """
    names = rows.columns
    parts = placed(rows.groupBy(*names).agg(F.count(F.lit(1)).alias("__c")), [tree, *order])
    sums = common.cut(parts.groupBy("__part", F.col(tree).alias("__tree")).agg(F.sum("__c").alias("__sum")))
    numbers = with_index(sums.select(F.col("__tree").alias("__name")).distinct(), ["__name"], "__number")
    by_tree = W.partitionBy("__tree")  # one row a part
    before = sums.select("__part", "__tree", (F.sum("__sum").over(by_tree.orderBy("__part")) - F.col("__sum")).alias("__before"), F.sum("__sum").over(by_tree).alias("n"))
    before = before.join(numbers, F.col("__tree").eqNullSafe(F.col("__name"))).select(F.col("__part").alias("__p"), "__tree", "__before", "n", "__number")
    met = parts.join(before, (F.col("__part") == F.col("__p")) & F.col(tree).eqNullSafe(F.col("__tree")))
    run = W.partitionBy("__part", "__number").orderBy("__row").rowsBetween(W.unboundedPreceding, 0)
    first = F.col("__before") + F.sum("__c").over(run) - F.col("__c")
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.col("__c") - 1)).alias("__copy")
    out = met.withColumn("__first", first).select(*names, "n", "__number", "__first", copies)
    return out.select(*[F.col("__number").alias(c) if c == tree else c for c in names], "n", (F.col("__first") + F.col("__copy")).alias("lo"))


def levels(leaves: DataFrame) -> list[DataFrame]:
    """The levels above ``leaves`` (tree, n, lo, digest), lowest first, each (tree, n, lo, hi, kids, digest).

    A tree ends at the level where one node covers its n ranks; the number of levels grows with the logarithm of the largest.
    """
    most = leaves.agg(F.max("n")).first()[0] or 0
    below, width, out = leaves.select("tree", "n", "lo", (F.col("lo") + 1).alias("hi"), "digest"), 1, []
    while width < most:
        wide = width * FAN
        kids = F.sort_array(F.collect_list(F.struct("lo", "hi", "digest")))
        met = below.where(F.col("n") > width).groupBy("tree", "n", F.expr(f"lo div {wide}")).agg(kids.alias("k"))
        joined = F.aggregate("k", F.lit(b""), lambda s, x: F.concat(s, x["digest"]))
        made = met.select("tree", "n", F.col("k")[0]["lo"].alias("lo"), F.element_at("k", -1)["hi"].alias("hi"), joined.alias("kids"))
        below = common.cut(made.withColumn("digest", parent_of(F.col("kids"))))
        out.append(below)
        width = wide
    return out


def tops(leaves: DataFrame, above: list[DataFrame]) -> DataFrame:
    """(tree, digest): the node that covers all ranks of its tree."""
    out = leaves.where("n = 1").select("tree", "digest")
    for level in above:
        out = out.unionByName(level.where("lo = 0 and hi = n").select("tree", "digest"))
    return out


def child_path(width: int) -> list[Column]:
    """(lo, hi, path) of each child of a node that has ``kids`` and ``path``: its siblings to the left and right, then the node's own path.

    Children cover ``width`` ranks: the parent's interval less the child's is [lo, child's lo) and [child's hi, hi).
    """
    places = F.sequence(F.lit(0), (F.octet_length("kids") / DIGEST).cast("int") - 1)

    def child(place: Column) -> Column:
        first, end = F.col("lo") + place * width, F.least(F.col("lo") + (place + 1) * width, F.col("hi"))
        left, right = F.substring(F.col("kids"), F.lit(1), place * DIGEST), F.substring(F.col("kids"), (place + 1) * DIGEST + 1, F.octet_length("kids"))
        return F.struct(first.alias("lo"), end.alias("hi"), F.concat(F.array(F.struct(left.alias("left"), right.alias("right"))), F.col("path")).alias("path"))

    return F.inline(F.transform(places, child))


def attached(leaves: DataFrame, above: list[DataFrame], crowns: DataFrame) -> DataFrame:
    """``leaves`` (tree, n, lo, ..) with ``crowns``' columns and ``path``: at each level, lowest first, the digests left and right of the leaf's ancestor.

    ``crowns`` is (tree, path, ..), what lies above a tree's top.
    """
    carried = [c for c in crowns.columns if c not in ("tree", "path")]
    held = None
    for k in range(len(above), 0, -1):
        width = FAN**k
        inner = above[k - 1].select("tree", "n", "lo", "hi", "kids")
        top = inner.where("lo = 0 and hi = n").join(crowns, "tree")
        if held is not None:
            down = held.select("tree", *carried, child_path(width)).drop("hi")
            top = top.unionByName(inner.where("lo > 0 or hi < n").join(down, ["tree", "lo"]))
        held = common.cut(top)
    out = leaves.where("n = 1").join(crowns, "tree")
    if held is None:
        return out
    parents = held.select("tree", *carried, F.col("lo").alias("from"), F.col("hi").alias("upto"), "kids", "path", F.expr(f"lo div {FAN}").alias("place"))
    met = leaves.where("n > 1").withColumn("place", F.expr(f"lo div {FAN}")).join(parents, ["tree", "place"])
    at = (F.col("lo") - F.col("from")).cast("int")
    own = F.struct(F.substring(F.col("kids"), F.lit(1), at * DIGEST).alias("left"), F.substring(F.col("kids"), (at + 1) * DIGEST + 1, F.octet_length("kids")).alias("right"))
    return out.unionByName(met.withColumn("path", F.concat(F.array(own), F.col("path"))).select(*out.columns))


def proof(path: Column) -> Column:
    """The digest of all siblings on the way up, those of a level from left to right."""
    joined = F.aggregate(path, F.lit(b""), lambda s, x: F.concat(s, x["left"], x["right"]))
    return parent_of(joined)


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, start, lambda s, x: parent_of(F.concat(x["left"], s, x["right"])))


def manifest(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(proofs, nodes) of ``leaves`` (tree, n, lo, digest, ..), whose trees are numbered from 0.

    Proofs are the leaves with ``subroot``, ``root`` and ``path``; nodes (tree, level, lo, hi, digest) are the manifest to store, in which
    tree -1 is that of the subroots.
    """
    above = levels(leaves)
    subroots = common.cut(tops(leaves, above))
    n = subroots.count()
    ends = subroots.select(F.lit(-1).cast("long").alias("tree"), F.lit(n).cast("long").alias("n"), F.col("tree").alias("lo"), "digest")
    over = levels(ends)
    nothing = F.array().cast("array<struct<left: binary, right: binary>>")
    whole = tops(ends, over).select("tree", nothing.alias("path"), F.col("digest").alias("root"))  # one row
    crowns = common.cut(attached(ends, over, whole).select(F.col("lo").alias("tree"), "path", F.col("digest").alias("subroot"), "root"))
    proofs = attached(leaves, above, crowns)
    interval = lambda df, k: df.select("tree", F.lit(k).alias("level"), "lo", (F.col("hi") if k else F.col("lo") + 1).alias("hi"), "digest")
    nodes = interval(leaves, 0)
    for k, level in enumerate(above, 1):
        nodes = nodes.unionByName(interval(level, k))
    for k, level in enumerate([ends, *over]):
        nodes = nodes.unionByName(interval(level, k))
    return proofs, nodes


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    marked = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    changed = F.when(marked, leaf([F.translate("text", UPPER, LOWER) if c == "text" else F.col(c) for c in fields]))
    rows = common.staged(docs.select("doc_id", F.col("lang").alias("tree"), leaf([F.col(c) for c in fields]).alias("digest"), changed.alias("changed")), "leaves")
    leaves = common.cut(ranked(rows, "tree", ["doc_id", "digest"]))
    proofs, _ = manifest(leaves)
    again = folded(F.coalesce("changed", "digest"), F.col("path"))
    out = proofs.select("doc_id", "digest", "subroot", "root", proof(F.col("path")).alias("proof"), again.alias("again"))
    return out.select("doc_id", text_of(F.col("digest")).alias("leaf"), text_of(F.col("subroot")).alias("subroot"), text_of(F.col("root")).alias("root"), text_of(F.col("proof")).alias("proof_sha256"), text_of(F.col("again")).alias("folded_root"), (F.col("again") == F.col("root")).alias("verified"))


ORACLE = """WITH RECURSIVE
bt AS (SELECT i, 0 AS k, i::UBIGINT AS v FROM range(256) r(i) UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::UBIGINT) ELSE v >> 1 END FROM bt WHERE k < 8),
ct AS MATERIALIZED (SELECT list(v ORDER BY i) AS t FROM bt WHERE k = 8),
dc AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, source, lang, n_chars, text FROM documents),
cr AS (SELECT rid, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ascii(x)::UBIGINT)), lambda c, b: xor(c >> 8, t[CAST(xor(c & 255, b) AS BIGINT) + 1])), 4294967295::UBIGINT) AS crc FROM dc, ct WHERE doc_id IS NOT NULL),
hs AS (SELECT dc.*, concat_ws('', {doc_id}, {source}, {lang}, {n_chars}) AS head, coalesce(crc % 3 = 0, false) AS marked FROM dc LEFT JOIN cr USING (rid)),
lf AS MATERIALIZED (SELECT rid, doc_id, lang, sha256(head || {text}) AS leaf, sha256(head || CASE WHEN marked THEN coalesce(strlen(text) || ':' || translate(text, '{upper}', '{lower}'), '-') ELSE {text} END) AS changed FROM hs),
tr AS (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree FROM (SELECT DISTINCT lang FROM lf)),
lv AS MATERIALIZED (SELECT rid, doc_id, leaf, changed, tree, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS lo, count(*) OVER (PARTITION BY tree) AS n FROM lf JOIN tr ON lf.lang IS NOT DISTINCT FROM tr.lang),
nd AS (SELECT tree, 0 AS lvl, lo, n, leaf AS digest FROM lv UNION ALL SELECT tree, lvl + 1, lo // 8, any_value((n + 7) // 8), sha256(string_agg(digest, '' ORDER BY lo)) FROM nd WHERE n > 1 GROUP BY tree, lvl, lo // 8),
sr AS MATERIALIZED (SELECT tree, digest FROM nd WHERE n = 1),
rd AS (SELECT -1 AS tree, 0 AS lvl, tree AS lo, (SELECT count(*) FROM sr) AS n, digest FROM sr UNION ALL SELECT tree, lvl + 1, lo // 8, any_value((n + 7) // 8), sha256(string_agg(digest, '' ORDER BY lo)) FROM rd WHERE n > 1 GROUP BY tree, lvl, lo // 8),
al AS MATERIALIZED (SELECT * FROM nd UNION ALL SELECT * FROM rd),
sb AS MATERIALIZED (SELECT a.tree, a.lvl, a.lo, any_value(a.n) AS n, coalesce(string_agg(b.digest, '' ORDER BY b.lo) FILTER (WHERE b.lo < a.lo), '') AS lt, coalesce(string_agg(b.digest, '' ORDER BY b.lo) FILTER (WHERE b.lo > a.lo), '') AS rt FROM al a JOIN al b ON a.tree = b.tree AND a.lvl = b.lvl AND a.lo // 8 = b.lo // 8 GROUP BY a.tree, a.lvl, a.lo),
fd AS (SELECT rid, tree, 0 AS lvl, lo, n, changed AS digest, '' AS path FROM lv
    UNION ALL SELECT rid, CASE WHEN fd.n > 1 THEN fd.tree ELSE -1 END, CASE WHEN fd.n > 1 THEN fd.lvl + 1 ELSE 0 END, CASE WHEN fd.n > 1 THEN fd.lo // 8 ELSE fd.tree END, CASE WHEN fd.n > 1 THEN (fd.n + 7) // 8 ELSE (SELECT count(*) FROM sr) END,
    CASE WHEN fd.n > 1 THEN sha256(lt || digest || rt) ELSE digest END, path || lt || rt FROM fd JOIN sb ON fd.tree = sb.tree AND fd.lvl = sb.lvl AND fd.lo = sb.lo WHERE fd.n > 1 OR fd.tree >= 0),
en AS (SELECT rid, digest, path FROM fd WHERE tree = -1 AND n = 1)
SELECT doc_id, leaf, sr.digest AS subroot, rt.digest AS root, sha256(path) AS proof_sha256, en.digest AS folded_root, en.digest = rt.digest AS verified FROM lv JOIN en USING (rid) JOIN sr USING (tree) CROSS JOIN (SELECT digest FROM rd WHERE n = 1) rt""".format(
    upper=UPPER, lower=LOWER, **{c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", "n_chars", "text")}
)
