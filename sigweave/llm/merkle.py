"""A dataset's Merkle manifest: a hash tree of each source's rows, one over the sources, and a proof for each row.

Rows are placed in their source by one range partitioning of (source, doc_id, leaf) and the prefix
sums of each partition's runs, so no task holds a source. Bottom-up, ``FANOUT`` consecutive nodes make
a parent. ``STEP`` levels are built at a time: a page is at most FANOUT ** STEP consecutive nodes
with the levels above them, and its top is a node of the next pages; all pages are written. Top-down,
each page inherits from its parent page the proof of its top (the siblings on the way from there to
the root) and each node prepends its own siblings, so a join of pages to their parents, a 1/81 of the rows and
falling, carries all proofs down.

Nulls: each field of a leaf that is null counts as ``-``; a null source is a group of its own and the
first; rows without doc_id come first in their source. Rows of one doc_id are ordered by leaf; repeated
rows get a leaf each, and as they are equal, any order gives the same tree. A lone leaf is its source's
subroot, a lone subroot the root; without siblings the proof is the hash of nothing. An empty table
gives no rows. A very long text is hashed in its row, in memory of some times its size. Extra columns
pass by; only the five fields are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, partitions_for, release, small
from .crc_sql import CRC, crc32_sql

FANOUT = 3
STEP = 4
PAGE = FANOUT**STEP
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
NO_PROOF = "array<struct<left:string,right:string>>"


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(text: Column) -> Column:
    return digest(F.concat(*(field(text if c == "text" else F.col(c)) for c in FIELDS)))


def tampered(docs: DataFrame) -> Column:
    """Whether a row's text loses its line feeds."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))


def leaves(docs: DataFrame, changed: Column | None = None) -> DataFrame:
    """doc_id, source, leaf, now (the leaf of the row as it is found, if it differs) of each row."""
    now = leaf(F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    touched = (tampered(docs) if changed is None else changed) & F.contains(F.col("text"), F.lit("\n"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), leaf(F.col("text")).alias("leaf"), F.when(touched, now).alias("now"))


def placed(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` with tree (their source's number), pos and n (their source's rows); and of each source tree, n."""
    spark = rows.sparkSession
    order = ["source", "doc_id", "leaf"]
    n_rows = rows.count()
    parts = partitions_for(spark, 200 * n_rows)
    spread = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    spread = materialize(spread.withColumn("part", F.shiftright("at", 33)), "leaves")
    release(rows)
    runs = materialize(spread.groupBy("part", "source").agg(F.min("at").alias("first"), F.count("*").alias("n")), "runs")
    # One source's runs are as many as partitions at most.
    earlier = Window.partitionBy("source").orderBy("part")
    runs = runs.select("part", "source", "first", F.coalesce(F.sum("n").over(earlier.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy("source")).alias("n"), F.min("part").over(Window.partitionBy("source")).alias("head"))
    # Sources are in the order of their first rows: numbered in their partition, after those of earlier partitions.
    heads = runs.filter("part = head").select("source", "part", "first", "n", F.row_number().over(Window.partitionBy("part").orderBy("first")).alias("k"))
    heads = materialize(heads, "heads")
    # A row for each partition, of which there are about one per 256 MB: bounded for any window.
    per_part = heads.groupBy("part").agg(F.count("*").alias("heads"))
    per_part = per_part.select("part", (F.sum("heads").over(Window.orderBy("part")) - F.col("heads")).alias("heads_before"))
    trees = heads.join(F.broadcast(per_part), "part").select("source", "n", (F.col("heads_before") + F.col("k") - 1).alias("tree"))
    trees = materialize(trees, "trees")
    t = trees.select(F.col("source").alias("s"), "tree")
    known = runs.join(small(t, trees.count()), F.col("source").eqNullSafe(F.col("s"))).select("part", F.col("source").alias("s"), "first", "before", "n", "tree")
    known = materialize(known, "places")
    met = spread.join(small(known.withColumnRenamed("part", "p"), known.count()), (F.col("part") == F.col("p")) & F.col("source").eqNullSafe(F.col("s")))
    return met.select("doc_id", "leaf", "now", "tree", (F.col("at") - F.col("first") + F.col("before")).alias("pos"), "n"), trees.select("tree", "n")


def parents(nodes: Column) -> Column:
    """Digests of each run of ``FANOUT`` of an array of digests."""
    runs = F.sequence(F.lit(0), F.ceil(F.size(nodes) / FANOUT).cast("int") - 1)
    return F.transform(runs, lambda i: digest(F.array_join(F.slice(nodes, i * FANOUT + 1, F.lit(FANOUT)), "")))


def depth(n: Column) -> Column:
    """Levels above ``n`` nodes, as far as a page goes."""
    out = F.lit(STEP)
    for k in range(STEP - 1, -1, -1):
        out = F.when(n <= FANOUT**k, k).otherwise(out)
    return out


def pages(nodes: DataFrame, *carried: str) -> DataFrame:
    """tree, page, n (nodes of the tree on this level), levels (the page's nodes, their parents, .., without its
    top), top, and an array of what is ``carried`` of each node, from ``nodes(tree, pos, n, digest)``."""
    held = F.array_sort(F.collect_list(F.struct("pos", "digest", *carried))).alias("held")
    grouped = nodes.groupBy("tree", F.expr(f"pos div {PAGE}").alias("page")).agg(F.first("n").alias("n"), held)
    out = grouped.select("tree", "page", "n", depth(F.col("n")).alias("depth"), F.col("held.digest").alias("level0"), *(F.col(f"held.{c}").alias(c) for c in carried))
    for k in range(1, STEP + 1):
        above = parents(F.col(f"level{k - 1}"))
        out = out.withColumn(f"level{k}", F.when(F.col("depth") >= k, above).otherwise(F.col(f"level{k - 1}")))
    levels = F.slice(F.array(*(F.col(f"level{k}") for k in range(STEP))), F.lit(1), F.col("depth")).alias("levels")
    return out.select("tree", "page", "n", levels, F.col("level0").alias("nodes"), F.col(f"level{STEP}")[0].alias("top"), *carried)


def built(nodes: DataFrame, tag: str, *carried: str) -> tuple[list[DataFrame], DataFrame]:
    """Pages of all steps, from the leaves up, written; and of each tree: tree, root."""
    steps, roots = [], None
    while True:
        step = materialize(pages(nodes, *(() if steps else carried)), f"{tag}-{len(steps)}")
        steps.append(step)
        done = step.filter(f"n <= {PAGE}").select("tree", F.col("top").alias("root"))
        roots = done if roots is None else roots.unionByName(done)
        nodes = step.filter(f"n > {PAGE}").select("tree", F.col("page").alias("pos"), F.ceil(F.col("n") / PAGE).alias("n"), F.col("top").alias("digest"))
        if nodes.isEmpty():
            return steps, roots


def own_proof(place: Column) -> Column:
    """The siblings, level by level, of the node at ``place`` of a page, left and right of it."""

    def siblings(level: Column, k: Column) -> Column:
        at = F.floor(place / F.pow(F.lit(FANOUT), k)).cast("int")
        run = at - at % FANOUT
        text = lambda a, n: F.array_join(F.slice(level, a + 1, n), "")
        return F.struct(text(run, at - run).alias("left"), text(at + 1, run + FANOUT - 1 - at).alias("right"))

    return F.transform("levels", siblings)


def entries(held: DataFrame, *kept: str, **carried: str) -> DataFrame:
    """at (its place in the tree's level), digest and proof of each node of the pages ``held``, with the pages'
    columns ``kept`` and, of arrays, the nodes' ``carried``."""
    node = lambda x, i: F.struct((F.col("page") * PAGE + i).alias("at"), x.alias("digest"), own_proof(i).alias("own"), *(F.get(F.col(c), i).alias(c) for c in carried.values()))
    rows = held.select("proof", *kept, F.explode(F.transform("nodes", node)).alias("x"))
    return rows.select("x.at", "x.digest", F.concat("x.own", "proof").alias("proof"), *kept, *(F.col(f"x.{c}").alias(k) for k, c in carried.items()))


def pushed(steps: list[DataFrame], tops: DataFrame, tag: str) -> DataFrame:
    """The pages of the lowest step with proof (from their top to the root), given that of each tree's
    root, and its other columns, in ``tops(tree, proof, ..)``."""
    more = [c for c in tops.columns if c not in ("tree", "proof")]
    above = None
    for k in range(len(steps) - 1, -1, -1):
        root = steps[k].filter(f"n <= {PAGE}").join(tops, "tree")
        if above is not None:
            mine = entries(above, "tree", *more).select("tree", F.col("at").alias("page"), "proof", *more)
            root = root.unionByName(steps[k].filter(f"n > {PAGE}").join(mine, ["tree", "page"]))
        above = materialize(root, f"{tag}-proofs") if k else root
    return above


def manifest(docs: DataFrame, changed: Column | None = None) -> DataFrame:
    """doc_id, leaf, now, subroot, root and proof (siblings, level by level, as left and right) of each row."""
    rows, trees = placed(materialize(leaves(docs, changed), "hashes"))
    steps, subroots = built(rows.withColumnRenamed("leaf", "digest"), "pages", "doc_id", "now")
    subroots = materialize(subroots, "subroots")
    upper = subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), F.lit(trees.count()).cast("long").alias("n"), F.col("root").alias("digest"))
    upper_steps, roots = built(upper, "upper")
    top = roots.select("tree", F.array().cast(NO_PROOF).alias("proof"), F.col("root").alias("whole"))
    upper_pages = pushed(upper_steps, top, "upper")
    tops = entries(upper_pages, "whole").select(F.col("at").alias("tree"), "proof", F.col("digest").alias("subroot"), F.col("whole").alias("root"))
    lowest = pushed(steps, materialize(tops, "tops"), "pages")
    return entries(lowest, "subroot", "root", doc_id="doc_id", now="now").select("doc_id", F.col("digest").alias("leaf"), "now", "subroot", "root", "proof")


def folded(start: Column, proof: Column) -> Column:
    """The root that ``start`` and the siblings of ``proof`` give."""
    return F.aggregate(proof, start, lambda acc, x: digest(F.concat(x["left"], acc, x["right"])))


def op13_merkle_manifest(docs: DataFrame) -> DataFrame:
    out = manifest(docs)
    siblings = F.array_join(F.transform("proof", lambda x: F.concat(x["left"], x["right"])), "")
    out = out.select("doc_id", "leaf", "subroot", "root", digest(siblings).alias("proof_sha256"), folded(F.coalesce("now", "leaf"), F.col("proof")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


FIELD = "coalesce(octet_length(encode({0}::VARCHAR)) || ':' || {0}::VARCHAR, '-')"


def leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(FIELD.format(x) for x in ("doc_id", "source", "lang", "n_chars", text)) + ")"


LEVEL = "list_transform(range((len(nodes) + 2) // 3), lambda i: sha256(array_to_string(nodes[3 * i + 1 : 3 * i + 3], '')))"
ORACLE_OP13 = f"""
WITH RECURSIVE {CRC},
hashed AS (
  SELECT doc_id, source, {leaf_sql("text")} AS leaf,
    CASE WHEN {crc32_sql("doc_id::VARCHAR")} % 2 = 0 THEN {leaf_sql("replace(text, chr(10), '')")} ELSE {leaf_sql("text")} END AS now
  FROM documents, crc_steps
),
placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, dense_rank() OVER (ORDER BY source NULLS FIRST) AS tree FROM hashed),
levels AS (
  SELECT tree, 0 AS level, list(leaf ORDER BY pos) AS nodes FROM placed GROUP BY tree
  UNION ALL
  SELECT tree, level + 1, {LEVEL} FROM levels WHERE len(nodes) > 1
),
subroots AS (SELECT tree, nodes[1] AS subroot, level AS height FROM levels WHERE len(nodes) = 1),
upper AS (
  SELECT 0 AS level, list(subroot ORDER BY tree) AS nodes FROM subroots
  UNION ALL
  SELECT level + 1, {LEVEL} FROM upper WHERE len(nodes) > 1
),
whole AS (SELECT nodes[1] AS root FROM upper WHERE len(nodes) = 1),
steps AS (
  SELECT tree, pos AS row_pos, level, pos // (3 ** level)::BIGINT AS p, nodes FROM placed JOIN levels USING (tree) WHERE len(nodes) > 1
  UNION ALL
  SELECT tree, pos, height + u.level, (tree - 1) // (3 ** u.level)::BIGINT, u.nodes FROM placed JOIN subroots USING (tree), upper u WHERE len(u.nodes) > 1
),
siblings AS (
  SELECT tree, row_pos, level, array_to_string(nodes[p - p % 3 + 1 : p], '') AS before, array_to_string(nodes[p + 2 : p - p % 3 + 3], '') AS after FROM steps
),
proofs AS (SELECT tree, row_pos AS pos, list(struct_pack(a := before, b := after) ORDER BY level) AS proof FROM siblings GROUP BY ALL)
SELECT doc_id, leaf, subroot, root,
  sha256(array_to_string(list_transform(coalesce(proof, []), lambda x: x.a || x.b), '')) AS proof_sha256,
  list_reduce(coalesce(proof, []), lambda h, x: {{'a': sha256(x.a || h.a || x.b), 'b': ''}}, {{'a': now, 'b': ''}}).a AS folded_root,
  list_reduce(coalesce(proof, []), lambda h, x: {{'a': sha256(x.a || h.a || x.b), 'b': ''}}, {{'a': now, 'b': ''}}).a = root AS verified
FROM placed JOIN subroots USING (tree) LEFT JOIN proofs USING (tree, pos), whole
"""
