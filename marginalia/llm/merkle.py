"""Merkle manifest of a dataset: leaves of rows, trees of a fixed arity for every language, one tree over their roots, and proofs.

Built levels are stored as node rows linked to their parents: a node's children's digests, its parent and its slot there. A recursive
query climbs from every leaf at once: each round joins all leaves to the next node of their paths, takes the siblings of the run and folds the
(perhaps tampered) digest with them, until a node without a parent is reached. A round's rows hold that round's siblings only.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.settle import settle
from .order import few, numbered

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
_BYTES = 32  # of a digest
_LEVEL_BITS = 5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _field(x: Column) -> Column:
    text = x.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(text: Column | None = None) -> Column:
    """Digest of one row; ``text`` in place of its own text."""
    return F.sha2(F.concat(*[_field(text if text is not None and c == "text" else F.col(c)) for c in FIELDS]), 256)


def _node(tree: Column, level: Column, at: Column, arity: int) -> Column:
    """One long for a node: the number of its first leaf, and its level. Trees over roots are numbered from -1 down."""
    leaf = (at * F.pow(F.lit(arity), level).cast("long")).cast("long")
    return F.when(tree < 0, -F.shiftleft(leaf + 1, _LEVEL_BITS) - level).otherwise(F.shiftleft(tree + leaf, _LEVEL_BITS) + level)


def build(bottom: DataFrame, arity: int) -> tuple[DataFrame | None, DataFrame]:
    """Trees over ``bottom`` (tree, at, n, digest), ``n`` rows a tree. Returns the inner nodes (tree, level, at, n, kids), where ``n`` is how many
    nodes that tree has on that level, and the tops (tree, level, digest). Every level is written once and is an ``arity``-th of the one below."""
    rows, level, nodes, tops = bottom.select("tree", "at", "n", "digest"), 0, None, None
    while True:
        done = rows.where("n = 1").select("tree", F.lit(level).alias("level"), "digest")
        tops = done if tops is None else tops.unionByName(done)
        runs = rows.where("n > 1").groupBy("tree", F.floor(F.col("at") / arity).alias("at"), F.ceil(F.col("n") / arity).alias("n"))
        kids = F.array_sort(F.collect_list(F.struct("at", "digest")))
        upper = settle(runs.agg(F.array_join(kids["digest"], "").alias("kids")))
        level += 1
        if upper.isEmpty():
            return nodes, settle(tops)
        here = upper.select("tree", F.lit(level).alias("level"), "at", "n", "kids")
        nodes = here if nodes is None else nodes.unionByName(here)
        rows = upper.withColumn("digest", F.sha2("kids", 256))


def _linked(nodes: DataFrame, links: DataFrame, arity: int) -> DataFrame:
    """``nodes`` (tree, level, at, n) with parent ``up`` and slot there. The top of a tree hangs where ``links`` (tree, up, slot) says."""
    joined = nodes.join(links.select("tree", F.col("up").alias("_up"), F.col("slot").alias("_slot")), "tree", "left")
    inner = _node(F.col("tree"), F.col("level") + 1, F.floor(F.col("at") / arity), arity)
    return joined.select(
        *nodes.columns, F.when(F.col("n") > 1, inner).otherwise(F.col("_up")).alias("up"),
        F.when(F.col("n") > 1, F.pmod("at", F.lit(arity))).otherwise(F.col("_slot")).cast("int").alias("slot"))


@contextmanager
def _rows_unlimited(spark: SparkSession):
    """Spark ends a recursive query at a row limit; a climb has a row for every leaf and step."""
    name = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "-1")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


_CLIMB = f"""
WITH RECURSIVE climb (leaf_row, step, up, slot, folded, siblings) AS (
  SELECT leaf_row, 0, up, slot, unhex(claimed), CAST(NULL AS BINARY) FROM {{leaves}}
  UNION ALL
  SELECT c.leaf_row, c.step + 1, n.up, n.slot,
    unhex(sha2(lower(hex(substring(n.kids, 1, {_BYTES} * c.slot) || c.folded || substring(n.kids, {_BYTES} * c.slot + {_BYTES + 1}))), 256)),
    substring(n.kids, 1, {_BYTES} * c.slot) || substring(n.kids, {_BYTES} * c.slot + {_BYTES + 1})
  FROM climb c JOIN {{nodes}} n ON c.up = n.node)
SELECT leaf_row, step, folded, siblings FROM climb"""


def climb(leaves: DataFrame, nodes: DataFrame) -> DataFrame:
    """(leaf_row, folded, proof): what every leaf (leaf_row, up, slot, claimed) folds to at the end of its path over ``nodes`` (node, up, slot, kids), and
    the siblings of the path in one binary. Leaves below one node share its key, in the end as many as a language has: a join to one row a
    key, which Spark splits when it is skewed."""
    with _rows_unlimited(leaves.sparkSession):
        steps = leaves.sparkSession.sql(_CLIMB, leaves=leaves, nodes=nodes)
        path = F.array_sort(F.collect_list(F.when(F.col("siblings").isNotNull(), F.struct("step", "siblings"))))
        ends = steps.groupBy("leaf_row").agg(path.alias("path"), F.max_by("folded", "step").alias("folded"))
        proof = F.sha2(F.array_join(F.transform("path", lambda p: F.lower(F.hex(p["siblings"]))), ""), 256)
        return settle(ends.select("leaf_row", F.lower(F.hex("folded")).alias("folded"), proof.alias("proof_sha256")))


def manifest(docs: DataFrame, tampered: Column | None = None, arity: int = 8) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified for every row of ``docs``.

    ``tampered``: a text to verify in place of the row's own (null keeps the row). Nulls of any column are part of the digest; texts
    of any length count in whole, empty ones differ from null ones. Rows with one doc_id follow each other by digest, so repeated rows are
    alike whatever their places. An empty table gives an empty result. Other columns take no part.
    """
    langs = F.struct(F.col("lang").isNotNull().alias("given"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"))
    other = F.lit(None).cast("string") if tampered is None else F.when(tampered.isNotNull(), leaf_digest(tampered))
    rows = docs.select(*[F.col(c) for c in FIELDS]).select("doc_id", langs.alias("group"), leaf_digest().alias("leaf"), other.alias("told"))
    rows = rows.withColumn("told", F.when(F.col("told") != F.col("leaf"), F.col("told")))
    leaves = settle(numbered(rows, "group", ["doc_id", "leaf"]).select(
        "doc_id", "leaf", "told", F.col("first").alias("tree"), "at", "n", (F.col("first") + F.col("at")).alias("leaf_row")))
    inner, tops = build(leaves.withColumnRenamed("leaf", "digest"), arity)
    heads = settle(numbered(tops.withColumn("group", F.lit(0)), "group", ["tree"]).select("tree", F.col("digest").alias("subroot"), "at", "n"))
    upper, top = build(heads.select(F.lit(-1).cast("long").alias("tree"), "at", "n", F.col("subroot").alias("digest")), arity)
    root = top.select("digest").first()
    root = F.lit(root["digest"] if root else None).cast("string")
    many = F.col("n") > 1
    links = few(settle(heads.select(
        "tree", "subroot", F.when(many, _node(F.lit(-1), F.lit(1), F.floor(F.col("at") / arity), arity)).alias("up"),
        F.when(many, F.pmod("at", F.lit(arity))).cast("int").alias("slot"))))
    nodes = docs.sparkSession.createDataFrame([], "node long, up long, slot int, kids binary")
    for level, way in ((inner, links), (upper, links.where("false"))):
        if level is not None:
            named = _node(F.col("tree"), F.col("level"), F.col("at"), arity).alias("node")
            nodes = nodes.unionByName(_linked(level, way, arity).select(named, "up", "slot", F.unhex("kids").alias("kids")))
    nodes = settle(nodes.repartition("node", "up"))  # every round reads them, so not as one part for each level's parts
    placed = _linked(leaves.withColumn("level", F.lit(0)), links, arity)
    ends = climb(placed.select("leaf_row", "up", "slot", F.coalesce("told", "leaf").alias("claimed")), nodes)
    out = leaves.join(links.select("tree", "subroot"), "tree").join(ends, "leaf_row")
    return out.select("doc_id", "leaf", "subroot", root.alias("root"), "proof_sha256", F.col("folded").alias("folded_root"), (F.col("folded") == root).alias("verified"))


def lowered_third(doc_id: str = "doc_id", text: str = "text") -> Column:
    """The text in small letters where three divides the check sum of the id, else null."""
    return F.when(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(3)) == 0, F.translate(text, _UPPER, _LOWER))
