"""Taxonomy trees: lineages, ranks, groups, lowest common ancestors, subtrees, closures.

A tree is a table (taxid, parent, rank, name); a root is its own parent. coded() numbers its nodes in preorder and gives
each the last number below it, once, and stored trees keep both. What lies below a node is then a stretch of whole
numbers: subtrees, ranks, groups, closures and common ancestors are joins of places with the stretches that hold them, cut at
multiples of a piece so that they are equi-joins, and no operator handles lists of ancestors. Coding itself derives from paths: for each
taxon the array of its ancestors, which doubling of the known part builds in a number of joins that is the logarithm of the tree's depth.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readlake.operators.sorting import with_row_ids
from readlake.schemas import need
from readlake.session import cut, sized

#: Names of the groups' seed taxa and of the groups.
SEEDS = {"Metazoa": "animals", "Embryophyta": "plants", "Fungi": "fungi", "Bacteria <bacteria>": "bacteria", "Archaea": "archaea"}
#: Longer paths are taken for cycles.
MOST_DEEP = 1 << 12


def paths(nodes: DataFrame) -> DataFrame:
    """(taxid, path): the taxon, its parent and so on up to a root or to a parent that is no node.

    Each round doubles what is known of the paths and cuts the lineage, so the plan stays as small as one
    join however deep the tree; it ends when no path goes on.
    """
    need(nodes, "taxid", "parent")
    up = cut(nodes.select("taxid", F.array("taxid").alias("path"), F.when(F.col("parent") != F.col("taxid"), F.col("parent")).alias("next")))
    while True:
        more, deep = up.agg(F.count("next"), F.max(F.size("path"))).first()
        if deep is not None and deep > MOST_DEEP:
            raise ValueError(f"a path of more than {MOST_DEEP} taxa: the parents go round")
        if not more:
            break
        above = up.select(F.col("taxid").alias("next"), F.col("path").alias("more"), F.col("next").alias("after"))
        up = cut(up.join(above, "next", "left").select("taxid", F.when(F.col("more").isNull(), F.col("path")).otherwise(F.concat("path", "more")).alias("path"), F.col("after").alias("next")))
    return up.select("taxid", "path")


def coded(nodes: DataFrame) -> DataFrame:
    """nodes with place, their number in preorder from 0 on, and last, the greatest place below them or their own; behind a checkpoint.

    Nodes that have both already come back as they are; so operators take coded trees and uncoded ones.
    """
    if {"place", "last"} <= set(nodes.columns):
        return nodes
    order = with_row_ids(paths(nodes).select("taxid", F.reverse("path").alias("path")), "path", row_id="place")
    last = order.select("place", F.explode("path").alias("taxid")).groupBy("taxid").agg(F.max("place").alias("last"))
    return cut(nodes.join(order.select("taxid", "place"), "taxid").join(last, "taxid"))


def holding(points: DataFrame, spans: DataFrame, at: str = "place") -> DataFrame:
    """points with each of the spans (place, last, ...) that holds their place, as columns span_*.

    Spans are cut at multiples of a piece, so it is an equi-join on the piece, whatever share of the places one span holds. The piece
    is about as long as places stand from one span to the next: then as many rows are compared as there are points and spans, and a few
    for each level of spans in spans.
    """
    n, top = spans.agg(F.count(F.lit(1)), F.max("last")).first()
    piece = min(max((top or 0) // max(n, 1), 8), 1 << 16)
    pieces = spans.select(*(F.col(c).alias(f"span_{c}") for c in spans.columns)).withColumn("_piece", F.explode(F.sequence(F.floor(F.col("span_place") / piece), F.floor(F.col("span_last") / piece))))
    return points.withColumn("_piece", F.floor(F.col(at) / piece)).join(pieces, "_piece").where(F.col(at).between(F.col("span_place"), F.col("span_last"))).drop("_piece")


def lineage(nodes: DataFrame) -> DataFrame:
    """(taxid, ancestor, depth): every ancestor-or-self; depth counts from the root."""
    tree = coded(nodes).select("taxid", "place", "last")
    found = holding(tree.select("taxid", "place"), tree)
    depth = found.groupBy("taxid").agg((F.count(F.lit(1)) - 1).cast("int").alias("depth"))
    return found.join(depth.select(F.col("taxid").alias("span_taxid"), "depth"), "span_taxid").select("taxid", F.col("span_taxid").alias("ancestor"), "depth")


def at_rank(nodes: DataFrame, rank: str) -> DataFrame:
    """(taxid, at_rank): the nearest ancestor-or-self of the rank; 0 without one."""
    tree = coded(nodes)
    found = holding(tree.select("taxid", "place"), tree.where(F.col("rank") == rank).select("taxid", "place", "last"))
    nearest = found.groupBy("taxid").agg(F.max_by("span_taxid", "span_place").alias("at_rank"))
    return tree.select("taxid").join(nearest, "taxid", "left").select("taxid", F.coalesce("at_rank", F.lit(0)).alias("at_rank"))


def annotated(nodes: DataFrame, seeds: dict[str, str] = SEEDS) -> DataFrame:
    """nodes, coded, with family (nearest of that rank, or 0) and grp (that of the nearest seed, or null)."""
    tree = coded(nodes)
    by_name = F.create_map(*(F.lit(x) for pair in seeds.items() for x in pair))
    marked = tree.select("taxid", "place", "last", (F.col("rank") == "family").alias("is_family"), by_name[F.col("name")].alias("seed")).where("is_family or seed is not null")
    found = holding(tree.select("taxid", "place"), marked).groupBy("taxid").agg(
        F.max_by("span_taxid", F.when(F.col("span_is_family"), F.col("span_place"))).alias("family"),
        F.max_by("span_seed", F.when(F.col("span_seed").isNotNull(), F.col("span_place"))).alias("grp"),
    )
    return tree.join(found, "taxid", "left").withColumn("family", F.coalesce("family", F.lit(0)))


def lca(taxa: DataFrame, nodes: DataFrame, key: str = "name") -> DataFrame:
    """(key, lca) of the taxa (key, taxid) of each key; null where none is a known node.

    Taxon 0 and unknown ones are passed over. In preorder the lowest common ancestor of a set is that of its least and its
    greatest node, so a key needs the partial minimum and maximum of a number, and no list of its taxa. Of each pair of such
    nodes it is the last node up to the one whose stretch holds the other too, looked up once for the pair.
    """
    tree = coded(nodes).select("taxid", "place", "last")
    ends = taxa.join(sized(tree.select("taxid", "place")), "taxid", "left").groupBy(key).agg(F.min(F.when(F.col("taxid") != 0, F.col("place"))).alias("low"), F.max(F.when(F.col("taxid") != 0, F.col("place"))).alias("high"))
    pairs = ends.where("low is not null").select("low", "high").distinct()
    found = holding(pairs, tree, "low").where("span_last >= high").groupBy("low", "high").agg(F.max_by("span_taxid", "span_place").alias("lca"))
    return ends.join(found, ["low", "high"], "left").select(key, "lca")


def closure(taxa: DataFrame, nodes: DataFrame) -> DataFrame:
    """The nodes, coded, that the taxa (taxid) and their ancestors make up; 0 and unknown taxa are none."""
    tree = coded(nodes)
    used = taxa.where("taxid <> 0").select("taxid").distinct().join(tree.select("taxid", "place"), "taxid").select("place")
    return tree.join(holding(used, tree.select("taxid", "place", "last")).select(F.col("span_taxid").alias("taxid")).distinct(), "taxid", "left_semi")


def subtree(nodes: DataFrame, root: int) -> DataFrame:
    """(taxid) of the taxon and all below it: a stretch of places."""
    tree = coded(nodes)
    own = tree.where(F.col("taxid") == root).select(F.col("place").alias("_a"), F.col("last").alias("_z"))
    return tree.join(F.broadcast(own), F.col("place").between(F.col("_a"), F.col("_z"))).select("taxid")  # a row for the root


def write_subset(nodes: DataFrame, path: str) -> None:
    """A part of a tree as a table, ordered by taxid; the places of a coded one stay right."""
    nodes.orderBy("taxid").write.mode("overwrite").parquet(path)


def read_subset(spark: SparkSession, path: str, gaps: bool = False) -> DataFrame:
    """What write_subset has written. With gaps, numbers between the least and the greatest that are no taxa come
    as nodes without a parent, under names of their own (z and the number)."""
    nodes = spark.read.parquet(path)
    if not gaps:
        return nodes
    a, z = nodes.agg(F.min("taxid"), F.max("taxid")).first()
    if a is None:
        return nodes
    free = spark.range(a, z + 1).select(F.col("id").cast("int").alias("taxid")).join(nodes.select("taxid"), "taxid", "left_anti")
    return nodes.unionByName(free.withColumn("name", F.concat(F.lit("z"), F.col("taxid").cast("string"))), allowMissingColumns=True)
