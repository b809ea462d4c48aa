"""Hierarchies: nodes(node, parent, ord), the root's parent null.

Everything follows from each node's path, the nodes from the root down with their places
among their siblings. Paths are built level by level with one join each; a tree's depth, not
its size, is the number of rounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .ordered import placed


class Tree:
    def __init__(self, nodes: DataFrame) -> None:
        """ord orders siblings (ties by node); without it, the node does."""
        place = F.col("ord") if "ord" in nodes.columns else F.lit(0)
        self.nodes = nodes.select("node", "parent", F.row_number().over(Window.partitionBy("parent").orderBy(place, "node")).alias("place"))
        self._paths: DataFrame | None = None

    @property
    def paths(self) -> DataFrame:
        """node, parent, depth, path (from the root, itself included), places (of those below the root)."""
        if self._paths is None:
            nodes = cut(self.nodes)
            level = cut(nodes.where("parent is null").select("node", "parent", F.lit(0).alias("depth"), F.array("node").alias("path"), F.array().cast("array<int>").alias("places")))
            out = level
            while True:
                above = level.select(F.col("node").alias("parent"), "depth", "path", "places")
                level = cut(nodes.join(above, "parent").select("node", "parent", (F.col("depth") + 1).alias("depth"), F.concat("path", F.array("node")).alias("path"), F.concat("places", F.array("place")).alias("places")))
                if level.isEmpty():
                    break
                out = out.unionByName(level)
            self._paths = out
        return self._paths

    def add(self, nodes: DataFrame) -> Tree:
        """With further nodes (node, parent), behind their siblings. A parent that neither the
        tree nor the new nodes have becomes a node of its own below the root. In an empty tree the
        node without a parent is the root; without such a node the parents that nobody names are."""
        known = self.nodes.select("node", "parent", F.col("place").cast("long").alias("ord"))
        new = nodes.select("node", "parent")
        have = known.select("node").union(new.select("node"))
        unknown = new.where("parent is not null").select(F.col("parent").alias("node")).distinct().join(have, "node", "left_anti")
        root = known.where("parent is null").first()
        above = F.lit(root.node if root else None).cast(self.nodes.schema["node"].dataType)
        late = F.lit(2**40)
        rows = known.unionByName(new.withColumn("ord", late)).unionByName(unknown.select("node", above.alias("parent"), late.alias("ord")))
        return Tree(rows)

    def _without(self, gone: DataFrame) -> Tree:
        return Tree(self.nodes.join(gone, "node", "left_anti").select("node", "parent", F.col("place").alias("ord")))

    def remove(self, nodes: DataFrame) -> Tree:
        """Without the nodes and all below them."""
        return self._without(self.below(nodes).select("node").distinct())

    def remove_where(self, test: Column) -> Tree:
        """Without the nodes (node, parent, place from 1) that a test holds for, and all below them."""
        return self.remove(self.nodes.where(test).select("node"))

    def remove_first(self, parents: DataFrame) -> Tree:
        """Without the first child of each of parents (node)."""
        return self.remove_at(parents.select("node", F.lit(0).alias("place")))

    def remove_last(self, parents: DataFrame) -> Tree:
        last = self.nodes.groupBy("parent").agg(F.max(F.struct("place", "node")).alias("l")).select(F.col("parent").alias("node"), F.col("l.node").alias("child"))
        return self.remove(parents.select("node").join(last, "node").select(F.col("child").alias("node")))

    def remove_at(self, places: DataFrame) -> Tree:
        """Without the children at places (node, place from 0); a place that isn't there does nothing."""
        at = places.select(F.col("node").alias("parent"), (F.col("place") + 1).alias("place")).distinct()
        return self.remove(self.nodes.join(at, ["parent", "place"], "left_semi").select("node"))

    def remove_children(self, parents: DataFrame) -> Tree:
        """Without all that is below parents (node), which stay."""
        own = parents.select(F.col("node").alias("parent")).distinct()
        return self.remove(self.nodes.join(own, "parent", "left_semi").select("node"))

    def below(self, nodes: DataFrame) -> DataFrame:
        """top, node: the nodes of each subtree, its top included."""
        closure = self.closure()
        return closure.join(nodes.select(F.col("node").alias("top")), "top", "left_semi").select("top", "node")

    def closure(self) -> DataFrame:
        """top, node: every node with each of its ancestors and itself; rows are nodes times depth."""
        return self.paths.select("node", F.explode("path").alias("top"))

    def depths(self) -> DataFrame:
        return self.paths.select("node", "depth")

    def heights(self) -> DataFrame:
        """node, height: levels below the node to its deepest descendant."""
        deep = self.paths.select("depth", F.explode("path").alias("node")).groupBy("node").agg(F.max("depth").alias("deepest"))
        return self.paths.join(deep, "node").select("node", (F.col("deepest") - F.col("depth")).alias("height"))

    def leaves(self) -> DataFrame:
        return self.nodes.join(self.nodes.select(F.col("parent").alias("node")), "node", "left_anti").select("node")

    def counts(self) -> DataFrame:
        """node, descendant_count (without itself), leaf_count (a leaf counts itself)."""
        leaf = self.leaves().withColumn("leaf", F.lit(1))
        return self.closure().join(leaf, "node", "left").groupBy("top").agg((F.count("*") - 1).alias("descendant_count"), F.count("leaf").alias("leaf_count")).withColumnRenamed("top", "node")

    def sums(self, values: DataFrame, strict: bool = True) -> DataFrame:
        """node, total of the values (node, value) of its subtree; what isn't finite raises, or counts 0."""
        odd = F.isnan("value") | F.abs("value").isin(float("inf"))
        if strict and not values.where(odd).isEmpty():
            raise ValueError("a value is not finite")
        clean = values.select("node", F.when(odd, 0.0).otherwise(F.col("value")).alias("value"))
        return self.closure().join(clean, "node", "left").groupBy(F.col("top").alias("node")).agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("total"))

    def ancestors(self, nodes: DataFrame) -> DataFrame:
        """node, ancestor, steps: from the node itself (0) up to the root."""
        rows = self.paths.join(nodes.select("node"), "node", "left_semi")
        return rows.select("node", F.posexplode(F.reverse("path")).alias("steps", "ancestor"))

    def lca(self, pairs: DataFrame) -> DataFrame:
        """a, b, lca: the lowest node above or equal to both."""
        of = lambda k: self.paths.select(F.col("node").alias(k), F.col("path").alias(f"path_{k}"))
        both = pairs.join(of("a"), "a").join(of("b"), "b")
        return both.select("a", "b", F.element_at(F.array_intersect("path_a", "path_b"), -1).alias("lca"))

    def find_path(self, pairs: DataFrame) -> DataFrame:
        """a, b, path: from a up to their lowest common ancestor and down to b."""
        of = lambda k: self.paths.select(F.col("node").alias(k), F.col("path").alias(f"path_{k}"))
        both = pairs.join(of("a"), "a").join(of("b"), "b")
        common = F.array_intersect("path_a", "path_b")
        up = F.reverse(F.array_except("path_a", common))
        return both.select("a", "b", F.concat(up, F.array(F.element_at(common, -1)), F.array_except("path_b", common)).alias("path"))

    def at_depth(self, depth: int, only: bool = True) -> DataFrame:
        return self.paths.where(F.col("depth") == depth if only else F.col("depth") >= 0).select("node", "depth")

    def links(self) -> DataFrame:
        return self.nodes.where("parent is not null").select("parent", F.col("node").alias("child"))

    def preorder(self) -> DataFrame:
        """node, places: parents first; in the order of places."""
        return self.paths.select("node", "places")

    def postorder(self) -> DataFrame:
        """node, key: children first; in the order of key (a closing mark sorts after all children)."""
        return self.paths.select("node", F.concat("places", F.array(F.lit(2**31 - 1))).alias("key"))

    def level_order(self) -> DataFrame:
        """node, depth, places: in the order of (depth, places)."""
        return self.paths.select("node", "depth", "places")

    def ranks(self) -> DataFrame:
        """node, preorder, postorder, level_order: its places in the three traversals, from 0; the
        roots of a forest come in their order.

        A node comes after its ancestors and all that is below earlier siblings of theirs and its
        own. Levels are ranked by preorder, over ranges of it sorted side by side.
        """
        sizes = self.counts().select("node", (F.col("descendant_count") + 1).alias("size"))
        before = Window.partitionBy("parent").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
        nodes = cut(self.nodes.join(sizes, "node").withColumn("earlier", F.coalesce(F.sum("size").over(before), F.lit(0))).select("node", "size", "earlier"))
        way = self.paths.select(F.col("node").alias("low"), "depth", F.explode("path").alias("node"))
        pre = way.join(nodes.select("node", "earlier"), "node").groupBy(F.col("low").alias("node"), "depth").agg(F.sum("earlier").alias("earlier"))
        pre = pre.withColumn("preorder", F.col("earlier") + F.col("depth")).drop("earlier")
        levels = placed(pre, "depth", "preorder").withColumn("level_order", F.col("place") - 1)
        return levels.join(nodes, "node").select("node", "preorder", (F.col("preorder") + F.col("size") - 1 - F.col("depth")).alias("postorder"), "level_order")

    def find(self, test: Column, limit: int | None = None) -> DataFrame:
        rows = self.paths.where(test).orderBy("depth", "places")
        return (rows if limit is None else rows.limit(limit)).select("node", "depth")

    def sorted(self, by: Column) -> Tree:
        return Tree(self.nodes.withColumn("ord", by).select("node", "parent", "ord"))

    def ends(self) -> DataFrame:
        """node, leaf_left, leaf_right: the first and last leaf of each subtree in order."""
        leaf = self.paths.join(self.leaves(), "node", "left_semi").select(F.struct("places", "node").alias("l"), F.explode("path").alias("top"))
        return leaf.groupBy(F.col("top").alias("node")).agg(F.min("l").alias("a"), F.max("l").alias("b")).select("node", F.col("a.node").alias("leaf_left"), F.col("b.node").alias("leaf_right"))

    def children(self) -> DataFrame:
        """node, child_count, first_child, last_child, place (from 0)."""
        own = self.nodes.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("child_count"), F.min(F.struct("place", "node")).alias("a"), F.max(F.struct("place", "node")).alias("b"))
        return self.nodes.join(own, "node", "left").select("node", F.coalesce("child_count", F.lit(0)).alias("child_count"), F.col("a.node").alias("first_child"), F.col("b.node").alias("last_child"), (F.col("place") - 1).alias("place"))

    def deepest(self) -> DataFrame:
        """node, depth of the deepest node, the first in level order."""
        return self.paths.orderBy(F.desc("depth"), "places").limit(1).select("node", "depth")

    def compute(self) -> DataFrame:
        """node, depth, height, descendant_count, leaf_count and place, all at once."""
        return self.depths().join(self.heights(), "node").join(self.counts(), "node").join(self.nodes.select("node", (F.col("place") - 1).alias("place")), "node")

    def expanded(self, flags: DataFrame) -> DataFrame:
        """node, expand: a flag (node, expand) holds for the whole subtree; of several, the nearest above."""
        rows = self.paths.select("node", F.posexplode("path").alias("k", "top")).join(flags.select(F.col("node").alias("top"), "expand"), "top", "left")
        return rows.groupBy("node").agg(F.coalesce(F.max(F.when(F.col("expand").isNotNull(), F.struct("k", "expand")))["expand"], F.lit(True)).alias("expand"))
