"""Graphs as vertices(id) and edges(src, dst, weight), and algorithms as rounds of joins.

Each round is one set-wise step over all that changed in the last; its result is written to
the checkpoint folder, so plans stay small and lost executors cost one round. Parallel edges
are kept: paths use the lightest, flows add them up. What can't be reached has no row.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import brief_shuffles, cut, drop_stored, stored
from . import all_pairs

#: A round of depth-first search loads all open edges if they are at most WALK_EDGES; else
#: those of at most WALK vertices and WALK open calls, at most FAN of one vertex at a time.
WALK_EDGES, WALK, FAN = 5_000_000, 20_000, 100
#: Edges of one vertex that a join meets in one part.
HUB = 10_000


def _walker(whole: bool, base: int, count: int):
    """A step of depth-first search: takes rows (src, dst, turn, depth) of neighbours not yet
    visited and of open calls, those from depth base on, and gives the vertices visited, with
    ord from count on, and the calls that are open at the end, with depth. Unless all is there
    (whole), it knows the neighbours of vertices with a row, and at most FAN of each. Rows of
    turn 0 name no neighbour; -1 stands for no depth and no ord."""

    def walk(group: pd.DataFrame) -> pd.DataFrame:
        stack = group[group.depth >= 0].sort_values("depth").src.tolist()
        beside: dict = {v: [] for v in group.src}
        cut_off = set()
        for v, w, turn in group[group.turn > 0].sort_values("dst", ascending=False)[["src", "dst", "turn"]].itertuples(index=False):
            if whole or turn <= FAN:
                beside[v].append(w)
            else:
                cut_off.add(v)
        seen, ordered = set(), []
        while stack:
            v = stack[-1]
            if v not in beside and not whole:
                break
            rest = beside.get(v, [])
            while rest and rest[-1] in seen:
                rest.pop()
            if rest:
                stack.append(rest.pop())
                seen.add(stack[-1])
                ordered.append(stack[-1])
            elif v in cut_off:
                break
            else:
                stack.pop()
        n, m = len(ordered), len(stack)
        return pd.DataFrame({"id": pd.Series(ordered + stack, dtype=object), "ord": [*range(count, count + n), *[-1] * m], "depth": [*[-1] * n, *range(base, base + m)]})

    return walk


class Graph:
    """edges has src, dst and weight (0 if missing); vertices has id, and is completed by the edges' ends."""

    def __init__(self, edges: DataFrame, vertices: DataFrame | None = None, directed: bool = True) -> None:
        if "weight" not in edges.columns:
            edges = edges.withColumn("weight", F.lit(0.0))
        self.given, self.directed = edges.select("src", "dst", "weight"), directed
        ends = edges.select(F.col("src").alias("id")).union(edges.select("dst"))
        self.vertices = (ends if vertices is None else vertices.select("id").union(ends)).distinct()
        self._light: DataFrame | None = None
        self._between: DataFrame | None = None
        self._checked = False

    @property
    def spark(self) -> SparkSession:
        return self.given.sparkSession

    @property
    def edges(self) -> DataFrame:
        """src, dst, weight; an undirected graph lists each edge both ways."""
        if self.directed:
            return self.given
        return self.given.union(self.given.where("src <> dst").select("dst", "src", "weight"))

    @staticmethod
    def of_matrix(cells: DataFrame, size: int) -> Graph:
        """The directed graph of a 0/1 adjacency matrix given as rows (i, j, value); its vertices
        are 0 to size - 1. bfs and dfs of it are the traversals of the matrix."""
        edges = cells.where("value <> 0").select(F.col("i").alias("src"), F.col("j").alias("dst")).withColumn("weight", F.lit(1.0))
        vertices = cells.sparkSession.range(size).select(F.col("id").cast(edges.schema["src"].dataType))
        return Graph(edges, vertices)

    # construction and lookup

    def add_edges(self, edges: DataFrame) -> Graph:
        return Graph(self.given.unionByName(edges.select("src", "dst", "weight")), self.vertices, self.directed)

    def add_vertices(self, vertices: DataFrame) -> Graph:
        return Graph(self.given, self.vertices.union(vertices.select("id")), self.directed)

    def remove_vertices(self, ids: DataFrame) -> Graph:
        """Without the vertices and all their edges."""
        gone = ids.select("id").distinct()
        edges = self.given.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
        return Graph(edges.select("src", "dst", "weight"), self.vertices.join(gone, "id", "left_anti"), self.directed)

    def degrees(self) -> DataFrame:
        """id, degree (out-degree if directed); vertices without edges have 0."""
        counts = self.edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
        return self.vertices.join(counts, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))

    def paths_to(self, pairs: DataFrame) -> DataFrame:
        """The (src, dst) pairs that an edge joins."""
        return pairs.join(self.edges.select("src", "dst"), ["src", "dst"], "left_semi")

    def equals(self, other: Graph) -> bool:
        same = lambda a, b: a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
        return self.directed == other.directed and same(self.vertices, other.vertices) and same(self.edges, other.edges)

    # shortest paths

    def _check_weights(self) -> None:
        if not self._checked and not self.edges.where("weight < 0").isEmpty():
            raise ValueError("Negative cost edges are not allowed.")
        self._checked = True

    def _lightest(self, edges: DataFrame | None = None) -> DataFrame:
        """src, dst, weight, hops, last of the lightest edge of each pair; one without a weight isn't used.
        Those of the graph itself are stored once for all its searches."""
        if edges is None:
            if self._light is None:
                self._light = self._lightest(self.edges)
            return self._light
        light = edges.where("weight is not null").groupBy("src", "dst").agg(F.min(F.col("weight").cast("double")).alias("weight"))
        return stored(light.select("src", "dst", "weight", F.lit(1).alias("hops"), F.col("src").alias("last")))

    def _search(self, start: DataFrame, edges: DataFrame, width: float | None = None, goal=None, bounds: DataFrame | None = None, rounds: int | None = None) -> DataFrame:
        """source, id, dist, hops, before of what start(source, id, dist) reaches over edges as of
        _lightest; of equal distances that with the fewest edges, then the least vertex before.

        A row knows the vertex before it, not its path. A round goes on from the vertices that
        changed and whose estimates are within `width` of the least (from all that changed, without
        one); the others wait, so that few are taken up twice. With a goal it ends once none that
        waits can beat it. An estimate is the distance and the bound (id, bound) of the rest. An
        improvement after `rounds` rounds means a negative cycle.
        """
        kind = self.vertices.schema["id"].dataType.simpleString()
        rest = lambda rows: rows.withColumn("bound", F.lit(0.0)) if bounds is None else rows.join(bounds.select("id", "bound"), "id", "left").fillna(0.0, ["bound"])
        first = start.select("source", "id", F.col("dist").cast("double").alias("dist"), F.lit(0).alias("hops"), F.lit(None).cast(kind).alias("before"))
        best = stored(rest(first).select("*", F.lit(True).alias("waits")))
        estimate, done = F.col("dist") + F.col("bound"), 0
        while True:
            low, reached = best.agg(F.min(F.when(F.col("waits"), estimate)), F.min(F.when(F.col("id") == F.lit(goal), F.col("dist")))).first()
            if low is None or reached is not None and low >= reached:
                return best.select("source", "id", "dist", "hops", "before")
            if rounds is not None and done >= rounds:
                raise ValueError("Graph contains a negative weight cycle.")
            done += 1
            now = F.col("waits") if width is None else F.col("waits") & (estimate <= low + width)
            on = best.where(now).select("source", F.col("id").alias("src"), F.col("dist").alias("so_far"), F.col("hops").alias("steps")).join(edges, "src")
            way = F.struct((F.col("so_far") + F.col("weight")).alias("dist"), (F.col("steps") + F.col("hops")).alias("hops"), F.col("last").alias("before"))
            step = rest(on.groupBy("source", F.col("dst").alias("id")).agg(F.min(way).alias("new"))).withColumnRenamed("bound", "ahead")
            merged = best.withColumn("waits", F.col("waits") & ~now).join(step, ["source", "id"], "full")
            better = F.col("new").isNotNull() & (F.col("dist").isNull() | (F.col("new") < F.struct("dist", "hops", "before")))
            nearer = better & (F.col("dist").isNull() | (F.struct("new.dist", "new.hops") < F.struct("dist", "hops")))
            pick = lambda name: F.when(better, F.col(f"new.{name}")).otherwise(F.col(name)).alias(name)  # noqa: E731, B023
            last, best = best, stored(merged.select("source", "id", pick("dist"), pick("hops"), pick("before"), F.coalesce("bound", "ahead").alias("bound"), F.when(nearer, True).otherwise(F.col("waits")).alias("waits")))
            drop_stored(last)

    def _nearest(self, start, goal=None, edges: DataFrame | None = None) -> DataFrame:
        """_search from one vertex over weights not below 0. Runs of vertices with two neighbours
        are one step in it, so its rounds don't grow with their lengths."""
        edges = self._lightest() if edges is None else edges
        ends = self.vertices.where(F.col("id").isin(start, goal) if goal is not None else F.col("id") == F.lit(start))
        if edges is not self._light:
            between = self._two_sided(edges)
        else:
            between = self._between = self._two_sided(edges) if self._between is None else self._between
        runs, along = self._runs(edges, ends, between)
        width = edges.agg(F.avg("weight")).first()[0]
        found = self._search(self._from(start), runs, width, goal)
        if along is None:
            return found
        found = stored(found)
        inner = found.select("source", F.col("id").alias("src"), F.col("dist").alias("so_far"), F.col("hops").alias("steps")).join(along, "src")
        way = F.struct((F.col("so_far") + F.col("weight")).alias("dist"), (F.col("steps") + F.col("hops")).alias("hops"), F.col("last").alias("before"))
        return stored(found.unionByName(inner.groupBy("source", F.col("dst").alias("id")).agg(F.min(way).alias("new")).select("source", "id", "new.*")))

    @staticmethod
    def _two_sided(edges: DataFrame) -> DataFrame:
        """id, a, b of the vertices with just two neighbours."""
        edges = edges.where("src <> dst")
        sides = edges.select(F.col("src").alias("id"), F.col("dst").alias("other")).union(edges.select("dst", "src")).distinct()
        return stored(sides.groupBy("id").agg(F.count("*").alias("n"), F.min("other").alias("a"), F.max("other").alias("b")).where("n = 2").select("id", "a", "b"))

    @staticmethod
    def _runs(edges: DataFrame, ends: DataFrame, between: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        """Edges in which each run through vertices with just two neighbours (but the ends) is one,
        from src to dst with the weight and hops of all of it, and those that lead from the start of
        a run to each vertex inside; None if there is none. Each edge finds the start of its run by
        pointer doubling, in as many rounds as the longest run's length has binary digits."""
        edges = edges.where("src <> dst")
        inner = stored(between.join(ends, "id", "left_anti"))
        if inner.isEmpty():
            return edges, None
        of = edges.join(inner.withColumnRenamed("id", "src"), "src", "left")
        came = F.when(F.col("dst") == F.col("a"), F.col("b")).otherwise(F.col("a"))
        state = of.select("src", "dst", "weight", "hops", "last", F.when(F.col("a").isNull(), F.col("src")).alias("head"), F.when(F.col("a").isNotNull(), came).alias("from_src"), F.when(F.col("a").isNotNull(), F.col("src")).alias("from_dst"))
        headed, open_ = stored(state.where("head is not null")), stored(state.where("head is null"))
        left = open_.count()
        while left:
            all_ = headed.unionByName(open_)
            back = all_.select(F.col("src").alias("from_src"), F.col("dst").alias("from_dst"), F.col("weight").alias("w"), F.col("hops").alias("h"), F.col("head").alias("begin"), F.col("from_src").alias("next_src"), F.col("from_dst").alias("next_dst"))
            moved = stored(open_.join(back, ["from_src", "from_dst"]).select("src", "dst", (F.col("weight") + F.col("w")).alias("weight"), (F.col("hops") + F.col("h")).alias("hops"), "last", F.col("begin").alias("head"), F.col("next_src").alias("from_src"), F.col("next_dst").alias("from_dst")))
            headed, open_ = stored(headed.unionByName(moved.where("head is not null"))), moved.where("head is null")
            before, left = left, open_.count()
            if left == before:  # what is left runs in circles that no run leads into
                break
        headed = headed.select(F.col("head").alias("src"), "dst", "weight", "hops", "last").where("src <> dst")
        inside = inner.select(F.col("id").alias("dst"))
        least = F.min(F.struct("weight", "hops", "last")).alias("e")
        runs = headed.join(inside, "dst", "left_anti").groupBy("src", "dst").agg(least).select("src", "dst", "e.*")
        return stored(runs), headed.join(inside, "dst", "left_semi")

    def _ways(self, found: DataFrame, goals: DataFrame) -> DataFrame:
        """source, goal, id, before, hops of the goals (source, id) and of all vertices before them
        but the start, by pointer doubling: rounds grow with the logarithm of the way."""
        steps = found.where("before is not null")
        jump = stored(steps.select("source", "id", F.col("before").alias("far")))
        on = stored(goals.select("source", F.col("id").alias("goal"), "id"))
        while True:
            more = stored(on.join(jump, ["source", "id"]).select("source", "goal", F.col("far").alias("id")))
            if more.isEmpty():
                return on.join(steps.select("source", "id", "before", "hops"), ["source", "id"])
            on = stored(on.union(more))
            jump = stored(jump.join(jump.select("source", F.col("id").alias("far"), F.col("far").alias("next")), ["source", "far"]).select("source", "id", F.col("next").alias("far")))

    def _with_paths(self, found: DataFrame, edges: DataFrame, goals: DataFrame | None = None) -> DataFrame:
        """source, id, dist, path (edges from the start) of the goals, or of all that was found."""
        found = stored(found)
        rows = found if goals is None else found.join(goals.select("source", "id"), ["source", "id"], "left_semi")
        ways = self._ways(found, rows).select("source", F.col("goal").alias("id"), "hops", F.col("before").alias("src"), F.col("id").alias("dst"))
        ways = ways.join(edges.select("src", "dst", "weight"), ["src", "dst"])
        path = F.transform(F.sort_array(F.collect_list(F.struct("hops", "src", "dst", "weight"))), lambda e: F.struct(e["src"].alias("src"), e["dst"].alias("dst"), e["weight"].alias("weight")))
        paths = ways.groupBy("source", "id").agg(path.alias("path"))
        none = F.array().cast(paths.schema["path"].dataType)
        return rows.join(paths, ["source", "id"], "left").select("source", "id", "dist", F.coalesce("path", none).alias("path"))

    def _from(self, start) -> DataFrame:
        one = self.vertices.where(F.col("id") == F.lit(start))
        return one.select(F.col("id").alias("source"), "id", F.lit(0.0).alias("dist"))

    def _to(self, start, goal) -> DataFrame:
        return self.vertices.where(F.col("id") == F.lit(goal)).select(F.lit(start).cast(self.vertices.schema["id"].dataType).alias("source"), "id")

    def distances(self, start) -> DataFrame:
        """id, dist, hops, before: the distance from start, the edges on the way and the vertex
        before (null at the start); of equal costs the way with the fewest edges, then the least
        vertex before. path_to makes paths of it."""
        self._check_weights()
        return self._nearest(start).drop("source")

    def path_to(self, found: DataFrame, goals: DataFrame) -> DataFrame:
        """id, dist, path to each of goals (id), from a table as of distances."""
        one = lambda rows: rows.withColumn("source", F.lit(0))
        return self._with_paths(one(found), self._lightest(), one(goals)).drop("source")

    def dijkstra(self, start) -> DataFrame:
        """id, dist, path from start; of equal costs the path with the fewest edges, then the least
        vertex before. The paths of all hold as many edges as they are long: distances has none."""
        self._check_weights()
        edges = self._lightest()
        return self._with_paths(self._nearest(start, edges=edges), edges).drop("source")

    def dijkstra_pair(self, start, end) -> DataFrame:
        self._check_weights()
        edges = self._lightest()
        return self._with_paths(self._nearest(start, end, edges), edges, self._to(start, end)).drop("source")

    def _any_weights(self, start) -> DataFrame:
        return self._search(self._from(start), self._lightest(), rounds=self.vertices.count())

    def bellman_ford(self, start) -> DataFrame:
        """As dijkstra; weights may be negative, negative cycles raise."""
        return self._with_paths(self._any_weights(start), self._lightest()).drop("source")

    def bellman_ford_distances(self, start) -> DataFrame:
        """As distances; weights may be negative, negative cycles raise."""
        return self._any_weights(start).drop("source")

    def bellman_ford_pair(self, start, end) -> DataFrame:
        return self._with_paths(self._any_weights(start), self._lightest(), self._to(start, end)).drop("source")

    def landmark_bounds(self, goal, count: int = 4) -> DataFrame:
        """id, bound: a lower estimate of each vertex's distance to goal, for a_star.

        `count` landmarks are chosen one by one, each the farthest from those before (at first from
        the goal). By the triangle inequality a distance is at least what the ways to a landmark,
        or from it, differ by.
        """
        self._check_weights()
        # without directions, ways back are the same ways
        back = self if not self.directed else Graph(self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"), self.vertices)
        all_ways = lambda graph, v: cut(graph._nearest(v).select("id", "dist"))
        reach, out, lower = all_ways(back, goal).withColumnRenamed("dist", "far"), self.vertices, [F.lit(0.0)]
        for k in range(count):
            mark = reach.orderBy(F.desc("far"), "id").first()
            if mark is None or mark.far == 0:
                break
            to = all_ways(back, mark.id)
            for name, ways in (("to", to), ("fro", all_ways(self, mark.id))) if self.directed else (("to", to),):
                end = F.lit(ways.where(F.col("id") == F.lit(goal)).agg(F.max("dist")).first()[0]).cast("double")
                out = out.join(ways.withColumnRenamed("dist", f"{name}{k}"), "id", "left")
                lower.append(F.col(f"to{k}") - end if name == "to" else end - F.col(f"fro{k}"))
                if not self.directed:
                    lower.append(end - F.col(f"to{k}"))
            reach = cut(reach.join(to, "id").select("id", F.least("far", "dist").alias("far")))
        # rounding may make a bound exceed the distance by its last digits
        return cut(out.select("id", (F.array_max(F.array(*lower)) * (1 - 1e-9)).alias("bound")))

    def a_star(self, start, goal, heuristic: Column | DataFrame | None = None) -> DataFrame:
        """id, dist and path to goal, no row if it can't be reached. heuristic is a lower bound of
        the rest of the way: a column over id, or a table (id, bound) as of landmark_bounds."""
        self._check_weights()
        if heuristic is None:
            return self.dijkstra_pair(start, goal)
        bounds = heuristic if isinstance(heuristic, DataFrame) else self.vertices.select("id", heuristic.cast("double").alias("bound"))
        return self._with_paths(self._best_first(start, goal, bounds), self._lightest(), self._to(start, goal)).drop("source")

    def _best_first(self, start, goal, bounds: DataFrame) -> DataFrame:
        """The vertices touched on the way to goal."""
        edges = self._lightest()
        return self._search(self._from(start), edges, edges.agg(F.avg("weight")).first()[0], goal, bounds)

    def floyd_warshall(self, side: int = all_pairs.SIDE) -> DataFrame:
        """src, dst, dist for all pairs, by tiles of the matrix; 0 on the diagonal. Weights may be
        negative, negative cycles raise; loops aren't used."""
        return all_pairs.distances(self.vertices, self.edges, side)

    def johnson(self) -> DataFrame:
        """source, id, dist, path for all pairs; weights may be negative, negative cycles raise."""
        flat = self._search(self.vertices.select(F.lit(0).alias("source"), "id", F.lit(0.0).alias("dist")), self._lightest(), rounds=self.vertices.count() + 1)
        h = cut(flat.select("id", F.col("dist").alias("h")))
        of = lambda end: h.select(F.col("id").alias(end), F.col("h").alias(f"h_{end}"))
        shifted = self._lightest(self.edges.join(of("src"), "src").join(of("dst"), "dst").select("src", "dst", F.greatest(F.lit(0.0), F.col("weight") + F.col("h_src") - F.col("h_dst")).alias("weight")))
        everywhere = self.vertices.select(F.col("id").alias("source"), "id", F.lit(0.0).alias("dist"))
        found = self._with_paths(self._search(everywhere, shifted, shifted.agg(F.avg("weight")).first()[0]), shifted)
        back = found.join(h, "id").join(h.select(F.col("id").alias("source"), F.col("h").alias("h0")), "source")
        return back.select("source", "id", (F.col("dist") - F.col("h0") + F.col("h")).alias("dist"), F.transform("path", lambda e: F.struct(e["src"].alias("src"), e["dst"].alias("dst"))).alias("path"))

    # traversal

    def bfs(self, start, order: Column | None = None) -> DataFrame:
        """id, level, trail. Visiting order is that of (level, trail); trail holds the vertices'
        places (order, by default the id) on the way, so that ties follow the parents' turns."""
        place = order if order is not None else F.col("id")
        front = cut(self.vertices.where(F.col("id") == F.lit(start)).select("id", F.lit(0).alias("level"), F.array(place).alias("trail")))
        seen, level, out = front, 0, self.edges.select("src", "dst").distinct()
        while not front.isEmpty():
            level += 1
            step = front.select(F.col("id").alias("src"), "trail").join(out, "src").select(F.col("dst").alias("id"), "trail")
            step = step.join(seen, "id", "left_anti").select("id", F.concat("trail", F.array(place)).alias("trail"))
            front = cut(step.groupBy("id").agg(F.min("trail").alias("trail")).select("id", F.lit(level).alias("level"), "trail"))
            seen = seen.unionByName(front)
        return seen

    def dfs(self, start) -> DataFrame:
        """id, ord: the preorder from start, least neighbour first.

        Each step depends on all before, so a task walks alone, but over a bounded part of the
        graph: the last of the open calls, and the neighbours not yet visited of those and of
        vertices whose breadth-first levels are near. It stops where it needs a neighbour that
        isn't there; what it visited and its open calls are stored, and the next round loads
        anew. A graph of any size is walked; one whose edges exceed WALK_EDGES takes many rounds.
        """
        levels = cut(self.bfs(start).select("id", "level"))
        kind = self.vertices.schema["id"].dataType.simpleString()
        visited = cut(levels.where("level = 0").select("id", F.lit(0).cast("long").alias("ord")))
        calls = cut(visited.select("id", F.col("ord").alias("depth")))
        count, top = visited.count(), 0
        edges = self.edges.select("src", "dst").where("src <> dst").distinct()
        left = cut(edges.join(levels.select(F.col("id").alias("src")), "src", "left_semi").join(visited.select(F.col("id").alias("dst")), "dst", "left_anti").select("src", "dst"))
        while count and top >= 0:
            whole = left.limit(WALK_EDGES + 1).count() <= WALK_EDGES
            base = max(0, top + 1 - (WALK_EDGES if whole else WALK))
            held = calls.where(F.col("depth") >= base)
            steps = left.select("src", "dst", F.lit(1).alias("turn"))
            if not whole:
                at = calls.where(F.col("depth") == top).join(levels, "id").first()["level"]
                near = levels.join(visited, "id", "left_anti").orderBy(F.abs(F.col("level") - at), "id").limit(WALK).select("id")
                here = cut(held.select("id").union(near))
                least = Window.partitionBy("src").orderBy("dst")
                steps = left.join(here.withColumnRenamed("id", "src"), "src", "left_semi").withColumn("turn", F.row_number().over(least)).where(F.col("turn") <= FAN + 1)
                # a loaded vertex has a row of turn 0, so that one without neighbours is known to have none
                steps = steps.select("src", "dst", "turn").union(here.select("id", F.col("id"), F.lit(0)))
            given = steps.withColumn("depth", F.lit(-1).cast("long")).union(held.select("id", F.col("id"), F.lit(0), "depth"))
            walk = _walker(whole, base, count)
            walked = cut(given.groupBy(F.lit(1).alias("one")).applyInPandas(walk, f"id {kind}, ord long, depth long"))
            new = walked.where("ord >= 0").select("id", "ord")
            visited = visited.union(new)
            calls = cut(calls.where(F.col("depth") < base).union(walked.where("depth >= 0").select("id", "depth")))
            left = cut(left.join(new.select(F.col("id").alias("dst")), "dst", "left_anti").select("src", "dst"))
            count += new.count()
            deepest = calls.agg(F.max("depth")).first()[0]
            top = -1 if deepest is None else deepest
        return visited

    def topological(self, reverse: bool = False) -> DataFrame:
        """id, layer: each vertex comes in a later layer than those before it (sinks first if reversed); raises on a cycle."""
        layers = self._layers(reverse)
        if layers.count() < self.vertices.count():
            raise ValueError("Graph contains a cycle.")
        return layers

    def _layers(self, reverse: bool = False) -> DataFrame:
        """id, layer of what no cycle leads to: the longest way there. Vertices with one predecessor
        follow the first before them that has none or several, so rounds are for those alone."""
        if not self.directed:
            raise ValueError("a topological order needs a directed graph")
        a, b = ("dst", "src") if reverse else ("src", "dst")
        edges = stored(self.given.select(F.col(a).alias("a"), F.col(b).alias("b")).distinct())
        led = self._led(edges)
        joints = self.vertices.join(led.select("id"), "id", "left_anti")
        # an edge to a joint starts at the joint that its tail hangs from
        tails = led.select(F.col("id").alias("a"), "head", "steps")
        onto = edges.join(led.select(F.col("id").alias("b")), "b", "left_anti").join(tails, "a", "left")
        # of several ways from one joint to another the longest counts
        left = stored(onto.groupBy(F.coalesce("head", "a").alias("a"), "b").agg(F.max(F.coalesce("steps", F.lit(0)) + 1).alias("steps")))
        layers = stored(joints.join(left.select(F.col("b").alias("id")), "id", "left_anti").select("id", F.lit(0).alias("layer")))
        fresh, open_ = layers, stored(left.select(F.col("b").alias("id")).distinct().withColumn("layer", F.lit(0)))
        while not fresh.isEmpty():
            met = left.join(fresh.select(F.col("id").alias("a"), "layer"), "a")
            reached = met.groupBy(F.col("b").alias("id")).agg(F.max(F.col("layer") + F.col("steps")).alias("new"))
            rest = stored(left.join(fresh.select(F.col("id").alias("a")), "a", "left_anti"))
            now = stored(open_.join(reached, "id", "left").select("id", F.greatest("layer", F.coalesce("new", "layer")).alias("layer")))
            waits = rest.select(F.col("b").alias("id")).distinct()
            fresh = stored(now.join(waits, "id", "left_anti"))
            more = stored(layers.unionByName(fresh))
            still = stored(now.join(waits, "id", "left_semi"))
            for old in (left, open_, now, layers):
                drop_stored(old)
            left, open_, layers = rest, still, more
        hung = led.join(layers.select(F.col("id").alias("head"), F.col("layer").alias("above")), "head")
        return layers.unionByName(hung.select("id", (F.col("above") + F.col("steps")).alias("layer")))

    @staticmethod
    def _led(edges: DataFrame) -> DataFrame:
        """id, head, steps of the vertices with one edge (a, b) to them: how many steps lead there
        from the nearest vertex before that has none or several, by pointer doubling, in as many
        rounds as the steps have binary digits. The head of what only a circle leads to is in it."""
        table = stored(edges.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("head"), F.count("*").alias("n")).where("n = 1").select("id", "head", F.lit(1).alias("steps")))
        led, open_ = table.select("id"), table.count()
        while True:
            beyond = table.select(F.col("id").alias("head"), F.col("head").alias("next"), F.col("steps").alias("more"))
            moved = stored(table.join(beyond, "head", "left").select("id", F.coalesce("next", "head").alias("head"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps")))
            before, open_ = open_, moved.select("head").join(led.withColumnRenamed("id", "head"), "head", "left_semi").count()
            led, table = moved.select("id"), moved
            if open_ in (0, before):
                return table

    # structure

    def connected_components(self) -> DataFrame:
        """id, component (the least id): weak components, by hooking to the least neighbour and pointer
        jumping. Minima are taken before rows are shuffled."""
        both = cut(self.given.select("src", "dst").union(self.given.select("dst", "src")).where("src <> dst").distinct())
        labels = cut(self.vertices.select("id", F.col("id").alias("component")))
        # a hub's edges are dealt into parts, each of which meets its label: into how many, follows from its degree
        parts = both.groupBy("dst").agg(F.ceil(F.count("*") / HUB).cast("int").alias("parts")).where("parts > 1")
        parts = cut(parts)  # at most a HUB-th as many rows as edges
        if not parts.isEmpty():
            both = cut(both.join(parts, "dst", "left").select("src", "dst", F.pmod(F.xxhash64("src"), F.coalesce("parts", F.lit(1))).cast("int").alias("part")))
        while True:
            names = labels.withColumnRenamed("id", "dst")
            if "part" in both.columns:
                names = names.join(parts, "dst", "left").select("dst", "component", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
            near = both.join(names, [c for c in both.columns if c != "src"]).groupBy(F.col("src").alias("id")).agg(F.min("component").alias("near"))
            hooked = labels.join(near, "id", "left").select("id", F.col("component").alias("old"), F.least("component", F.coalesce("near", "component")).alias("next"))
            jump = labels.select(F.col("id").alias("next"), F.col("component").alias("beyond"))
            new = cut(hooked.join(jump, "next").select("id", "old", F.least("next", "beyond").alias("component")))
            changed = not new.where("old <> component").isEmpty()
            labels = new.select("id", "component")
            if not changed:
                return labels

    def is_cyclic(self) -> bool:
        """Directed: no topological order. Undirected: a component with as many edges as vertices (loops count, parallels don't)."""
        if self.directed:
            return self._layers().count() < self.vertices.count()
        distinct = self.given.select(F.least("src", "dst").alias("id"), F.greatest("src", "dst").alias("other")).distinct()
        labels = self.connected_components()
        n_edges = distinct.join(labels, "id").groupBy("component").agg(F.count("*").alias("m"))
        n_vertices = labels.groupBy("component").agg(F.count("*").alias("n"))
        return not n_edges.join(n_vertices, "component").where("m >= n").isEmpty()

    def spanning_forest(self) -> DataFrame:
        """src, dst, weight of a least spanning forest (Boruvka): each component takes its
        lightest edge out, ties by the ends, and all that are chosen are merged at once."""
        if self.directed:
            raise ValueError("a spanning tree needs an undirected graph")
        edges = cut(self.given.where("src <> dst").groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.min("weight").alias("weight")))
        labels, chosen = cut(self.vertices.select("id", F.col("id").alias("component"))), None
        while True:
            of = lambda end: labels.select(F.col("id").alias(end), F.col("component").alias(f"c_{end}"))
            across = cut(edges.join(of("src"), "src").join(of("dst"), "dst").where("c_src <> c_dst"))
            edge = F.struct("weight", "src", "dst", "c_src", "c_dst")
            light = across.select(F.col("c_src").alias("c"), edge.alias("e")).union(across.select("c_dst", edge)).groupBy("c").agg(F.min("e").alias("e")).select("e.*").distinct()
            light = cut(light)
            if light.isEmpty():
                return chosen if chosen is not None else edges.limit(0)
            new = light.select("src", "dst", "weight")
            chosen = new if chosen is None else chosen.union(new)
            merged = Graph(light.select(F.col("c_src").alias("src"), F.col("c_dst").alias("dst"), "weight"), directed=False).connected_components()
            merged = merged.select(F.col("id").alias("component"), F.col("component").alias("now"))
            labels = cut(labels.join(merged, "component", "left").select("id", F.coalesce("now", "component").alias("component")))

    def kruskal(self) -> DataFrame:
        return self.spanning_forest()

    def prim(self, start) -> DataFrame:
        """The least spanning tree; raises if start doesn't reach all vertices."""
        labels = self.connected_components()
        if labels.select("component").distinct().count() > 1:
            raise ValueError("the graph is not connected")
        return self.spanning_forest()

    # flows and matchings

    def max_flow(self, source, sink, capacity: str = "weight") -> int:
        """The greatest flow (whole capacities, parallel edges add up). Each round searches
        breadth-first for shortest augmenting paths, takes those that share no edge, and updates
        the residual capacities."""
        residual = cut(self.edges.groupBy("src", "dst").agg(F.sum(F.col(capacity).cast("long")).alias("room")).where("room > 0"))
        total = 0
        while True:
            paths = self._augmenting(residual, source, sink)
            if paths is None:
                return total
            paths = cut(paths)
            total += paths.agg(F.sum("gain")).first()[0]
            steps = paths.select("gain", F.explode("path").alias("e"))
            change = steps.select("e.src", "e.dst", (-F.col("gain")).alias("room")).union(steps.select("e.dst", "e.src", "gain"))
            residual = cut(residual.union(change).groupBy("src", "dst").agg(F.sum("room").alias("room")).where("room > 0"))

    @staticmethod
    def max_flow_of(capacities: DataFrame, source, sink) -> int:
        """The greatest flow through a table of capacities (src, dst, capacity), by push-relabel."""
        flows, _ = Graph(capacities.select("src", "dst", F.col("capacity").alias("weight"))).push_relabel(source, sink)
        leaves, returns = (F.coalesce(F.sum(F.when(F.col(end) == F.lit(source), F.col("flow"))), F.lit(0)) for end in ("src", "dst"))
        return flows.agg(leaves - returns).first()[0]

    def push_relabel(self, source, sink, capacity: str = "weight") -> tuple[DataFrame, DataFrame]:
        """A greatest flow as src, dst, flow (whole numbers above 0), and the least cut as the ids on
        the source's side. Parallel edges add up; loops carry nothing.

        All vertices with an excess push at once to neighbours one level nearer to the sink, each
        along its edges in turn as far as the excess goes. When none can, levels are measured anew:
        the steps to the sink through edges with room, or beyond all those the steps back to the
        source, so that what doesn't get through returns. Levels never fall, so this ends.
        """
        if source == sink:
            raise ValueError("source and sink are the same")
        with brief_shuffles(self.spark):
            arcs, through = self._pushed(source, sink, capacity)
        flows = arcs.where("cap > room").select("src", "dst", (F.col("cap") - F.col("room")).alias("flow"))
        return flows, self.vertices.join(through, "id", "left_anti").select("id")

    def _pushed(self, source, sink, capacity: str) -> tuple[DataFrame, DataFrame]:
        """The edges with what room is left on them, and what still leads to the sink. Each round's
        tables are removed once the next are written."""
        given = self.edges.where("src <> dst").groupBy("src", "dst").agg(F.sum(F.col(capacity).cast("long")).alias("cap")).where("cap > 0")
        given = stored(given)
        both = given.union(given.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(0).cast("long").alias("cap"))).groupBy("src", "dst").agg(F.sum("cap").alias("cap"))
        first = F.col("src") == F.lit(source)
        back = given.where(first).select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("cap").alias("sent"))
        arcs = stored(both.join(back, ["src", "dst"], "left").select("src", "dst", "cap", (F.when(first, 0).otherwise(F.col("cap")) + F.coalesce("sent", F.lit(0))).alias("room")))
        excess = stored(back.select(F.col("src").alias("id"), F.col("sent").alias("excess")))
        drop_stored(given)
        inner = ~F.col("id").isin(source, sink)
        high, levels = self.vertices.count(), None
        while not (active := stored(excess.where(inner & (F.col("excess") > 0)))).isEmpty():
            pushes = None if levels is None else self._pushes(arcs, active, levels)
            drop_stored(active)
            if pushes is None or pushes.isEmpty():
                for old in (pushes, levels):
                    if old is not None:
                        drop_stored(old)
                levels = self._levels(arcs, source, sink, high)
                continue
            undone = pushes.select(F.col("dst").alias("src"), F.col("src").alias("dst"), (-F.col("sent")).alias("sent"))
            net = pushes.union(undone).groupBy("src", "dst").agg(F.sum("sent").alias("sent"))
            moved = pushes.select(F.col("src").alias("id"), (-F.col("sent")).alias("excess")).union(pushes.select("dst", "sent"))
            before = arcs, excess, pushes
            arcs = stored(arcs.join(net, ["src", "dst"], "left").select("src", "dst", "cap", (F.col("room") - F.coalesce("sent", F.lit(0))).alias("room")))
            excess = stored(excess.union(moved).groupBy("id").agg(F.sum("excess").alias("excess")))
            for old in before:
                drop_stored(old)
        for old in (active, excess, levels):
            if old is not None:
                drop_stored(old)
        return arcs, self._steps(arcs, sink)

    @staticmethod
    def _pushes(arcs: DataFrame, active: DataFrame, levels: DataFrame) -> DataFrame:
        """src, dst, sent: what the active vertices (id, excess) send down one level."""
        own = active.join(levels, "id").select(F.col("id").alias("src"), "excess", F.col("level").alias("high"))
        open_arcs = arcs.where("room > 0").join(own, "src").join(levels.select(F.col("id").alias("dst"), "level"), "dst").where("high = level + 1")
        before = Window.partitionBy("src").orderBy("dst").rowsBetween(Window.unboundedPreceding, -1)
        left = F.col("excess") - F.coalesce(F.sum("room").over(before), F.lit(0))
        return stored(open_arcs.withColumn("sent", F.least("room", left)).where("sent > 0").select("src", "dst", "sent"))

    @staticmethod
    def _steps(arcs: DataFrame, end, without=None) -> DataFrame:
        """id, level: how many edges with room lead from each vertex to `end`."""
        ways = arcs.where("room > 0").select(F.col("src").alias("id"), F.col("dst").alias("to"))
        seen = front = arcs.sparkSession.createDataFrame([(end, 0)], f"id {arcs.schema['src'].dataType.simpleString()}, level int")
        level = 0
        while True:
            level += 1
            step = ways.join(front.select(F.col("id").alias("to")), "to").select("id").distinct().join(seen, "id", "left_anti")
            if without is not None:
                step = step.join(without, "id", "left_anti")
            last, front = front, stored(step.select("id", F.lit(level).alias("level")))
            drop_stored(last)
            if front.isEmpty():
                drop_stored(front)
                return seen
            last, seen = seen, stored(seen.unionByName(front))
            drop_stored(last)

    def _levels(self, arcs: DataFrame, source, sink, high: int) -> DataFrame:
        """id, level: the source is as high as there are vertices, what leads to the sink only
        through it is higher."""
        start = self.spark.createDataFrame([(source,)], f"id {arcs.schema['src'].dataType.simpleString()}")
        down = self._steps(arcs, sink, start)
        up = self._steps(arcs, source, down)
        levels = stored(down.unionByName(up.withColumn("level", F.col("level") + high)))
        for old in (down, up):
            drop_stored(old)
        return levels

    def _augmenting(self, residual: DataFrame, source, sink) -> DataFrame | None:
        kind = self.vertices.schema["id"].dataType.simpleString()
        front = cut(self.vertices.where(F.col("id") == F.lit(source)).select("id", F.array().cast(f"array<struct<src:{kind},dst:{kind}>>").alias("path"), F.lit(2**62).alias("gain")))
        seen = front.select("id")
        while not front.isEmpty():
            step = front.withColumnRenamed("id", "src").join(residual, "src").select("dst", F.concat("path", F.array(F.struct("src", "dst"))).alias("path"), F.least("gain", "room").alias("gain"))
            ends = cut(step.where(F.col("dst") == F.lit(sink)).select("path", "gain"))
            if not ends.isEmpty():
                # one that is the least at each of its edges shares none with the others taken
                first = ends.select("path", F.explode("path").alias("e")).groupBy("e").agg(F.min("path").alias("first"))
                owned = ends.select("path", "gain", F.explode("path").alias("e")).join(first, "e").groupBy("path", "gain").agg(F.min(F.col("first") == F.col("path")).alias("own"))
                return owned.where("own").select("path", "gain")
            step = step.withColumnRenamed("dst", "id").join(seen, "id", "left_anti")
            front = cut(step.groupBy("id").agg(F.min(F.struct("path", "gain")).alias("b")).select("id", "b.path", "b.gain"))
            seen = seen.union(front.select("id"))
        return None

    def max_matching(self) -> DataFrame:
        """u, v: a greatest matching of a bipartite graph whose edges lead from one side to the
        other. Rounds of shortest augmenting paths from all free vertices at once; of the paths
        found, those that share no vertex are taken. Ties go by a hash, so that the ends spread
        over the free vertices and a round takes many paths."""
        edges = cut(self.given.select(F.col("src").alias("u"), F.col("dst").alias("v")).distinct())
        mates = None
        while True:
            free = edges.select("u").distinct() if mates is None else edges.select("u").distinct().join(mates.select("u"), "u", "left_anti")
            found = self._alternating(edges, mates, free)
            if found is None:
                return mates if mates is not None else edges.limit(0)
            on = cut(found.select(F.explode(F.expr("filter(path, (x, i) -> i % 2 = 0)")).alias("e")).select("e.u", "e.v"))
            kept = mates if mates is None else mates.join(on.select("u"), "u", "left_anti").join(on.select("v"), "v", "left_anti")
            mates = cut(on if kept is None else kept.unionByName(on))

    def _alternating(self, edges: DataFrame, mates: DataFrame | None, free: DataFrame) -> DataFrame | None:
        kind = f"struct<u:{edges.schema['u'].dataType.simpleString()},v:{edges.schema['v'].dataType.simpleString()}>"
        turn = F.struct(F.xxhash64("path").alias("key"), "path")
        front = cut(free.select("u", F.array().cast(f"array<{kind}>").alias("path")))
        seen = None
        while not front.isEmpty():
            step = front.join(edges, "u").select("v", F.concat("path", F.array(F.struct("u", "v"))).alias("path"))
            if seen is not None:
                step = step.join(seen, "v", "left_anti")
            step = cut(step.groupBy("v").agg(F.min(turn).alias("first")).select("v", "first.path"))
            ends = step if mates is None else cut(step.join(mates.select("v"), "v", "left_anti"))
            if not ends.isEmpty():
                touched = ends.select("path", F.explode("path").alias("e")).select("path", F.explode(F.array(F.concat(F.lit("u"), F.col("e.u").cast("string")), F.concat(F.lit("v"), F.col("e.v").cast("string")))).alias("x")).distinct()
                first = touched.groupBy("x").agg(F.min(turn)["path"].alias("first"))
                return touched.join(first, "x").groupBy("path").agg(F.min(F.col("first") == F.col("path")).alias("own")).where("own").select("path")
            seen = step.select("v") if seen is None else seen.union(step.select("v"))
            if mates is None:
                return None
            back = step.join(mates, "v").select("u", F.concat("path", F.array(F.struct("u", "v"))).alias("path"))
            front = cut(back)
        return None


