"""Component dependency graphs: closure, start levels, cycles.

The closure grows by one edge a round (semi-naive): round k joins only the pairs that
a path of k edges connects with the edges again, and keeps distinct pairs, so the
work follows the number of pairs and not the number of paths. A pair's depth is its
longest path, the last round that gives it. Rounds are written tables, which cut the
lineage; the driver sees two numbers a round.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored

CYCLE = "on a cycle of dependencies"


def _ahead(pairs: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """The pairs, one edge longer."""
    step = edges.select(*keys, F.col("component").alias("depends_on"), F.col("depends_on").alias("_next"))
    return pairs.join(step, [*keys, "depends_on"]).select(*keys, "component", F.col("_next").alias("depends_on")).distinct()


def _state(pairs: DataFrame) -> tuple[bool, bool]:
    """(any pair, any pair that leads back to where it began)."""
    r = pairs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bool_or(F.col("component") == F.col("depends_on")), F.lit(False)).alias("back")).first()
    return r.n > 0, r.back


def _by_length(edges: DataFrame, keys: list[str]) -> DataFrame | None:
    """The closure with the longest path of each pair; None if there is a cycle."""
    parts, now, depth = [], edges, 1
    while True:
        some, back = _state(now)
        if back:
            return None
        if not some:
            break
        parts.append(now.withColumn("depth", F.lit(depth)))
        now, depth = stored(_ahead(now, edges, keys)), depth + 1
    if not parts:
        return edges.withColumn("depth", F.lit(0)).where("false")
    every = functools.reduce(DataFrame.unionByName, parts)
    return every.groupBy(*keys, "component", "depends_on").agg(F.max("depth").alias("depth"))


def _reachable(edges: DataFrame, keys: list[str]) -> DataFrame:
    """All pairs that some path connects, on any graph: pairs that were visited are not taken up again."""
    seen, now = edges, edges
    while True:
        now = stored(_ahead(now, edges, keys).join(seen, [*keys, "component", "depends_on"], "left_anti"))
        if now.isEmpty():
            return seen
        seen = seen.unionByName(now)  # of written tables


def dependency_closure(edges: DataFrame, keys=()) -> tuple[DataFrame, DataFrame]:
    """(closure, rejects) of any graph of ``(keys, component, depends_on)``.

    ``closure``: ``(keys, component, depends_on, depth)``, all direct and indirect dependencies with the
    longest path to each. ``rejects``: the edges on a cycle with the reason; nothing can be started along
    them, so the closure is that of the other edges. Edges with a null end are dropped,
    repeated ones count once. ``keys`` tell several graphs in one table apart.
    """
    keys = list(keys)
    edges = stored(edges.select(*keys, "component", "depends_on").where("component IS NOT NULL AND depends_on IS NOT NULL").distinct())
    closure = _by_length(edges, keys)
    if closure is not None:
        return closure, edges.where("false").withColumn("reason", F.lit(CYCLE))
    back = _reachable(edges, keys).select(*keys, F.col("depends_on").alias("component"), F.col("component").alias("depends_on"))
    cyclic = stored(edges.join(back, [*keys, "component", "depends_on"], "left_semi"))
    rest = stored(edges.join(cyclic, [*keys, "component", "depends_on"], "left_anti"))
    closure = _by_length(rest, keys)
    return closure, cyclic.withColumn("reason", F.lit(CYCLE))


def start_levels(closure: DataFrame, keys=()) -> DataFrame:
    """``(keys, component, level)``: components of level 0 need nothing, each other starts after all lower levels."""
    keys = list(keys)
    ends = closure.select(*keys, F.explode(F.array(F.struct(F.col("component").alias("component"), F.col("depth").alias("level")),
                                                   F.struct(F.col("depends_on").alias("component"), F.lit(0).alias("level")))).alias("x"))
    return ends.groupBy(*keys, "x.component").agg(F.max("x.level").alias("level"))


def component_closure(components: DataFrame, edges: DataFrame, keys=("deploy_id",), optional=()) -> tuple[DataFrame, DataFrame]:
    """All direct and indirect dependencies of the components each deployment runs, with the
    depth of the longest path; and the edges on a cycle, as rejects.

    ``components``: ``(keys, component)``; ``edges``: those of the product. An edge holds
    where its component runs; for an end in ``optional`` that must run too. Deployments that run the
    same components have the same graph, so the closure is worked once for each different set of
    components and joined back.
    """
    keys = list(keys)
    own = stored(components.groupBy(*keys).agg(F.array_sort(F.collect_set("component")).alias("_set")))
    sets = own.select("_set").distinct()
    e = sets.select("_set", F.explode("_set").alias("component")).join(edges.select("component", "depends_on"), "component")
    if optional:
        e = e.where(~F.col("depends_on").isin(*optional) | F.array_contains(F.col("_set"), F.col("depends_on")))
    closure, rejects = dependency_closure(e, ["_set"])
    back = lambda rows: own.join(rows, "_set").drop("_set")
    return back(closure), back(rejects)
