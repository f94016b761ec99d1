"""Connected components by a distributed union-find.

Every task builds the forest of its own edges, and forests are merged level by level in fewer and fewer
tasks.  Edges are dealt out evenly, whatever their ends, so a giant component is no hot key.  A forest never
has more edges than nodes.  The number of tasks of a level follows from the edges that are left, so that no
task ever holds more than its share; where forests no longer get smaller, star contraction finishes the work
with aggregations and joins alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.plans.durable import discard, join_skewed, keep

#: Edges that one task may hold in its forest.
EDGES_PER_TASK = 500_000
#: Forests merged into one at each level.
FAN_IN = 8


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over the edges of one task; gives each node but the roots with its root, the least node of its tree."""
    parent: dict = {}

    def find(x):
        root = x
        while parent[root] != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    schema = None
    for b in batches:
        schema = b.schema
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            parent.setdefault(x, x)
            parent.setdefault(y, y)
            x, y = find(x), find(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
    if schema is not None:
        nodes = [x for x in parent if parent[x] != x]
        for i in range(0, len(nodes), 100_000):
            part = nodes[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array([find(x) for x in part], schema.field(0).type), pa.array(part, schema.field(1).type)], names=["a", "b"])


def components(edges: DataFrame, edges_per_task: int | None = None) -> DataFrame:
    """(node, root) of each node of an edge; root is the least node of its component.

    edges: a, b of one type.  Edges with a null end are left out; loops, repeats and both directions are fine.
    An empty table gives an empty one.
    """
    per_task = edges_per_task or EDGES_PER_TASK
    kind = edges.schema["a"].dataType.simpleString()
    whole = edges.where("a is not null and b is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    all_edges = keep(whole.distinct(), "edges")
    now = all_edges.where("a < b")
    n = now.count()
    parts = max(1, -(-n // per_task))
    last = all_edges
    while True:
        merged = (now.repartition(parts) if parts > 1 else now.coalesce(1)).mapInArrow(_forest, f"a {kind}, b {kind}")
        if parts == 1:
            now = merged
            break
        now = keep(merged, "forest")
        if last is not all_edges:
            discard(last)
        last = now
        n = now.count()
        fewer = max(-(-parts // FAN_IN), -(-n // per_task))
        if fewer >= parts:
            now = _stars(now)
            break
        parts = fewer
    stars = keep(now.select(F.col("b").alias("node"), F.col("a").alias("root")), "roots")
    loops = all_edges.where("a = b").select(F.col("a").alias("node"))
    roots = stars.select(F.col("root").alias("node")).unionByName(loops).distinct().join(stars.select("node"), "node", "left_anti")
    return stars.unionByName(roots.select("node", F.col("node").alias("root")))


def _stars(edges: DataFrame) -> DataFrame:
    """Alternate large-star and small-star rounds until each component is a star around its least node.

    The centre of a giant component has most of the edges; join_skewed keeps them from one task.
    """
    now, last = edges, []
    while True:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = keep(both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("k")).select("u", F.least("u", "m").alias("m"), "k"), "least")
        # large star: neighbours above u go to the least of u's neighbourhood
        large = join_skewed(both.where("v > u"), least, ["u"], "k").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a < b").distinct()
        large = keep(large, "large")
        # small star: neighbours below u, and u itself, go to the least of them
        down = keep(large.groupBy("b").agg(F.min("a").alias("m"), F.count(F.lit(1)).alias("k")), "down")
        small = join_skewed(large, down, ["b"], "k").select(F.col("m").alias("x"), F.col("a").alias("y")).unionByName(down.select(F.col("m").alias("x"), F.col("b").alias("y")))
        now = keep(small.where("x < y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "small")
        discard(least, large, down, *last)
        last = [now]
        # stars: no node is both a centre and a leaf, and no leaf has two centres
        apart = now.select(F.col("b").alias("n")).intersect(now.select(F.col("a").alias("n"))).isEmpty()
        single = now.groupBy("b").count().where("count > 1").isEmpty()
        if apart and single:
            return now
