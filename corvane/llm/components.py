"""Connected components by hooking and pointer jumping: joins and partial minima only, so no hub collects its neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, release


def connected_components(edges: DataFrame) -> DataFrame:
    """edges(a long, b long) -> (node, component), component being the smallest node reachable.

    Nodes are those of edges between two different non-null ids; repeated edges count once; no edges, no rows.
    Every round lowers parents through edges and doubles the pointers, so rounds grow with the log of the diameter.
    Hub nodes only meet skew-splittable joins and map-side combined minima.
    """
    e = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b")
    both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = materialise(both, "edges")
    f = materialise(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("f"), F.col("node").alias("old")), "parents")
    while True:
        g = f.alias("x").join(f.alias("y"), F.col("x.f") == F.col("y.node")).select(F.col("x.node").alias("node"), F.col("x.f").alias("f"), F.col("y.f").alias("g"))
        g = materialise(g, "grandparents")
        seen = both.join(g.select(F.col("node").alias("b"), F.col("g").alias("cand")), "b").select("a", "cand")
        low = seen.groupBy("a").agg(F.min("cand").alias("cand"))
        own = g.join(low.withColumnRenamed("a", "node"), "node")
        hooks = own.select(F.col("f").alias("node"), F.least("cand", "g").alias("cand"), F.lit(None).cast("long").alias("old"))
        mine = own.select("node", F.least("f", "g", "cand").alias("cand"), F.col("f").alias("old"))
        new = mine.union(hooks).groupBy("node").agg(F.min("cand").alias("f"), F.max("old").alias("old"))
        new = materialise(new, "parents")
        done = new.where("f < old").isEmpty()
        release(f)
        release(g)
        f = new
        if done:
            release(both)
            return f.select("node", F.col("f").alias("component"))
