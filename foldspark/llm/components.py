"""Connected components of an edge table by alternating hash-to-min joins and pointer jumping.

Nothing is collected: the only figures the driver sees are counts. Each round is written to the shared folder, so a
lost executor costs one round. Rounds grow with the logarithm of a component's width.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldspark.llm.common import cut


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, root): every node of ``edges`` (columns a, b) with the smallest node it reaches. Self loops and repeated edges do no harm."""
    pairs = edges.select("a", "b").where("a <> b")
    pairs = cut(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-edges")
    labels = cut(pairs.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("root")), "cc-labels")
    for _ in range(rounds):
        near = pairs.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("root").alias("near"))
        lower = labels.join(near, "id").select("id", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        # the old root learns of the new one, then every node jumps to its root's root
        hooks = lower.where("root < was").groupBy(F.col("was").alias("id")).agg(F.min("root").alias("hook"))
        hooked = cut(lower.join(hooks, "id", "left").select("id", "was", F.least("root", F.coalesce("hook", "root")).alias("root")), "cc-hooked")
        up = hooked.select(F.col("id").alias("root"), F.col("root").alias("top"))
        new = cut(hooked.join(up, "root").select("id", F.least("root", "top").alias("root"), (F.col("was") != F.least("root", "top")).alias("moved")), "cc-labels")
        moved = new.where("moved").limit(1).count()
        labels = new.select("id", "root")
        if not moved:
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")
