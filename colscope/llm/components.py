"""Connected components of an edge table by minimum labels and pointer jumping.

Labels and edges stay distributed; every round is written to the shared checkpoint
folder, so a lost executor costs the current round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colscope.session import reliable_checkpoint


def connected_components(edges: DataFrame) -> DataFrame:
    """(row, root) for every end of an edge (a, b): the smallest row that is reachable; ``edges`` is read in every round."""
    both = edges.select(F.col("a").alias("row"), F.col("b").alias("near")).union(edges.select("b", "a"))
    labels = reliable_checkpoint(both.groupBy("row").agg(F.min("near").alias("low")).select("row", F.least("row", "low").alias("root")))
    while True:
        heard = (both.join(labels.select(F.col("row").alias("near"), F.col("root").alias("near_root")), "near")
                 .groupBy("row").agg(F.min("near_root").alias("heard")))
        # Pointer jumping: a label is itself a row, whose own label may be lower.
        further = labels.select(F.col("row").alias("root"), F.col("root").alias("further"))
        lower = labels.join(heard, "row").join(further, "root").select("row", F.least("root", "heard", "further").alias("lower"), F.col("root").alias("was"))
        after = reliable_checkpoint(lower)
        changed = not after.where(F.col("lower") != F.col("was")).isEmpty()
        labels = after.select("row", F.col("lower").alias("root"))
        if not changed:
            return labels
