"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motes.session import checkpointed


def components(links: DataFrame) -> DataFrame:
    """``id`` and ``label`` (the smallest id of its component) of every end of a link.

    ``links`` has ``a`` and ``b``. Each round takes the smallest label among neighbours, then
    the label of the label, so long chains shrink fast. Only counts reach the driver; each
    round is cut off by a checkpoint. No links give no rows.
    """
    both = checkpointed(
        links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a != b").distinct()
    )
    state = both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("low"))
    state = checkpointed(state.select("id", F.least("id", "low").alias("label")))
    while True:
        low = both.join(state.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("low"))
        near = state.join(low, "id").select("id", F.col("label").alias("was"), F.least("label", "low").alias("label"))
        far = near.select(F.col("id").alias("label"), F.col("label").alias("far"))
        state = checkpointed(near.join(far, "label").select("id", "was", F.least("label", "far").alias("label")))
        if state.filter("label != was").isEmpty():
            return state.select("id", "label")
        state = state.select("id", "label")
