"""Connected components of a link table, by labels that stay in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(links: DataFrame) -> DataFrame:
    """``v``, ``component``: for each id in the columns ``a`` and ``b`` of ``links``, the smallest id that links reach.

    Each round takes the smallest label among neighbours, then the label of the label, so
    chains halve; a round's labels are written to the shared folder. A vertex with very many
    links is pre-aggregated before the shuffle (a minimum). No links: an empty result.
    """
    both = written(links.select("a", "b").union(links.select("b", "a")).filter("a <> b").distinct(), "links")
    labels = written(both.groupBy(F.col("a").alias("v")).agg(F.least(F.col("v"), F.min("b")).alias("component")), "labels")
    while True:
        near = both.join(labels, both.b == labels.v).groupBy("a").agg(F.min("component").alias("near"))
        low = labels.join(near, labels.v == near.a, "left").select("v", F.col("component").alias("old"), F.least("component", F.coalesce("near", "component")).alias("low"))
        top = labels.select(F.col("v").alias("t"), F.col("component").alias("up"))
        new = written(low.join(top, low.low == top.t, "left").select("v", "old", F.least("low", F.coalesce("up", "low")).alias("component")), "labels")
        if not new.filter("old <> component").limit(1).count():
            return new.select("v", "component")
        labels = new.select("v", "component")
