"""Connected components of an edge list, on written tables: neither edges nor nodes come to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import discard, written


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id of ``edges`` (a, b): the smallest id that it reaches.

    Every round each node takes the smallest label among its neighbours' labels, then the label of that label
    (pointer jumping), so long chains shorten by half a round. The smallest label of each neighbourhood is found by
    a partial aggregate, so a hub with a third of all edges is summed up before it is shuffled.
    """
    proper = edges.where("a <> b").select("a", "b")
    both = written(proper.union(proper.select("b", "a")).distinct(), "edges")
    labels = written(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("component")).withColumnRenamed("a", "id"), "labels")
    while True:
        near = both.join(labels, both.b == labels.id).groupBy("a").agg(F.min("component").alias("near"))
        taken = labels.join(near, labels.id == near.a).select("id", "component", F.least("component", "near").alias("taken"))
        taken = written(taken, "taken")
        jump = taken.select(F.col("id").alias("at"), F.col("taken").alias("jump"))
        new = written(taken.join(jump, taken.taken == F.col("at"), "left").select("id", "component", F.least("taken", "jump").alias("new")), "labels")
        changed = not new.where("new <> component").isEmpty()
        discard(taken, labels)
        labels = new.select("id", F.col("new").alias("component"))
        labels._kinlens_path = new._kinlens_path
        if not changed:
            discard(both)
            return labels
