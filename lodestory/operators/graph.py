"""Connected components by smallest labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestory.storage import cut


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", *, steps: int | None = None) -> DataFrame:
    """node, label: the smallest node of each component of the undirected edges.

    Every round takes the smallest label among neighbours and then the label's own label, so long
    chains shorten by halves. Only counts of changes come to the driver. Given steps, labels as they
    stand after so many: nodes of one label are of one component, but not all of those need be of one label.
    """
    ways = F.array(F.struct(F.col(a).alias("src"), F.col(b).alias("dst")), F.struct(F.col(b).alias("src"), F.col(a).alias("dst")))
    both = cut(edges.select(F.explode(ways).alias("e")).select("e.*").distinct())  # the edges are made once
    labels = both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("label")).withColumn("label", F.least("node", "label"))
    labels = cut(labels)
    while True:
        near = both.join(labels, both["dst"] == labels["node"]).groupBy("src").agg(F.min("label").alias("near"))
        hooked = labels.join(near, labels["node"] == near["src"]).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("node").alias("at"), F.col("label").alias("above"))
        jumped = hooked.join(up, hooked["label"] == up["at"]).select("node", "old", F.least("label", "above").alias("label"))
        jumped = cut(jumped)
        labels = jumped.select("node", "label")
        if steps is not None:
            steps -= 1
            if steps <= 0:
                return labels
            continue
        if not jumped.where("old <> label").limit(1).count():
            return labels
