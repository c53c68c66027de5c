"""Connected components of a link table, all on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import few_tasks, materialize


#: Links (each counted from both ends) for which a round writes one file.
LINKS_PER_FILE = 100_000


def connected_components(links: DataFrame) -> DataFrame:
    """(id, label) for each id in ``links`` (a, b): label is the smallest id reachable.

    Labels take the smallest label among neighbours, then that label's own label
    (pointer jumping), until nothing changes. Every round is written to the shared
    checkpoint folder, so a lost executor costs one round at most.
    """
    with few_tasks(links.sparkSession):
        both = materialize(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct())
        files = max(1, -(-both.count() // LINKS_PER_FILE))
        labels = materialize(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("label")).coalesce(files))
        while True:
            near = both.join(labels.select(F.col("id").alias("b"), "label"), "b").select(F.col("a").alias("id"), "label")
            least = materialize(labels.union(near).groupBy("id").agg(F.min("label").alias("label")).coalesce(files))
            to = least.select(F.col("id").alias("label"), F.col("label").alias("jump"))
            new = materialize(least.join(to, "label").select("id", F.col("jump").alias("label")).coalesce(files))
            moved = new.join(labels.withColumnRenamed("label", "old"), "id").where("label <> old").limit(1).count()
            if not moved:
                return new
            labels = new
