"""Connected components of a graph in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from padlake.sources.scratch import shared_folder

#: Edges of a task.
ROWS = 500_000


def saved(df: DataFrame) -> DataFrame:
    """The rows, written to the shared checkpoint folder, so that no lineage is left."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def dropped(df: DataFrame) -> None:
    """Deletes what ``saved`` has written for ``df``, which nothing reads any more."""
    file = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if file.isDefined():
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file.get())
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(node, component): the smallest node that each node of (x, y) ``edges`` is connected with, by alternating stars.

    A large star hangs each node's larger neighbours on its smallest one, a small star its smaller ones. Both take a
    minimum by node and a join on it, so that a node of any degree can be dealt out; the rounds grow with the
    logarithm of the longest path.
    """
    now = kept = saved(edges.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).where("u != v").distinct())
    before = None
    # One key more than that of the aggregation, so that the join deals both sides itself and can split the rows of a
    # node of high degree; after it, nodes have few smaller neighbours.
    part = F.xxhash64("u").alias("part")
    for _ in range(most_rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", part, F.least("u", "m").alias("m"))
        large = both.select("*", part).join(least, ["u", "part"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        last, now = kept, saved(small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u != v").distinct())
        dropped(last)
        kept = now
        # A forest of stars is where every node has one smaller neighbour that has none itself.
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if before == state:
            break
        before = state
        now = now.coalesce(state.n // ROWS + 1)
    else:
        raise RuntimeError("components didn't settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component")))
