"""Connected components by alternating star contraction, with every edge set on Spark."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunetrail.llm.shared import stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour to the smallest of the neighbourhood."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    links = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return links.unionByName(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """Rows (u, root): the smallest node reachable from each node u of the edges (u, v).

    Edges may repeat, run either way or be loops. Each round stores its edges in the shared folder;
    the number of rounds grows with the logarithm of the longest chain. Runs jobs.
    """
    state = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
                   "edges")
    before = None
    while True:
        state = stored(_small_star(_large_star(state).distinct()).distinct(), "stars")
        now = tuple(state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            return state.select("u", F.col("v").alias("root"))
        before = now
