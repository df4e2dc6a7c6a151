"""Connected components of a link table by alternating large and small stars."""

from pyspark.sql import functions as F

from lotwise.llm.tables import commit


def components(links, a="a", b="b"):
    """(node, component) of every node with a link; the component is its smallest node.

    Each round moves links towards smaller nodes; the number of rounds grows with the logarithm of
    the longest chain.  A node with very many links is a pre-aggregated minimum and a join that
    Spark may split.
    """
    links = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    links = commit(links.filter("u <> v").distinct(), "links")
    state = _state(links)
    while True:
        links = commit(_small_star(_large_star(links)), "links")
        state, before = _state(links), state
        if state == before:
            break
    leaves = links.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return leaves.unionByName(roots)


def _state(links):
    return links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def _large_star(links):
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links):
    low = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
