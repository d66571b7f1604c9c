"""Connected components of a graph of long ids, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockwright.session import shared_folder


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, root) of every id in ``edges`` (a, b): the smallest id reachable.

    A large star connects the larger neighbours of each id to the smallest one, a small star the smaller ones; stars
    are reached in a logarithmic number of rounds. Smallest neighbours are aggregated before they are shuffled; the
    edges of a hub meet its smallest neighbour in a join whose large partitions adaptive execution splits. Each round is
    cut off by a checkpoint. More than ``rounds`` rounds are an error, never an incomplete result.
    """
    shared_folder(edges.sparkSession)
    first = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct().checkpoint()
    e = first.where("u <> v")
    last = None
    for _ in range(rounds):
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: each id has larger ones apart now; its smaller neighbours get the smallest of them
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        e = large.join(small, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").where("u <> v").distinct().checkpoint()
        now = e.agg(F.count("*").alias("n"), F.sum(F.hash("u", "v").cast("long")).alias("h")).first()
        if (now["n"], now["h"]) == last:
            break
        last = (now["n"], now["h"])
    else:
        raise RuntimeError(f"components are not settled after {rounds} rounds")
    ids = first.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    roots = e.groupBy("u").agg(F.min("v").alias("root"))
    return ids.join(roots, ids["id"] == roots["u"], "left").select("id", F.coalesce("root", "id").alias("root"))
