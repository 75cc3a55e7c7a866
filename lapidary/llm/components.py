"""Connected components by alternating large-star and small-star steps.

Every step is an aggregation to a minimum (combined map-side) and an equi-join;
no neighbourhood is gathered into one task, and nothing but two counters per
round reaches the driver.  Each round is a written table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapidary.session import release, stage


def _with_min(edges: DataFrame) -> DataFrame:
    m = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(m, "u").withColumn("m", F.least("u", "m"))


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
    return r[0], r[1]


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges(u BIGINT, v BIGINT)`` -> ``(node, label)``, label = smallest node of the component.

    Self loops, repeated and null edges are ignored; nodes without a real edge
    do not come out (they are their own component).  An empty table gives an
    empty result.
    """
    cur = stage(
        edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc"
    )
    state = _state(cur)
    for _ in range(max_rounds):
        # large star: every larger neighbour of u moves to the minimum around u
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        big = _with_min(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: u and its smaller neighbours move to the least of them
        sm = _with_min(big)
        small = sm.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(sm.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        old, cur = cur, stage(small, "cc")
        release(old)  # written and read for the last time
        new = _state(cur)
        if new == state:
            break
        state = new
    else:
        raise RuntimeError(f"components did not converge in {max_rounds} rounds")
    stars = cur.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return stars.unionByName(stars.select(F.col("label").alias("node"), "label").distinct())
