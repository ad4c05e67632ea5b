"""3D shell layout in closed form: the hub at the origin, shells by rank of degree, golden-angle directions."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import degree, symmetric

#: Fixed value: the golden angle
GOLDEN = math.pi * (3.0 - math.sqrt(5.0))


def shells(nodes: DataFrame, edges: DataFrame, seed: int = 0) -> DataFrame:
    """(node, degree, shell, x, y, z). ``nodes`` (node) and ``edges`` (a, b) are of a trimmed graph, so bounded by
    max_graph_nodes; isolated nodes have degree 0 and lie outermost. One node alone lies at the origin."""
    deg = nodes.select("node").join(degree(edges, "a", "b"), "node", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    near = symmetric(edges.select("a", "b")).where("a <> b").join(deg.select(F.col("node").alias("b"), F.col("degree").alias("nd")), "b")
    anchor = near.groupBy(F.col("a").alias("node")).agg(F.min(F.struct((-F.col("nd")).alias("d"), "b"))["b"].alias("anchor"))
    everything = Window.orderBy(F.desc("degree"), "node")
    placed = deg.join(anchor, "node", "left").withColumn("anchor", F.coalesce("anchor", F.lit(""))).withColumn("at", F.row_number().over(everything))
    hub, rest = placed.where("at = 1"), placed.where("at > 1")
    ring = rest.withColumn("shell", F.dense_rank().over(Window.orderBy(F.desc("degree"))))
    ring = ring.withColumn("shells", F.max("shell").over(Window.partitionBy())).withColumn("m", F.count("*").over(Window.partitionBy("shell")))
    ring = ring.withColumn("i", F.row_number().over(Window.partitionBy("shell").orderBy("anchor", "node")) - 1)
    y0 = 1.0 - 2.0 * (F.col("i") + 0.5) / F.col("m")
    theta = GOLDEN * F.col("i") + 0.7 * F.col("shell") + 0.1 * seed
    tilt = 1.1 * F.col("shell") + 0.37 * seed
    flat = ring.select("node", "degree", "shell", (F.col("shell") / F.col("shells")).alias("r"), y0.alias("y0"), F.sqrt(F.greatest(F.lit(0.0), 1.0 - y0 * y0)).alias("rho"), theta.alias("theta"), tilt.alias("tilt"))
    z0 = F.col("rho") * F.sin("theta")
    out = flat.select(
        "node",
        "degree",
        "shell",
        (F.col("r") * F.col("rho") * F.cos("theta")).alias("x"),
        (F.col("r") * (F.col("y0") * F.cos("tilt") - z0 * F.sin("tilt"))).alias("y"),
        (F.col("r") * (F.col("y0") * F.sin("tilt") + z0 * F.cos("tilt"))).alias("z"),
    )
    zero = F.lit(0.0)
    return hub.select("node", "degree", F.lit(0).alias("shell"), zero.alias("x"), zero.alias("y"), zero.alias("z")).unionByName(out)
