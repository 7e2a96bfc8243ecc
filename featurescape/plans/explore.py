"""The exploration plan (the flagship): items + positions + filters -> the
items a view draws.

``load -> attach_positions -> mark_passive -> scale_positions ->
ball_clusters -> aggregated view``.  Everything up to the clustering is one
lazy Catalyst plan; the clustering adds its bounded, materialised rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featurescape.functions import colors
from featurescape.operators import cluster, filters, items, positions


def explore(encoded: DataFrame, pos: DataFrame, algorithm: str, flt: list | None = None,
            width: float = 1600.0, height: float = 900.0, radius: float = cluster.DEFAULT_RADIUS,
            color_feature: str | None = None, aggregated: bool = True, id_col: str = "ID",
            order_col: str = "_ord") -> DataFrame:
    """One snapshot's view: per item ``passive``, scaled ``x, y``, colour,
    cluster flags and ``visible`` (the aggregated view when ``aggregated``)."""
    it = items.attach_positions(encoded, pos, [algorithm], id_col)
    it = it.withColumnRenamed(f"{algorithm}_x", "x").withColumnRenamed(f"{algorithm}_y", "y")
    it = filters.mark_passive(it, flt or [])
    if order_col not in it.columns:
        raise ValueError(f"the items need their order in a column {order_col}")
    scaled = positions.scale_positions(it.where(F.col("x").isNotNull() & F.col("y").isNotNull()),
                                       width, height)
    if color_feature is not None:
        scaled = scaled.withColumn("color", colors.item_color(F.col(f"`{color_feature}`"), F.col("passive")))
    clustered = cluster.ball_clusters(scaled.select(id_col, order_col, "x", "y"), radius, id_col, order_col)
    # Ids may repeat: items with one id stand at one position and share their
    # flags, so the flags are one row for each id.
    flags = clustered.groupBy(F.col(id_col).alias("_cid")).agg(
        *[F.max(c).alias(c) for c in ("clustered", "representative", "cluster")], F.max("visible").alias("_vis"))
    out = scaled.join(flags, F.col(id_col) == F.col("_cid"), "left").drop("_cid")
    vis = F.col("_vis") if aggregated else F.lit(True)
    return out.withColumn("visible", F.coalesce(vis, F.lit(True))).drop("_vis")
