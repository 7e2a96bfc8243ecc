"""Spatial aggregation (CL-1 ... CL-5).

``ball_clusters`` reproduces the order-dependent greedy ball clustering
exactly, as rounds of DataFrame joins (Q14):

* *seeds* are the lexicographically-first maximal independent set of the
  "within r" graph in item order: an item is a seed iff no lower-ordered
  seed lies within r;
* a seed with at least two items within r (itself included) is a cluster;
  its members are *all* items within r;
* the representative of a cluster is the member closest to the members'
  mean (first item on ties); an item keeps the representative flag only for
  the highest-ordered cluster that contains it (later clusters overwrite
  the flags of earlier ones).

The grid has cells of side r/sqrt(2), so a seed decides its whole cell.  A
round solves *tiles* of the grid in item order, each with a margin of the cells
around it: an item whose lower-ordered neighbours are all decided is decided,
so a chain of items costs a round only where it crosses into another tile.
Tiles are nodes of a linear quadtree over the undecided items: only crowded
nodes are split, and a tile holds ``TILE_ITEMS`` items at most, of every cell
the ``CELL_ITEMS`` lowest-ordered ones (an item that the rest of a cell might
still forestall waits; the packing of seeds bounds how often).  Items within r of a new seed
leave; every round writes the undecided set as a table, so lineage stays flat
and lost executors replay one round at most.
"""

from __future__ import annotations

import logging
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from featurescape.operators.spatial import (CROWDED, OFFSETS, deal_crowded, explode_neighbour_cells, quadtree_leaves,
                                            valid_xy, with_cells)
from featurescape.session import materialize

DEFAULT_RADIUS = 10.0
TILE_ITEMS = 16384          # items that a tile solves, besides those around it
CELL_ITEMS = 32             # items of a cell that take part in a round
TREE_LEVELS = 40            # halvings of the grid that a tile may span

log = logging.getLogger(__name__)


def solve_tile(items: pd.DataFrame, r: float) -> np.ndarray:
    """Which items (in order of ``ord``) are certainly seeds, given this tile's own
    undecided items (``own``) and those of the cells around it.  ``last`` is the
    highest order that is present of a cell that has more items, else null."""
    seeds: dict[tuple, tuple] = {}                    # cell -> (x, y)
    open_items: dict[tuple, list] = {}                # cell -> undecidable items so far
    cells = list(zip(items["cx"].tolist(), items["cy"].tolist()))
    last = {c: v for c, v in zip(cells, items["last"].tolist()) if v == v and v is not None}
    out = np.zeros(len(items), bool)
    for i, (c, o, x, y, own) in enumerate(zip(cells, items["ord"].tolist(), items["x"].tolist(),
                                              items["y"].tolist(), items["own"].tolist())):
        if c in seeds:
            continue
        around = [(c[0] + dx, c[1] + dy) for dx, dy in OFFSETS]
        if any(n in seeds and math.hypot(x - seeds[n][0], y - seeds[n][1]) <= r for n in around):
            continue                                  # covered
        free = own
        for n in around if free else ():
            if n in last and o > last[n] and n not in seeds:
                free = False                          # items of that cell are missing
            elif any(math.hypot(x - a, y - b) <= r for a, b in open_items.get(n, ())):
                free = False
            if not free:
                break
        if free:
            seeds[c] = (x, y)
            open_items.pop(c, None)                   # the whole cell is covered
            out[i] = True
        else:
            open_items.setdefault(c, []).append((x, y))
    return out


def cluster_seeds(pts: DataFrame, r: float, tile_items: int = TILE_ITEMS, limit: int = CROWDED) -> DataFrame:
    """Seeds ``(sid, sord, sx, sy, scx, scy)`` of the greedy pass.
    ``pts``: ``(id, ord, x, y, cx, cy)``."""
    undecided, seeds, rounds = pts, None, 0
    by_order = Window.partitionBy("cx", "cy").orderBy("ord", "id")
    item = "id string, ord long, x double, y double, cx long, cy long"
    while True:     # every round decides the lowest undecided item at least
        low = undecided.withColumn("place", F.row_number().over(by_order)).where(F.col("place") <= CELL_ITEMS + 1)
        counts = low.groupBy("cx", "cy").agg(
            F.least(F.max("place"), F.lit(CELL_ITEMS)).alias("n"),
            F.max(F.when(F.col("place") == CELL_ITEMS, F.col("ord"))).alias("last"),
            F.max("place").alias("most"))
        counts = materialize(counts.select("cx", "cy", "n", F.when(F.col("most") > CELL_ITEMS, F.col("last")).alias("last")))
        tiles = materialize(quadtree_leaves(counts.select("cx", "cy", "n"), tile_items, TREE_LEVELS))
        low = (low.where(F.col("place") <= CELL_ITEMS).drop("place")
               .join(counts.drop("n"), ["cx", "cy"]).join(tiles, ["cx", "cy"]))
        around = explode_neighbour_cells(low, "cx", "cy").join(
            tiles.toDF("ncx", "ncy", "nlevel", "ntx", "nty"), ["ncx", "ncy"])
        own = (F.col("level") == F.col("nlevel")) & (F.col("tx") == F.col("ntx")) & (F.col("ty") == F.col("nty"))
        dealt = around.select("id", "ord", "x", "y", "cx", "cy", "last", own.alias("own"), "nlevel", "ntx", "nty").distinct()

        def solve(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["ord", "id"], ignore_index=True)
            return pdf.loc[solve_tile(pdf, r), ["id", "ord", "x", "y", "cx", "cy"]]

        new = dealt.groupBy("nlevel", "ntx", "nty").applyInPandas(solve, item)
        new = materialize(new.select(F.col("id").alias("sid"), F.col("ord").alias("sord"), F.col("x").alias("sx"),
                                     F.col("y").alias("sy"), F.col("cx").alias("scx"), F.col("cy").alias("scy")))
        seeds = new if seeds is None else seeds.unionByName(new)
        # A seed covers its own cell; other items leave if some seed around is near.
        reach = explode_neighbour_cells(new, "scx", "scy").groupBy(F.col("ncx").alias("cx"), F.col("ncy").alias("cy")).agg(
            F.collect_list(F.struct("sx", "sy", ((F.col("scx") == F.col("ncx")) & (F.col("scy") == F.col("ncy"))).alias("own")))
            .alias("seeds"))                                                     # one a cell around: 25 at most
        rest, reach = deal_crowded(undecided, reach, ["cx", "cy"], "id", limit)
        covered = F.exists("seeds", lambda s: s["own"] | (F.hypot(F.col("x") - s["sx"], F.col("y") - s["sy"]) <= F.lit(r)))
        rest = rest.join(reach, ["cx", "cy", "part"], "left").where(~F.coalesce(covered, F.lit(False)))
        undecided = materialize(rest.select("id", "ord", "x", "y", "cx", "cy"))
        rounds += 1
        if undecided.isEmpty():
            log.info("ball clustering: %d rounds", rounds)
            return seeds


def ball_cluster_tables(pos: DataFrame, r: float = DEFAULT_RADIUS, id_col: str = "ID",
                        order_col: str = "_ord", limit: int = CROWDED, tile_items: int = TILE_ITEMS):
    """CL-1...CL-4 as two tables: per positioned item ``(ID, x, y,
    clustered, representative, cluster, visible)`` and per cluster
    ``(cluster, size, centre_x, centre_y, representative)``.  ``cluster``
    of an item is the seed id of the highest-ordered cluster containing it;
    ``visible`` is the aggregated view (not clustered, or representative)."""
    base = valid_xy(pos).select(F.col(id_col).cast("string").alias("id"),
                                F.col(order_col).cast("long").alias("ord"), "x", "y")
    # the input may be a deep lazy plan (encode, joins, filters, scaling):
    # every round reads the points several times, so write them once
    pts = materialize(with_cells(base, r))
    seeds = cluster_seeds(pts, r, tile_items, limit)   # union of round tables
    seeds_ex = explode_neighbour_cells(seeds, "scx", "scy").withColumnsRenamed({"ncx": "cx", "ncy": "cy"})
    # crowded cells and large clusters are dealt to parts of ``limit`` rows
    dealt, seeds_ex = deal_crowded(pts, seeds_ex, ["cx", "cy"], "id", limit)
    member = (dealt.join(seeds_ex, ["cx", "cy", "part"])
                      .where(F.hypot(F.col("x") - F.col("sx"), F.col("y") - F.col("sy")) <= F.lit(r))
                      .select("sid", "sord", "id", "ord", "x", "y"))
    member = materialize(member)
    centre = (member.groupBy("sid")
                    .agg(F.count(F.lit(1)).alias("size"), F.avg("x").alias("mx"), F.avg("y").alias("my")))
    clusters = centre.where(F.col("size") >= 2)
    dealt, centres = deal_crowded(member, clusters, ["sid"], "id", limit)
    in_cluster = dealt.join(centres, ["sid", "part"]).drop("part")
    d = F.hypot(F.col("x") - F.col("mx"), F.col("y") - F.col("my"))
    reps = (in_cluster.groupBy("sid")
                      .agg(F.min(F.struct(d.alias("d"), F.col("ord"), F.col("id"))).alias("b"))
                      .select("sid", F.col("b.id").alias("rep")))
    last = (in_cluster.groupBy("id")
                      .agg(F.max(F.struct("sord", "sid")).alias("m"))
                      .select("id", F.col("m.sid").alias("cluster")))
    dealt, named = deal_crowded(last, reps.withColumnRenamed("sid", "cluster"), ["cluster"], "id", limit)
    flags = (dealt.join(named, ["cluster", "part"])
                 .select("id", "cluster", (F.col("rep") == F.col("id")).alias("representative")))
    out = (base.join(flags, "id", "left")
               .select(F.col("id").alias(id_col), "x", "y",
                       F.col("cluster").isNotNull().alias("clustered"),
                       F.coalesce(F.col("representative"), F.lit(False)).alias("representative"),
                       "cluster"))
    items = out.withColumn("visible", ~F.col("clustered") | F.col("representative"))
    summary = (clusters.join(reps, "sid")
                       .select(F.col("sid").alias("cluster"), "size", F.col("mx").alias("centre_x"),
                               F.col("my").alias("centre_y"), F.col("rep").alias("representative")))
    return items, summary


def ball_clusters(pos: DataFrame, r: float = DEFAULT_RADIUS, id_col: str = "ID",
                  order_col: str = "_ord", limit: int = CROWDED, tile_items: int = TILE_ITEMS) -> DataFrame:
    """CL-1...CL-4 per item (see :func:`ball_cluster_tables`)."""
    return ball_cluster_tables(pos, r, id_col, order_col, limit, tile_items)[0]


def aggregated_view(clustered: DataFrame) -> DataFrame:
    """CL-4: the items drawn when aggregation is on."""
    return clustered.where(~F.col("clustered") | F.col("representative"))


def grid_clusters(pos: DataFrame, cell: float, id_col: str = "ID", order_col: str = "_ord",
                  limit: int = CROWDED) -> DataFrame:
    """CL-5: one cluster per grid cell of side ``cell`` in a single
    aggregation: ``(cell_x, cell_y, n, centre_x, centre_y, representative)``;
    the representative is the member nearest the centre (first item on
    ties).  Centres are combined map-side; members meet their cell's centre in
    parts of ``limit`` rows, each of which sends its nearest one on."""
    p = (valid_xy(pos).select(F.col(id_col).cast("string").alias("id"), F.col(order_col).alias("ord"), "x", "y")
                      .withColumn("cell_x", F.floor(F.col("x") / F.lit(cell)))
                      .withColumn("cell_y", F.floor(F.col("y") / F.lit(cell))))
    centre = p.groupBy("cell_x", "cell_y").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("centre_x"),
                                               F.avg("y").alias("centre_y"))
    dealt, centres = deal_crowded(p, centre, ["cell_x", "cell_y"], "id", limit)
    j = dealt.join(centres, ["cell_x", "cell_y", "part"])
    d = F.hypot(F.col("x") - F.col("centre_x"), F.col("y") - F.col("centre_y"))
    rep = j.groupBy("cell_x", "cell_y").agg(F.min(F.struct(d.alias("d"), F.col("ord"), F.col("id"))).alias("b"))
    return (centre.join(rep, ["cell_x", "cell_y"])
                  .select("cell_x", "cell_y", "n", "centre_x", "centre_y",
                          F.col("b.id").alias("representative")))
