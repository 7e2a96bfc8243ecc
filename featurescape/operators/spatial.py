"""Spatial joins and view predicates (JN-4, JN-5, FLT-13, FLT-14, FLT-15).

Distance joins never become Cartesian products: points are bucketed into a
grid of side ``r / sqrt(2)`` and joined on cell ids against the 5 x 5 block
of neighbour cells (any pair within ``r`` lies in such a block), then the
exact distance test runs on the candidates.  Crowded cells are counted first
and dealt to parts of a bounded number of rows on the crowded side, the other side
going to every part, so that no task gets a whole cell.  The nearest-item join
splits crowded cells further, into the leaves of a linear quadtree of distinct positions:
a leaf is skipped when another one is surely nearer.  The cell side also guarantees that
all points of one cell are within ``r`` of each other, which the clustering uses
to avoid pairing points inside a cell at all.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featurescape.operators.ids import broadcast_if_small
from featurescape.session import materialize

CROWDED = 10_000            # rows of a key that one task may get
LEAF_ITEMS = 256            # distinct positions in a leaf of the nearest-item join
LEAF_LEVELS = 20            # halvings of a cell's side down to the finest leaf
OFFSETS = [(dx, dy) for dx in range(-2, 3) for dy in range(-2, 3)]


def cell_side(r: float) -> float:
    if r <= 0:
        raise ValueError("radius must be positive")
    return r / math.sqrt(2.0)


def with_cells(df: DataFrame, r: float, x: str = "x", y: str = "y",
               prefix: str = "") -> DataFrame:
    s = cell_side(r)
    return (df.withColumn(f"{prefix}cx", F.floor(F.col(x) / F.lit(s)))
              .withColumn(f"{prefix}cy", F.floor(F.col(y) / F.lit(s))))


def explode_neighbour_cells(df: DataFrame, cx: str, cy: str, out_x: str = "ncx",
                            out_y: str = "ncy") -> DataFrame:
    """One row per neighbour cell of the 5 x 5 block (25 rows per input)."""
    offs = F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a, b in OFFSETS])
    return (df.withColumn("_o", F.explode(offs))
              .withColumn(out_x, F.col(cx) + F.col("_o.dx"))
              .withColumn(out_y, F.col(cy) + F.col("_o.dy"))
              .drop("_o"))


def valid_xy(df: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Items without a usable position take no part in spatial operators."""
    return df.where(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y))


def crowded_keys(df: DataFrame, key: list[str], limit: int = CROWDED, parts: str = "parts") -> DataFrame:
    """(key, parts) of the keys with more than ``limit`` rows: into how many parts they go.
    At most one row in ``limit`` of ``df``; broadcast when few."""
    counts = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n_")).where(F.col("n_") > limit)
    return broadcast_if_small(materialize(counts.select(*key, F.ceil(F.col("n_") / F.lit(limit)).cast("int").alias(parts))))


def deal_crowded(many: DataFrame, few: DataFrame, key: list[str], row_id: str,
                 limit: int = CROWDED) -> tuple[DataFrame, DataFrame]:
    """Both sides of an equi-join on ``key`` with a column ``part`` to join on as well: rows
    of ``many`` are dealt to the parts of their key by ``row_id``, rows of ``few`` go to all."""
    sizes = crowded_keys(many, key, limit)
    parts = F.coalesce("parts", F.lit(1))
    many = many.join(sizes, key, "left").withColumn("part", F.pmod(F.xxhash64(row_id), parts)).drop("parts")
    few = few.join(sizes, key, "left").withColumn(
        "part", F.explode(F.sequence(F.lit(0).cast("long"), parts.cast("long") - 1))).drop("parts")
    return many, few


def radius_neighbors(pos: DataFrame, r: float, id_col: str = "ID",
                     include_self: bool = True, limit: int = CROWDED) -> DataFrame:
    """JN-4: every pair ``(src, dst, dist)`` with ``dist <= r`` (coincident
    points included, Q15).  Output size is the number of neighbour pairs; a crowded
    cell's pairs are found block by block, ``limit`` rows of either side at a time."""
    p = with_cells(valid_xy(pos).select(F.col(id_col).alias("id"), "x", "y"), r)
    left = p.select(F.col("id").alias("src"), F.col("x").alias("sx"), F.col("y").alias("sy"), "cx", "cy")
    right = explode_neighbour_cells(
        p.select(F.col("id").alias("dst"), F.col("x").alias("dx_"), F.col("y").alias("dy_"), "cx", "cy"),
        "cx", "cy").drop("cx", "cy").withColumnsRenamed({"ncx": "cx", "ncy": "cy"})
    cell = ["cx", "cy"]
    rows, others = crowded_keys(left, cell, limit, "rows_"), crowded_keys(right, cell, limit, "others_")

    def blocks(side, own, other, name, own_block, other_block):
        side = side.join(rows, cell, "left").join(others, cell, "left")
        return (side.withColumn(own_block, F.pmod(F.xxhash64(name), F.coalesce(own, F.lit(1)).cast("long")))
                .withColumn(other_block, F.explode(F.sequence(F.lit(0).cast("long"),
                                                              F.coalesce(other, F.lit(1)).cast("long") - 1)))
                .drop("rows_", "others_"))

    left = blocks(left, F.col("rows_"), F.col("others_"), "src", "a", "b")
    right = blocks(right, F.col("others_"), F.col("rows_"), "dst", "b", "a")
    d = F.hypot(F.col("sx") - F.col("dx_"), F.col("sy") - F.col("dy_"))
    # Sorted, never broadcast: the planner guesses an item's size from compressed files.
    out = (left.hint("merge").join(right.hint("merge"), [*cell, "a", "b"])
           .where(d <= F.lit(r)).select("src", "dst", d.alias("dist")))
    if not include_self:
        out = out.where(F.col("src") != F.col("dst"))
    return out


def within_radius(pos: DataFrame, x0: float, y0: float, r: float = 20.0) -> DataFrame:
    """FLT-15 (lens): items strictly closer than ``r`` to (x0, y0)."""
    return pos.where(F.hypot(F.col("x") - F.lit(x0), F.col("y") - F.lit(y0)) < F.lit(r))


def in_rect(x0: float, y0: float, x1: float, y1: float) -> Column:
    lo_x, hi_x = min(x0, x1), max(x0, x1)
    lo_y, hi_y = min(y0, y1), max(y0, y1)
    return F.col("x").between(lo_x, hi_x) & F.col("y").between(lo_y, hi_y)


def select_rect(pos: DataFrame, box: tuple[float, float, float, float],
                current: DataFrame | None = None, extend: bool = False,
                id_col: str = "ID") -> DataFrame:
    """FLT-13: ids inside the inclusive box; with ``extend`` (shift) they are
    added to ``current``.  An empty box result is an empty selection."""
    hit = pos.where(in_rect(*box)).select(F.col(id_col).cast("string").alias(id_col))
    if extend and current is not None:
        return current.select(F.col(id_col).cast("string").alias(id_col)).unionByName(hit).distinct()
    return hit.distinct()


def visible_in_view(pos: DataFrame, left: float, right: float, bottom: float, top: float,
                    r: float) -> Column:
    """FLT-14: the item's box (x +- r, y +- r) strictly overlaps the view."""
    x, y = F.col("x"), F.col("y")
    return ((x + F.lit(r) > F.lit(left)) & (x - F.lit(r) < F.lit(right))
            & (y + F.lit(r) > F.lit(bottom)) & (y - F.lit(r) < F.lit(top)))


def nearest(pos: DataFrame, x0: float, y0: float, tol: float, order_col: str = "_ord") -> DataFrame:
    """JN-5, single probe: the item closest to (x0, y0) with distance
    strictly below ``tol``; ties go to the first item (top-1 is the
    feature)."""
    d = F.hypot(F.col("x") - F.lit(x0), F.col("y") - F.lit(y0))
    return pos.withColumn("dist", d).where(F.col("dist") < F.lit(tol)).orderBy("dist", order_col).limit(1)


def quadtree_leaves(cells: DataFrame, limit: int, levels: int) -> DataFrame:
    """Leaf of each cell in a linear quadtree whose nodes hold ``limit`` items at
    most: ``cells`` (cx, cy, n) -> (cx, cy, level, tx, ty), the coarsest node of up to
    ``levels`` halvings around the cell that is not too full (a fuller single cell is a leaf, too)."""
    nodes = cells.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels)))).select(
        "cx", "cy", "n", "level", F.expr("shiftright(cx, level)").alias("tx"), F.expr("shiftright(cy, level)").alias("ty"))
    fit = nodes.groupBy("level", "tx", "ty").agg(F.sum("n").alias("total")).where(
        (F.col("total") <= limit) | (F.col("level") == 0)).drop("total")
    # Counts only grow with the level, so the fitting nodes of a cell are its finest ones.
    return (nodes.drop("n").join(fit, ["level", "tx", "ty"]).groupBy("cx", "cy")
            .agg(F.max(F.struct("level", "tx", "ty")).alias("t")).select("cx", "cy", "t.level", "t.tx", "t.ty"))


def _box_distance(px, py, x0, y0, x1, y1, far: bool):
    """Smallest (or ``far``: largest) distance from a point to a box."""
    if far:
        return F.hypot(F.greatest(F.abs(px - x0), F.abs(px - x1)), F.greatest(F.abs(py - y0), F.abs(py - y1)))
    return F.hypot(F.greatest(x0 - px, px - x1, F.lit(0.0)), F.greatest(y0 - py, py - y1, F.lit(0.0)))


def nearest_join(points: DataFrame, pos: DataFrame, tol: float, point_id: str = "pid",
                 id_col: str = "ID", order_col: str = "_ord", leaf_items: int = LEAF_ITEMS) -> DataFrame:
    """JN-5, batch: for every probe ``(pid, x, y)`` the nearest item within
    ``tol`` (strict), first item on ties; probes without a hit get nulls.

    Coincident items are one position with its first item.  Positions lie in quadtree
    leaves of ``leaf_items`` at most; a probe meets the boxes of the leaves in the cells
    around it, and the positions only of those leaves that may hold its nearest one."""
    side = cell_side(tol)
    spots = (valid_xy(pos).groupBy(F.col("x").alias("ix"), F.col("y").alias("iy"))
             .agg(F.min(F.struct(F.col(order_col).alias("_ordv"), F.col(id_col).alias("_id"))).alias("first")))
    fine = F.lit(float(1 << LEAF_LEVELS))
    spots = materialize(with_cells(spots, tol, "ix", "iy")
                        .withColumn("fx", F.least(F.floor((F.col("ix") / F.lit(side) - F.col("cx")) * fine), fine - 1).cast("long"))
                        .withColumn("fy", F.least(F.floor((F.col("iy") / F.lit(side) - F.col("cy")) * fine), fine - 1).cast("long")))
    # Fine cells of the whole plane are numbered so that a node never spans two cells of the join.
    width = F.lit(1 << LEAF_LEVELS)
    spots = spots.withColumn("gx", F.col("cx") * width + F.col("fx")).withColumn("gy", F.col("cy") * width + F.col("fy"))
    # A cell with few positions is one leaf: the node that covers it whole.
    full = spots.groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > leaf_items).select("cx", "cy")
    full = broadcast_if_small(materialize(full))
    cells = (spots.join(full, ["cx", "cy"], "left_semi")
             .groupBy(F.col("gx").alias("cx"), F.col("gy").alias("cy")).agg(F.count(F.lit(1)).alias("n")))
    tree = quadtree_leaves(cells, leaf_items, LEAF_LEVELS).toDF("gx", "gy", "level", "tx", "ty")
    spots = materialize(spots.join(tree, ["gx", "gy"], "left").select(
        "ix", "iy", "first", "cx", "cy", F.coalesce("level", F.lit(LEAF_LEVELS)).alias("level"),
        F.coalesce("tx", "cx").alias("tx"), F.coalesce("ty", "cy").alias("ty")))
    leaf = ["level", "tx", "ty"]
    boxes = spots.groupBy("cx", "cy", *leaf).agg(F.min("ix").alias("x0"), F.min("iy").alias("y0"),
                                                 F.max("ix").alias("x1"), F.max("iy").alias("y1"))
    probes = materialize(points.select(F.col(point_id).alias("_pid"), F.col("x").alias("px"), F.col("y").alias("py"))
                         .withColumn("_row", F.monotonically_increasing_id()))
    placed = explode_neighbour_cells(with_cells(probes, tol, "px", "py"), "cx", "cy").drop("cx", "cy")
    met = placed.withColumnsRenamed({"ncx": "cx", "ncy": "cy"}).join(boxes, ["cx", "cy"])
    box = [F.col(c) for c in ("px", "py", "x0", "y0", "x1", "y1")]
    met = met.withColumn("low", _box_distance(*box, far=False)).withColumn("high", _box_distance(*box, far=True))
    met = materialize(met.where(F.col("low") < F.lit(tol)).select("_row", "px", "py", *leaf, "low", "high"))
    bound = met.groupBy("_row").agg(F.min("high").alias("bound"))
    # A box's far corner is at least as far as the position it stands for, up to rounding.
    wanted = met.join(bound, "_row").where(F.col("low") <= F.col("bound") * (1 + 1e-9))
    d = F.hypot(F.col("px") - F.col("ix"), F.col("py") - F.col("iy"))
    best = (wanted.join(spots.drop("cx", "cy"), leaf).withColumn("dist", d).where(F.col("dist") < F.lit(tol))
            .groupBy("_row").agg(F.min(F.struct("dist", "first")).alias("b")))
    return probes.join(best, "_row", "left").select(
        F.col("_pid").alias(point_id), F.col("b.first._id").alias(id_col), F.col("b.dist").alias("dist"))
