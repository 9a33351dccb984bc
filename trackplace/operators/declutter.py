"""Thins points on a map so that the kept ones do not overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackplace.session import checkpoint

AROUND = [(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1)]
# Earliest open points of each cell that one round looks at, and cells along the
# side of the tile whose points are decided together.
CANDIDATES = 8
TILE = 8
# Rounds after which what they kept is written to one table.
ROUNDS_PER_TABLE = 16


def declutter(
    points: DataFrame, spacing: float, view: list[str], order: str = "ord", candidates: int = CANDIDATES,
) -> DataFrame:
    """Keeps, in the given order, each point with no kept one closer than
    ``spacing`` on both axes, and counts every other on the kept one nearest to
    it at its turn. ``points(view.., ord, x, y)``; ``ord`` is unique in a view.

    Returns ``view.., ord, x, y, count`` of the kept points; a point without a
    position is on no map. Which point is kept depends on the ones before it.
    Rounds of joins settle that for all views at once: the earliest open points
    of a cell are kept where no kept one is too close and no open one that comes
    before them lies in the nine cells around, and what a kept point is too
    close to is open no longer. Two points of a cell are always too close, so a
    cell keeps one at most, and counting the rest is a join with the nine cells
    around each. No view has to fit a task; there are as many rounds as decisions
    wait for one another across tiles.
    """
    cells = points.filter(F.col("x").isNotNull() & F.col("y").isNotNull()).select(
        *view, order, "x", "y",
        F.floor(F.col("x") / spacing).cast("long").alias("cx"),
        F.floor(F.col("y") / spacing).cast("long").alias("cy"),
    )
    cells = checkpoint(cells)
    kept = _kept(cells, spacing, view, order, candidates)
    return _counted(cells, kept, spacing, view, order)


def _kept(cells: DataFrame, spacing: float, view: list[str], order: str, candidates: int) -> DataFrame:
    cell = [*view, "cx", "cy"]
    still_open, kept, rounds = cells, cells.limit(0), 0
    while True:
        settled = checkpoint(_settled(_listed(still_open, cell, order, candidates), spacing, view, order))
        if settled.isEmpty():
            return kept
        kept, rounds = kept.unionByName(settled), rounds + 1
        if rounds % ROUNDS_PER_TABLE == 0:
            kept = checkpoint(kept)
        near = _around(settled, cell, order, still_open, spacing).select(*view, order).distinct()
        still_open = checkpoint(still_open.join(near, [*view, order], "left_anti"))


def _listed(still_open: DataFrame, cell: list[str], order: str, candidates: int) -> DataFrame:
    """The earliest open points of each cell; ``cut`` is the last of them where
    there are more. Every task passes on so many of a cell at most."""
    turn = F.row_number().over(Window.partitionBy(*cell).orderBy(order))
    first = still_open.withColumn("_k", turn).filter(F.col("_k") <= candidates)
    return first.withColumn("cut", F.col("_k") == candidates).drop("_k")


def _tiled(listed: DataFrame, side: int) -> DataFrame:
    """Candidates by tile of ``side`` x ``side`` cells. A cell at a tile's edge is
    also sent to the tiles beside it, as ``foreign``: they may not settle it, but
    have to wait for it. ``slot`` numbers the cells of a tile and of the rim around it."""
    tile = lambda c, d: F.floor((F.col(c) + d) / side).cast("long")
    tiles = F.array_distinct(F.array(*[
        F.struct(tile("cx", dx).alias("tx"), tile("cy", dy).alias("ty")) for dx, dy in AROUND]))
    spread = listed.withColumn("_t", F.explode(tiles)).withColumns({"tx": F.col("_t.tx"), "ty": F.col("_t.ty")})
    inside = [F.col(c) - F.col(t) * side + 1 for c, t in (("cx", "tx"), ("cy", "ty"))]
    home = (F.col("tx") == tile("cx", 0)) & (F.col("ty") == tile("cy", 0))
    return spread.drop("_t").withColumns({
        "foreign": ~home, "slot": (inside[0] * (side + 2) + inside[1]).cast("int")})


def _settled(
    listed: DataFrame, spacing: float, view: list[str], order: str, side: int | None = None,
) -> DataFrame:
    """What one round keeps. Each tile folds over its candidates in order, at most
    ``CANDIDATES`` per cell. A candidate is kept when no kept one is too close and
    nothing undecided around it, listed or not, in this tile or beside it, comes
    before it; ``waits`` says from which turn on a cell is undecided."""
    side = side or TILE
    slots = (side + 2) ** 2
    fields = {f.name: f.dataType.simpleString() for f in listed.schema}
    point = f"struct<turn:{fields[order]},x:{fields['x']},y:{fields['y']}>"
    beside = F.array(*[F.lit(dx * (side + 2) + dy) for dx, dy in AROUND])
    put = lambda values, slot, new: F.transform(values, lambda v, i: F.when(i == slot, new).otherwise(v))

    def fold(state: Column, c: Column) -> Column:
        def too_close(d):
            k = F.get(state["kept"], c["slot"] + d)
            return F.coalesce(F.greatest(F.abs(k["x"] - c["x"]), F.abs(k["y"] - c["y"])) < spacing, F.lit(False))

        def undecided(d):
            at = c["slot"] + d
            return F.get(state["kept"], at).isNull() & F.coalesce(F.get(state["waits"], at) < c["turn"], F.lit(False))

        says = F.when(c["foreign"], "wait").when(F.exists(beside, too_close), "drop").when(
            F.exists(beside, undecided), "wait").otherwise("keep")

        def apply(word: Column) -> Column:
            new = F.struct(c["turn"].alias("turn"), c["x"].alias("x"), c["y"].alias("y"))
            first = ((word == "wait") | c["cut"]) & F.get(state["waits"], c["slot"]).isNull()
            return F.struct(
                F.when(word == "keep", put(state["kept"], c["slot"], new)).otherwise(state["kept"]).alias("kept"),
                F.when(first, put(state["waits"], c["slot"], c["turn"])).otherwise(state["waits"]).alias("waits"))

        return F.transform(F.array(says), apply)[0]

    queue = F.array_sort(F.collect_list(F.struct(F.col(order).alias("turn"), "x", "y", "slot", "foreign", "cut")))
    tiles = _tiled(listed, side).groupBy(*view, "tx", "ty").agg(queue.alias("queue"))
    empty = F.struct(
        F.array_repeat(F.lit(None).cast(point), slots).alias("kept"),
        F.array_repeat(F.lit(None).cast(fields[order]), slots).alias("waits"))
    kept = F.aggregate("queue", empty, fold, lambda state: F.filter(state["kept"], lambda k: k.isNotNull()))
    found = tiles.select(*view, F.explode(kept).alias("k")).select(
        *view, F.col("k.turn").alias(order), F.col("k.x").alias("x"), F.col("k.y").alias("y"))
    return found.withColumns({
        "cx": F.floor(F.col("x") / spacing).cast("long"), "cy": F.floor(F.col("y") / spacing).cast("long")})


def _around(
    kept: DataFrame, cell: list[str], order: str, points: DataFrame, spacing: float
) -> DataFrame:
    """Points with each kept one too close to them (nine cells, one kept in each)."""
    view = cell[:-2]
    sides = F.explode(F.array(*[
        F.struct(F.lit(-dx).alias("dx"), F.lit(-dy).alias("dy")) for dx, dy in AROUND
    ]))
    reach = kept.select(
        *view, F.col(order).alias("k_ord"), F.col("x").alias("kx"), F.col("y").alias("ky"),
        "cx", "cy", sides.alias("d"),
    ).withColumns({
        "cx": F.col("cx") + F.col("d.dx"), "cy": F.col("cy") + F.col("d.dy"),
        # Where the kept point lies as seen from the other's cell.
        "side": F.struct((-F.col("d.dx")).alias("dx"), (-F.col("d.dy")).alias("dy")),
    }).drop("d")
    distance = F.greatest(F.abs(F.col("kx") - F.col("x")), F.abs(F.col("ky") - F.col("y")))
    return points.join(reach, cell).withColumn("distance", distance).filter(distance < spacing)


def _counted(
    large: DataFrame, kept: DataFrame, spacing: float, view: list[str], order: str
) -> DataFrame:
    pairs = _around(kept, [*view, "cx", "cy"], order, large, spacing)
    nearest = F.min_by("k_ord", F.struct("distance", "side"))
    counts = (
        pairs.filter(F.col("k_ord") <= F.col(order))
        .groupBy(*view, order).agg(nearest.alias("k_ord"))
        .groupBy(*view, "k_ord").agg(F.count(F.lit(1)).alias("count"))
    )
    return kept.drop("cx", "cy").join(
        counts.withColumnRenamed("k_ord", order), [*view, order]
    ).select(*view, order, "x", "y", "count")


def declutter_grid(points: DataFrame, spacing: float, view: list[str], order: str = "ord") -> DataFrame:
    """One point per grid cell, the first in order, with the number it stands
    for. Approximate: points either side of a cell border may overlap."""
    cx, cy = (F.floor(F.col(c) / spacing).cast("long").alias(f"c{c}") for c in ("x", "y"))
    return points.groupBy(*view, cx, cy).agg(
        F.min_by(F.struct(order, "x", "y"), order).alias("lead"), F.count(F.lit(1)).alias("count")
    ).select(*view, f"lead.{order}", "lead.x", "lead.y", "count")
