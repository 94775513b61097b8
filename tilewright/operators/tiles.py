"""Rasters as rows: scanlines of planes, resampling, tiles, viewport queries.

Plane rows are (asset_id, plane, role, y, row BINARY), one row per scanline, so
one huge raster spreads over as many tasks as it has bands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.functions import raster


def nearest_map(size: Column, into: Column) -> Column:
    """For each target position the source position: floor(x * size / into)."""
    return F.transform(F.sequence(F.lit(0), into - 1), lambda x: F.floor(x * size / into).cast("int"))


def sample_array(values: Column, size: int, into: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(into - 1)), lambda x: F.get(values, F.floor(x * size / into).cast("int")))


def sample_row(row: Column, size: Column, into: Column) -> Column:
    """Nearest sampling of one binary scanline."""
    byte = lambda x: F.hex(F.substring(row, F.floor(x * size / into).cast("int") + 1, F.lit(1)))
    return F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), into - 1), byte), ""))


def resample(plane_rows: DataFrame, dims: DataFrame) -> DataFrame:
    """Plane rows scaled to dims (asset_id, w, h, to_w, to_h) by nearest rows and columns."""
    ys = dims.select("asset_id", "w", "to_w", F.posexplode(nearest_map(F.col("h"), F.col("to_h"))).alias("ty", "y"))
    j = plane_rows.join(ys, ["asset_id", "y"])
    return j.select("asset_id", "plane", "role", F.col("ty").alias("y"), sample_row(F.col("row"), F.col("w"), F.col("to_w")).alias("row"))


def tile_grid(dims: DataFrame) -> DataFrame:
    """One row per tile of dims (asset_id, w, h, tile_w, tile_h); edge tiles are smaller."""
    n = lambda size, edge: F.ceil(F.col(size) / F.col(edge)).cast("int")
    g = dims.withColumn("ty", F.explode(F.sequence(F.lit(0), n("h", "tile_h") - 1)))
    g = g.withColumn("tx", F.explode(F.sequence(F.lit(0), n("w", "tile_w") - 1)))
    g = g.withColumn("x0", F.col("tx") * F.col("tile_w")).withColumn("y0", F.col("ty") * F.col("tile_h"))
    return g.select(
        "asset_id", "tx", "ty", "x0", "y0",
        F.least("tile_w", F.col("w") - F.col("x0")).alias("w"), F.least("tile_h", F.col("h") - F.col("y0")).alias("h"),
    )


def assemble(rows: DataFrame, *keys: str) -> DataFrame:
    """Scanlines (y, row) of each key joined top down into ``data``."""
    ordered = F.sort_array(F.collect_list(F.struct("y", F.hex("row").alias("x"))))
    return rows.groupBy(*keys).agg(F.unhex(F.array_join(F.transform(ordered, lambda s: s["x"]), "")).alias("data"))


def cut_tiles(plane_rows: DataFrame, dims: DataFrame) -> DataFrame:
    """asset_id, plane, role, tx, ty, data: every scanline is cut into its tile
    columns, and a tile's segments meet by its key, so a band is never whole in one task."""
    j = plane_rows.join(dims, "asset_id").withColumn("ty", F.floor(F.col("y") / F.col("tile_h")).cast("int"))
    j = j.withColumn("tx", F.explode(F.sequence(F.lit(0), F.ceil(F.col("w") / F.col("tile_w")).cast("int") - 1)))
    seg = F.substring(F.col("row"), F.col("tx") * F.col("tile_w") + 1, F.least(F.col("tile_w"), F.col("w") - F.col("tx") * F.col("tile_w")))
    return assemble(j.select("asset_id", "plane", "role", "tx", "ty", "y", seg.alias("row")), "asset_id", "plane", "role", "tx", "ty")


def tile_at(p: Column, edge: Column, n: Column) -> Column:
    """Index of the tile that holds a coordinate, clamped to the grid."""
    return F.greatest(F.lit(0), F.least(F.floor(p / edge).cast("int"), n - 1))


def tiles_in(tiles: DataFrame, rect: Column, tile_w: Column, tile_h: Column) -> DataFrame:
    """Tiles that overlap a rectangle: a range of tile indexes (which prunes a
    table partitioned by ty) and the exact test."""
    index = lambda v, edge: F.floor(v / edge)
    near = F.col("tx").between(index(rect["left"], tile_w), index(rect["right"], tile_w)) & F.col("ty").between(
        index(rect["top"], tile_h), index(rect["bottom"], tile_h)
    )
    exact = (F.col("x0") < rect["right"]) & (F.col("x0") + F.col("w") > rect["left"]) & (F.col("y0") < rect["bottom"]) & (F.col("y0") + F.col("h") > rect["top"])
    return tiles.filter(near & exact)


def view_tiles(views: DataFrame, tiles: DataFrame) -> DataFrame:
    """The tiles that each view draws over its preview: view_id and the columns of ``tiles``.

    ``views``: view_id, asset_id, image_w, image_h, window_w, window_h, scale, zoom
    (percent), off_x, off_y, tile_w, tile_h, preview_w, preview_h (null: there is no
    preview, and tiles are always drawn).  Nothing comes for a view off screen, for
    one that its preview is sharp enough for, and for images without a size.

    A view is a short list of tile indexes, as its window is bounded, so tiles are
    looked up by (asset_id, tx, ty) and no task needs all tiles of an asset.  Both
    sides are sorted for it: Spark takes exploded rows for as few as the rows they
    come from, and would send a whole grid through the driver.
    """
    rect = raster.visible_rect(*[F.col(c) for c in ("image_w", "image_h", "window_w", "window_h", "scale", "zoom", "off_x", "off_y")])
    ppu = raster.preview_ppu(F.col("preview_w"), F.col("preview_h"), F.col("image_w"), F.col("image_h"))
    wanted = F.col("preview_w").isNull() | raster.needs_tiles(F.col("zoom"), F.col("scale"), ppu)
    v = views.filter((F.col("image_w") > 0) & (F.col("image_h") > 0)).filter(wanted).withColumn("_r", rect).filter("_r is not null")

    def indexes(low: str, high: str, edge: str, size: str) -> Column:
        n = F.ceil(F.col(size) / F.col(edge)).cast("int")
        # a tile that begins where the rectangle ends does not overlap it
        last = F.ceil(F.col("_r")[high] / F.col(edge)).cast("int") - 1
        return F.explode(F.sequence(tile_at(F.col("_r")[low], F.col(edge), n), F.greatest(F.lit(0), F.least(last, n - 1))))

    v = v.withColumn("ty", indexes("top", "bottom", "tile_h", "image_h")).withColumn("tx", indexes("left", "right", "tile_w", "image_w"))
    return v.select("view_id", "asset_id", "tx", "ty").hint("merge").join(tiles, ["asset_id", "tx", "ty"]).select("view_id", *tiles.columns)


def spiral(tiles: DataFrame, seed_x: Column, seed_y: Column) -> DataFrame:
    """Tiles with their place in the spiral around a seed tile."""
    return tiles.withColumn("spiral", raster.spiral_position(F.col("tx") - seed_x, F.col("ty") - seed_y))


def band_order(tiles: DataFrame, seed_x: Column, seed_y: Column) -> DataFrame:
    """asset_id, ty, first: bands by their first tile in the spiral."""
    return spiral(tiles, seed_x, seed_y).groupBy("asset_id", "ty").agg(F.min("spiral").alias("first"))


def centre_out(n: Column) -> Column:
    """Bands from the middle outward, the upper one first at equal distance."""
    mid = F.floor(n / 2).cast("int")
    order = F.sort_array(F.transform(F.sequence(F.lit(0), n - 1), lambda b: F.struct(F.abs(b - mid).alias("d"), b.alias("b"))))
    return F.transform(order, lambda s: s["b"])


def normalise_bands(bands: Column, n: Column) -> Column:
    """Bands inside the grid, first occurrence each; missing ones are not added."""
    return F.array_distinct(F.filter(bands, lambda b: (b >= 0) & (b < n)))


def completion(tiles: DataFrame, totals: DataFrame) -> DataFrame:
    """asset_id, ready, total, complete from tiles (data may be null) and totals."""
    ready = tiles.groupBy("asset_id").agg(F.count_if(F.col("data").isNotNull()).alias("ready"))
    out = totals.join(ready, "asset_id", "left").withColumn("ready", F.coalesce("ready", F.lit(0)))
    return out.withColumn("complete", F.col("ready") == F.col("total"))


def plane(plane_rows: DataFrame, role: str) -> DataFrame:
    """The scanlines of one role; a raster without it fails the query."""
    has = plane_rows.groupBy("asset_id").agg(F.max((F.col("role") == role).cast("int")).alias("_has"))
    fail = F.raise_error(F.lit(f"no plane {role}"))
    kinds = dict(plane_rows.dtypes)
    missing = has.filter("_has = 0").select(*[fail.cast(kinds[c]).alias(c) for c in plane_rows.columns])
    return plane_rows.filter(F.col("role") == role).unionByName(missing)
