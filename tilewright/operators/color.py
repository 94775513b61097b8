"""Colour: calibration curves, channel processors, float pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.functions import raster

GRID = 48


def lut_samples(samples: DataFrame, *keys: str) -> DataFrame:
    """Truncated, clamped mean of v per channel key (columns k, v): a plain
    aggregation, combined before the shuffle."""
    mean = F.floor(F.sum("v") / F.count("*")).cast("int")
    return samples.groupBy(*keys, "k").agg(raster.clamp_byte(mean).alias("v"))


def lut_curve(means: DataFrame, *keys: str) -> DataFrame:
    """256 entries for each key from its sparse means (k, v).

    Before the first key its value, after the last its value, between two a line
    (rounded half up); identity if there is none at all.  A curve has at most 256
    means, so each is filled inside one row.
    """
    known = F.sort_array(F.collect_list(F.struct("k", "v")))
    rows = means.groupBy(*keys).agg(known.alias("m")) if keys else means.agg(known.alias("m"))

    def entry(k: Column) -> Column:
        left = F.element_at(F.filter("m", lambda s: s["k"] <= k), -1)
        right = F.get(F.filter("m", lambda s: s["k"] >= k), F.lit(0))
        slope = (right["v"] - left["v"]) * ((k - left["k"]).cast("double") / (right["k"] - left["k"]))
        return (
            F.when(F.size("m") == 0, k)
            .when(k < F.get(F.col("m"), F.lit(0))["k"], right["v"])
            .when(k > F.element_at("m", -1)["k"], left["v"])
            .when(left["k"] == right["k"], left["v"])
            .otherwise(F.floor(left["v"] + slope + 0.5).cast("int"))
        )

    return rows.select(*keys, F.transform(F.sequence(F.lit(0), F.lit(255)), entry).alias("curve"))


def sample_positions(size: Column, grid: int = GRID) -> Column:
    """Centres of ``grid`` equal cells along a side."""
    return F.transform(F.sequence(F.lit(0), F.lit(grid - 1)), lambda g: F.least(F.floor((g + 0.5) * size / grid).cast("int"), size - 1))


def polarity(samples: DataFrame, *keys: str) -> DataFrame:
    """inverted: whether the inverted variant of the first sample (by ord) is nearer
    to the baseline; columns r, g, b (baseline), ar.. and br.. (variants)."""
    dist = lambda p: sum((F.col(p + c) - F.col(c)) * (F.col(p + c) - F.col(c)) for c in "rgb")
    return samples.groupBy(*keys).agg(F.min_by(dist("b") < dist("a"), "ord").alias("inverted"))


def rgb_pixel(r: Column, g: Column, b: Column, luts: tuple[Column, Column, Column] | None = None) -> list[Column]:
    return [F.get(t, c) for t, c in zip(luts, (r, g, b))] if luts else [r, g, b]


def cmyk_pixel(c: Column, m: Column, y: Column, k: Column, luts: tuple[Column, Column, Column] | None = None) -> list[Column]:
    """RGB from inverted inks: by calibration curves if there are any, else by
    gamma and neutral balance."""
    rgb = [raster.cmyk_component(x, k) for x in (c, m, y)]
    if luts:
        return [F.get(t, v) for t, v in zip(luts, rgb)]
    gamma = F.array(*[F.lit(v) for v in raster.gamma_table()])
    return raster.neutral_balance(*[F.get(gamma, v) for v in rgb])


def indexed_pixel(palette: Column, i: Column, luts=None) -> list[Column]:
    """RGB from a planar palette of 3 * 256 entries (array of int)."""
    return rgb_pixel(*[F.get(palette, i + 256 * c) for c in range(3)], luts)


def write_pixel(r: Column, g: Column, b: Column, a: Column | None, pixel_format: str = "rgba", alpha: str = "straight") -> Column:
    """array of four bytes: order rgba or bgra; alpha opaque, straight or premultiplied."""
    if pixel_format not in ("rgba", "bgra") or alpha not in ("opaque", "straight", "premultiplied"):
        raise ValueError(f"not supported: {pixel_format}, {alpha}")
    a = F.lit(255) if a is None or alpha == "opaque" else a
    rgb = [raster.premultiply(c, a) for c in (r, g, b)] if alpha == "premultiplied" else [r, g, b]
    return F.array(*(rgb if pixel_format == "rgba" else rgb[::-1]), a)


def float_pixels(pixels: Column) -> Column:
    """struct(grey, rgba) of array<struct(r, g, b, a)>: tone mapped; a grey image
    shows red in all three channels."""
    grey = raster.is_grey(pixels)
    byte = F.transform(
        pixels,
        lambda p: F.array(
            raster.tone_map(p["r"]), raster.tone_map(F.when(grey, p["r"]).otherwise(p["g"])),
            raster.tone_map(F.when(grey, p["r"]).otherwise(p["b"])), raster.tone_map(p["a"]),
        ),
    )
    return F.struct(grey.alias("grey"), byte.alias("rgba"))


def calibrations(samples: DataFrame) -> DataFrame:
    """asset_id, channel, curve from samples (asset_id, channel, k, v): built per
    asset from its whole grid and joined back by asset."""
    return lut_curve(lut_samples(samples, "asset_id", "channel"), "asset_id", "channel")


def calibration_source(embedded: Column, mode: Column, default_profile: str | None = None) -> Column:
    """Where a document's calibration comes from: its own profile, for CMYK the
    given default one, else none (identity curves)."""
    default = (mode == "Cmyk") & F.lit(default_profile is not None)
    return F.when(embedded.isNotNull() & (F.octet_length(embedded) > 0), "embedded").when(default, "default").otherwise("identity")


def profile_keys(documents: DataFrame) -> DataFrame:
    """path, profile (upper-case SHA-256 of the embedded bytes, null without)."""
    return documents.select("path", F.when(F.octet_length("icc") > 0, F.upper(F.sha2("icc", 256))).alias("profile"))
