"""Metadata records from tag directories."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tilewright.functions.text import EXIF_FIELDS, assign

# Field -> (directory, tag) of the common mapping.
BASE_TAGS = {
    "make": ("ifd0", "Make"),
    "model": ("ifd0", "Model"),
    "software": ("ifd0", "Software"),
    "lens": ("sub_ifd", "LensModel"),
    "exposure_time": ("sub_ifd", "ExposureTime"),
    "f_number": ("sub_ifd", "FNumber"),
    "iso": ("sub_ifd", "IsoEquivalent"),
    "flash": ("sub_ifd", "Flash"),
    "taken": ("sub_ifd", "DateTimeOriginal"),
    "compression": ("sub_ifd", "Compression"),
    "gps_latitude": ("gps", "Latitude"),
    "gps_longitude": ("gps", "Longitude"),
    "icc_profile": ("icc", "Description"),
}
# Later directories: (directory, tag, field, high priority).
OVERRIDES = (
    ("jpeg", "Compression", "compression", False),
    ("png", "IccProfile", "icc_profile", False),
    ("png", "BitsPerSample", "color_depth", True),
    ("png", "ColorType", "color_type", True),
    ("png", "Compression", "compression", False),
)


def exif_record(directories: Column) -> Column:
    """struct of the 16 fields from map<directory, map<tag, text>>; what is missing
    is ''.  The embedded colour space gives way to the tagged one."""
    tag = lambda d, t: F.coalesce(directories[d][t], F.lit(""))
    value = {f: tag(*BASE_TAGS[f]) if f in BASE_TAGS else F.lit("") for f, _, _ in EXIF_FIELDS}
    value["color_space"] = assign(tag("sub_ifd", "ColorSpace"), tag("icc", "ColorSpace"), False)
    for d, t, f, high in OVERRIDES:
        value[f] = F.when(directories[d].isNotNull(), assign(value[f], tag(d, t), high)).otherwise(value[f])
    return F.struct(*[value[f].alias(f) for f, _, _ in EXIF_FIELDS])


def header_map(header: Column, extra: dict[str, Column] | None = None) -> Column:
    """Key-value rows shown for a document; null values are left out."""
    pairs = {"Channels": header["channels"], "Depth": header["depth"], "Color Mode": header["mode_name"], "Compression": header["compression"]}
    pairs |= extra or {}
    made = F.map_from_arrays(F.array(*[F.lit(k) for k in pairs]), F.array(*[v.cast("string") for v in pairs.values()]))
    return F.map_filter(made, lambda k, v: v.isNotNull())
