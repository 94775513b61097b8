"""Display values: sizes, times, metadata lines, tagged text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tilewright.functions.paths import is_blank

# Metadata fields in display order (field, label, starts a block).
EXIF_FIELDS = (
    ("make", "Make", False),
    ("model", "Model", False),
    ("lens", "Lens", False),
    ("exposure_time", "Exposure Time", True),
    ("f_number", "Aperture", False),
    ("iso", "ISO", False),
    ("flash", "Flash", False),
    ("taken", "Taken", True),
    ("icc_profile", "ICC Profile", True),
    ("color_space", "Color Space", False),
    ("color_depth", "Bits Per Sample", False),
    ("color_type", "Color Type", False),
    ("gps_latitude", "GPS Latitude", True),
    ("gps_longitude", "GPS Longitude", False),
    ("compression", "Compression", True),
    ("software", "Software", False),
)


def size_text(size: Column) -> Column:
    """Bytes, kB or MB with one decimal, rounded half to even, no trailing '.0'."""
    mb = F.regexp_replace(F.format_string("%.1f", F.bround(size / (1024.0 * 1024.0), 1)), r"\.0$", "")
    return (
        F.when(size >= 2 * 1024 * 1024, F.concat(mb, F.lit(" MB")))
        .when(size >= 1024, F.concat(F.bround(size / 1024.0, 0).cast("long").cast("string"), F.lit(" kB")))
        .otherwise(F.concat(size.cast("string"), F.lit(" bytes")))
    )


def ms_text(ms: Column) -> Column:
    return F.when(ms.isNull(), "n/a").when(ms < 10, F.format_string("%.2f", ms)).otherwise(F.format_string("%.0f", ms))


def assign(current: Column, new: Column, high: bool) -> Column:
    """Priority coalesce: an empty value takes the new one; an equal or blank new
    value changes nothing; else only high priority replaces."""
    cur, new = F.coalesce(current, F.lit("")), F.coalesce(new, F.lit(""))
    return F.when(cur == "", new).when((new == cur) | is_blank(new), cur).otherwise(new if high else cur)


def exif_has_data(exif: Column) -> Column:
    return F.exists(F.array(*[exif[f] for f, _, _ in EXIF_FIELDS]), lambda v: ~is_blank(v))


def exif_lines(exif: Column) -> Column:
    """'Label: value' lines of the non-blank fields; an empty line between blocks,
    none at either end and never two together."""
    parts, block = [], 0
    for f, label, starts in EXIF_FIELDS:
        block += starts
        line = F.when(~is_blank(exif[f]), F.concat(F.lit(label + ": "), exif[f]))
        parts.append(F.struct(F.lit(block).alias("b"), line.alias("t")))
    shown = F.filter(F.array(*parts), lambda p: p["t"].isNotNull())
    zero = F.struct(F.lit(-1).alias("b"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(
        shown,
        zero,
        lambda a, p: F.struct(
            p["b"].alias("b"),
            F.concat(a["out"], F.when((a["b"] >= 0) & (p["b"] != a["b"]), F.array(F.lit(""), p["t"])).otherwise(F.array(p["t"]))).alias("out"),
        ),
        lambda a: a["out"],
    )


def exif_report(exif: Column, valid: Column) -> Column:
    """The lines shown for a document: metadata, or why there is none."""
    return (
        F.when(exif.isNull(), F.array(F.lit("<f>No EXIF metadata</>")))
        .when(~valid, F.array(F.lit("<f>Failed to parse EXIF metadata.</>")))
        .when(~exif_has_data(exif), F.array(F.lit("<f>No recognized EXIF metadata</>")))
        .otherwise(exif_lines(exif))
    )


def tagged_parts(line: Column) -> Column:
    """Parts of a line with inline tags <e>, <f>, <d> and </>: array of
    struct(tag, text), tag '' for plain text."""
    found = F.regexp_extract_all(line, F.lit(r"(<[efd]>|</>|(?:(?!<[efd]>|</>).)+)"), 1)
    zero = F.struct(F.lit("").alias("tag"), F.array().cast("array<struct<tag:string,text:string>>").alias("out"))
    return F.aggregate(
        found,
        zero,
        lambda a, t: F.when(t == "</>", F.struct(F.lit("").alias("tag"), a["out"].alias("out")))
        .when(t.rlike("^<[efd]>$"), F.struct(F.substring(t, 2, 1).alias("tag"), a["out"].alias("out")))
        .otherwise(F.struct(a["tag"].alias("tag"), F.array_append(a["out"], F.struct(a["tag"].alias("tag"), t.alias("text"))).alias("out"))),
        lambda a: a["out"],
    )


def overlay_lines(collection_type, directory, index, count, dir_index, dir_count, file_name, size, description, width, height, grey, zoom, mode, sampling) -> Column:
    """The five report lines of a document, from columns of these names."""
    nav = F.when(dir_index.isNotNull() & dir_count.isNotNull(), F.format_string(" <e>(%d/%d)</>", dir_index, dir_count)).otherwise("")
    return F.array(
        F.format_string("[Collection]    %s  |  Dir: %s/", collection_type, directory),
        F.format_string("[File]          %d/%d%s  |  %s  |  %s", index, count, nav, file_name, size_text(size)),
        F.concat(F.format_string("[Image]         %s  |  %dx%d", description, width, height), F.when(grey, "  |  Greyscale").otherwise("")),
        F.format_string("[Displaying]    Zoom: %d%%  |  Display Mode: %s", zoom, mode),
        F.format_string("[System]        Graphics API: OpenGL  |  Sampling: %s", sampling),
    )
