"""The format dimension: extensions, descriptions, decoders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Name, extensions, description, disabled, decoder.
FORMATS = (
    ("Bmp", (".bmp",), "Windows Bitmap", False, "Skia"),
    ("Dds", (".dds",), "DirectDraw Surface Texture", True, None),
    ("Exr", (".exr",), "OpenEXR Image", False, "Exr"),
    ("Hdr", (".hdr",), "Radiance HDR Image", False, "Hdr"),
    ("Heif", (".heic", ".heif", ".avif"), "HEIF Image", False, "Heif"),
    ("Ico", (".ico",), "Windows Icon", False, "Skia"),
    ("Icns", (".icns",), "macOS Icon", True, None),
    ("Jfif", (".jif", ".jfif"), "JPEG File Interchange Format", False, "Skia"),
    ("Jp2", (".jp2",), "JPEG 2000 Image", True, None),
    ("Jpeg", (".jpg", ".jpeg"), "JPEG Image", False, "Skia"),
    ("Ktx", (".ktx", ".ktx2"), "Khronos Texture", True, None),
    ("Png", (".png",), "PNG Image", False, "Skia"),
    ("Psd", (".psd",), "Adobe Photoshop Document", False, "Psd"),
    ("Psb", (".psb",), "Adobe Photoshop Document", False, "Psd"),
    ("Svg", (".svg",), "Scalable Vector Graphics", False, "Svg"),
    ("Tga", (".tga",), "TARGA Image", False, "ImageSharp"),
    ("Tiff", (".tif", ".tiff"), "Tagged Image File Format", False, "ImageSharp"),
    ("Webp", (".webp",), "WebP Image", False, "Skia"),
    ("Unknown", (), "Unknown Format", False, None),
)
#: Decoders in the order in which they are asked; the first stands in for none.
DECODERS = ("Skia", "ImageSharp", "Heif", "Exr", "Hdr", "Psd", "Svg")
UNKNOWN = "Unknown"

_SCHEMA = "ord int, format string, extensions array<string>, description string, disabled boolean, preload_disabled boolean, decoder string"


def formats(spark: SparkSession) -> DataFrame:
    """One row per format, in declaration order (19 rows, a fixed size)."""
    rows = [(i, n, list(e), d, off, False, dec) for i, (n, e, d, off, dec) in enumerate(FORMATS)]
    return spark.createDataFrame(rows, _SCHEMA)


def normalise_extension(ext: Column) -> Column:
    """Blank becomes ''; else trimmed, lower case, with a leading dot."""
    t = F.lower(F.trim(ext))
    return F.when(ext.isNull() | (t == ""), "").when(t.startswith("."), t).otherwise(F.concat(F.lit("."), t))


def extensions(spark: SparkSession) -> DataFrame:
    """extension -> format, the first declared one (24 rows, a fixed size)."""
    e = formats(spark).select("ord", "format", "disabled", "preload_disabled", F.explode("extensions").alias("extension"))
    return e.groupBy("extension").agg(F.min_by(F.struct("format", "disabled", "preload_disabled"), "ord").alias("f")).select("extension", "f.*")


def with_format(df: DataFrame, ext: Column) -> DataFrame:
    """``df`` with extension, format ('Unknown' where none fits), supported and
    preload_allowed.  The dimension has a fixed size, so it is broadcast."""
    dim = F.broadcast(extensions(df.sparkSession))
    out = df.withColumn("extension", normalise_extension(ext)).join(dim, "extension", "left")
    known = F.col("format").isNotNull()
    return out.select(
        *df.columns,
        "extension",
        F.coalesce("format", F.lit(UNKNOWN)).alias("format"),
        (known & ~F.coalesce("disabled", F.lit(False))).alias("supported"),
        (~F.coalesce("preload_disabled", F.lit(False))).alias("preload_allowed"),
    )


def with_decoder(df: DataFrame) -> DataFrame:
    """``df`` (format) with the decoder that reads it, else the first of all."""
    dim = F.broadcast(formats(df.sparkSession).select("format", F.col("decoder").alias("_d")))
    return df.join(dim, "format", "left").select(*df.columns, F.coalesce("_d", F.lit(DECODERS[0])).alias("decoder"))


def display_name(name: Column) -> Column:
    """CamelCase split into words: the fallback for values without a description."""
    return F.regexp_replace(name, r"\B([A-Z])", " $1")
