"""Decoders and colour against numpy, documents made here."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.functions import raster
from tilewright.operators import color, tiles
from tilewright.plans.samples import make_psd, pack_bits, planes_of
from tilewright.sources import pixels, psd

KINDS = ("Raw", "Rle", "Zip", "ZipPredict")


def frame(spark, files):
    return spark.createDataFrame(files, "path string, content binary")


@pytest.mark.parametrize("mode,channels", [("Rgb", 3), ("Rgb", 4), ("Rgb", 5), ("Cmyk", 4), ("Cmyk", 5), ("Indexed", 1), ("Grayscale", 2)])
def test_psd_planes(spark, mode, channels):
    files = [(f"{k}{big}", make_psd(13, 6, mode, channels, k, big, seed=channels)) for k in KINDS for big in (False, True)]
    got = {}
    for r in psd.plane_rows(frame(spark, files)).collect():
        assert r.error is None
        got.setdefault(r.path, {}).setdefault(r.plane, {})[r.y] = bytes(r.row)
    want = planes_of(13, 6, channels, channels)
    roles = psd.roles_of(mode, channels)
    for path, planes in got.items():
        assert sorted(planes) == list(range(min(channels, len(roles)))), path
        for p, rows in planes.items():
            assert b"".join(rows[y] for y in range(6)) == want[p].tobytes()


def test_psd_bands(spark):
    f = frame(spark, [("a", make_psd(9, 20, "Rgb", 3, "Rle", seed=4))])
    whole = sorted((r.plane, r.y, bytes(r.row)) for r in psd.plane_rows(f).collect())
    assert sorted((r.plane, r.y, bytes(r.row)) for r in psd.plane_rows(f, band=6).collect()) == whole


def test_psd_header_and_index(spark):
    icc = b"x" * 7
    resources = b"8BIM" + struct.pack(">H", 1) + b"\0\0" + struct.pack(">I", 2) + b"ab"
    resources += b"8BIM" + struct.pack(">H", 1039) + b"\3abc" + struct.pack(">I", 7) + icc + b"\0"
    info = struct.pack(">Ih", 4, -3) + b"\0\0" + struct.pack(">I", 0) + b"8BIMluni" + struct.pack(">I", 3) + b"abc\0"
    good = make_psd(4, 3, "Rgb", 4, "Raw", resources=resources, layers=info)
    bad = {"sig": b"XXXX" + good[4:], "v3": good[:4] + b"\0\3" + good[6:], "zero": good[:14] + b"\0\0\0\0" + good[18:], "many": good[:12] + b"\0\71" + good[14:], "short": good[:20], "empty": b""}
    files = [("good", good), *bad.items()]
    h = {r.path: r.h for r in frame(spark, files).select("path", psd.header(F.col("content")).alias("h")).collect()}
    assert (h["good"].width, h["good"].height, h["good"].channels, h["good"].mode_name, h["good"].error) == (4, 3, 4, "Rgb", None)
    assert all(h[k].error for k in bad)
    i = {r.path: r for r in psd.index(frame(spark, files)).collect()}
    g = i["good"]
    assert (g.layers, g.merged_alpha, g.compression, [b.id for b in g.resources], [b.key for b in g.blocks]) == (3, True, "Raw", [1, 1039], ["luni"])
    at = g.resources[1]
    assert good[at.offset : at.offset + at.size] == icc and g.resources[1].name == "abc"
    assert all(i[k].error for k in bad)
    found = psd.index(frame(spark, files[:1])).select(psd.resource(F.col("resources"), psd.ICC_RESOURCE).alias("r")).first()
    assert found.r.size == 7
    cut = {r.path: r.error for r in psd.plane_rows(frame(spark, [(k, make_psd(8, 8, "Rgb", 3, k)[:-40]) for k in ("Raw", "Rle")])).filter("error is not null").collect()}
    assert set(cut) == {"Raw", "Rle"}


def test_pack_bits_round_trip():
    rng = np.random.RandomState(1)
    for n in (0, 1, 2, 127, 128, 129, 300):
        row = rng.choice([1, 2], n).astype(np.uint8).tobytes() + b"\7" * (n % 5)
        assert psd.unpack_bits(pack_bits(row), len(row)) == row
    assert psd.unpack_bits(b"\x80\x00\x41", 3) == b"A\0\0"


def test_profile_names():
    def profile(body):
        return b"\0" * 128 + struct.pack(">I4sII", 1, b"desc", 144, len(body)) + body

    assert psd.profile_name(profile(b"desc\0\0\0\0" + struct.pack(">I", 5) + b"sRGB\0")) == "sRGB"
    text = ["Deutsch".encode("utf-16-be"), "English".encode("utf-16-be")]
    mluc = b"mluc\0\0\0\0" + struct.pack(">II", 2, 12) + struct.pack(">4sII", b"deDE", len(text[0]), 40) + struct.pack(">4sII", b"enUS", len(text[1]), 40 + len(text[0]))
    assert psd.profile_name(profile(mluc + text[0] + text[1])) == "English"
    assert psd.profile_name(b"short") is None


def hdr(px, coded):
    h, w, _ = px.shape
    out = b"#?RADIANCE\nFORMAT=32-bit_rle_rgbe\n\n" + f"-Y {h} +X {w}\n".encode()
    for row in px:
        if not coded:
            out += row.tobytes()
            continue
        out += b"\2\2" + struct.pack(">H", w)
        for c in range(4):
            for x in range(0, w, 100):
                part = row[x : x + 100, c].tobytes()
                out += bytes((128 + len(part), part[0])) if len(set(part)) == 1 and len(part) < 128 else bytes((len(part),)) + part
    return out


@pytest.mark.parametrize("w,coded", [(5, False), (12, False), (12, True), (250, True)])
def test_hdr(w, coded):
    px = np.random.RandomState(w).randint(0, 256, (4, w, 4)).astype(np.uint8)
    px[1] = px[1, 0]
    px[2, :, 3] = 0
    assert (pixels.read_hdr(hdr(px, coded)) == px).all()
    f = pixels.rgbe_to_float(px)
    assert (f[2, :, :3] == 0).all() and np.isclose(f[0, 0, 0], px[0, 0, 0] * 2.0 ** (int(px[0, 0, 3]) - 136))


def test_surfaces(spark):
    px = np.zeros((2, 9, 4), np.uint8)
    px[..., 0], px[..., 3] = 128, 129
    tga = struct.pack("<BBBHHBHHHHBB", 0, 0, 2, 0, 0, 0, 0, 0, 2, 1, 24, 32) + b"\1\2\3\4\5\6"
    rle = struct.pack("<BBBHHBHHHHBB", 0, 0, 11, 0, 0, 0, 0, 0, 3, 2, 8, 0) + b"\x82\7" + b"\2\1\2\3"
    files = [("h", "Hdr", hdr(px, True)), ("t", "Tga", tga), ("r", "Tga", rle), ("x", "Exr", b""), ("bad", "Hdr", b"#?")]
    out = {r.path: r for r in pixels.surfaces(spark.createDataFrame(files, "path string, format string, content binary")).collect()}
    assert out["h"].grey and bytes(out["h"].rgba)[:4] == bytes(out["h"].rgba)[:1] * 3 + b"\xff"
    assert bytes(out["t"].rgba) == b"\3\2\1\xff\6\5\4\xff" and out["t"].error is None
    assert bytes(out["r"].rgba)[:4] == b"\1\1\1\xff" and bytes(out["r"].rgba)[-4:] == b"\7\7\7\xff"
    assert "OpenEXR" in out["x"].error and out["bad"].error


def test_svg(spark):
    ns = 'xmlns="http://www.w3.org/2000/svg"'
    files = [("a", f'<svg {ns} width="20px" height="10"/>'), ("b", f'<?xml version="1.0"?><svg {ns} viewBox="0 0 30 40"/>'), ("c", f"<svg {ns}/>"), ("d", "nothing")]
    out = {r.path: (r.width, r.height) for r in pixels.svg_sizes(frame(spark, [(p, t.encode()) for p, t in files])).collect()}
    assert out == {"a": (20.0, 10.0), "b": (30.0, 40.0), "c": (None, None)}


def test_cmyk_all_pairs(spark):
    df = spark.range(65536).select((F.col("id") % 256).cast("int").alias("c"), F.floor(F.col("id") / 256).cast("int").alias("k"))
    got = df.select("c", "k", raster.cmyk_component(F.col("c"), F.col("k")).alias("v")).collect()
    c, k = (np.float32(255) - np.array([r[i] for r in got], np.float32) for i in (0, 1))
    one, full = np.float32(1), np.float32(255)
    want = np.clip((full * (one - c / full) * (one - k / full) + np.float32(0.5)).astype(np.int32), 0, 255)
    assert [r.v for r in got] == want.tolist()


def test_pixels_and_formats(spark):
    df = spark.createDataFrame([(10, 20, 30, 128), (250, 250, 255, 0)], "r int, g int, b int, a int")
    c = [F.col(x) for x in "rgba"]
    rows = df.select(color.write_pixel(*c, "bgra", "premultiplied").alias("p"), color.write_pixel(*c[:3], None).alias("o"), F.array(*raster.neutral_balance(*c[:3])).alias("n")).collect()
    assert rows[0].p == [15, 10, 5, 128] and rows[0].o == [10, 20, 30, 255] and rows[0].n == [18, 14, 30]
    assert rows[1].n == [255, 244, 255]
    with pytest.raises(ValueError):
        color.write_pixel(*c, "abgr")
    one = spark.createDataFrame([(255, 255, 255, 255), (0, 0, 0, 0), (100, 200, 30, 40)], "c int, m int, y int, k int")
    for r in one.select("*", F.array(*color.cmyk_pixel(*[F.col(x) for x in "cmyk"])).alias("rgb")).collect():
        assert all(0 <= v <= 255 for v in r.rgb)
    assert raster.gamma_table()[0] == 0 and raster.gamma_table()[255] == 255
    palette = spark.range(1).select(F.array(*color.indexed_pixel(F.sequence(F.lit(0), F.lit(767)), F.lit(7))).alias("p")).first().p
    assert palette == [7, 263, 519]


def test_float_pixels(spark):
    nan, inf = float("nan"), float("inf")
    px = [[(0.5, 0.0, 0.0, 1.0), (-1.0, 0.0, 0.0, 1.0)], [(2.0, 0.25, nan, 0.5), (inf, 0.0, 0.0, 1.0)]]
    df = spark.createDataFrame([(p,) for p in px], "p array<struct<r:float,g:float,b:float,a:float>>")
    grey, colour = (r.f for r in df.select(color.float_pixels(F.col("p")).alias("f")).collect())
    assert grey.grey and grey.rgba[0] == [186, 186, 186, 255] and grey.rgba[1] == [0, 0, 0, 255]
    assert not colour.grey and colour.rgba[0][0] == 255 and colour.rgba[0][2] == 0 and colour.rgba[1][0] == 255


@pytest.mark.parametrize("means", [{}, {40: 7}, {0: 5, 255: 200}, {3: 10, 4: 30, 90: 20, 200: 255}])
def test_lut_curve(spark, means):
    got = color.lut_curve(spark.createDataFrame(list(means.items()), "k int, v int")).first().curve
    if not means:
        assert got == list(range(256))
        return
    ks = sorted(means)
    want = np.floor(np.interp(range(256), ks, [means[k] for k in ks]) + 0.5).astype(int).tolist()
    assert got == want
    assert color.lut_samples(spark.createDataFrame([(1, 5), (1, 6), (2, 999)], "k int, v int")).orderBy("k").collect() == [(1, 5), (2, 255)]


def test_polarity(spark):
    rows = [("a", 1, 10, 10, 10, 0, 0, 0, 11, 11, 11), ("a", 2, 0, 0, 0, 0, 0, 0, 99, 9, 9), ("b", 1, 10, 10, 10, 10, 10, 10, 11, 11, 11)]
    df = spark.createDataFrame(rows, "asset string, ord int, r int, g int, b int, ar int, ag int, ab int, br int, bg int, bb int")
    assert {r.asset: r.inverted for r in color.polarity(df, "asset").collect()} == {"a": True, "b": False}


def test_tiles_and_resample(spark):
    w, h, tw, th = 11, 7, 4, 3
    px = planes_of(w, h, 2, 9)
    rows = [(1, p, "RG"[p], y, px[p, y].tobytes()) for p in range(2) for y in range(h)]
    pr = spark.createDataFrame(rows, "asset_id long, plane int, role string, y int, row binary")
    dims = spark.createDataFrame([(1, w, h, tw, th)], "asset_id long, w int, h int, tile_w int, tile_h int")
    for t in tiles.cut_tiles(pr, dims).collect():
        assert bytes(t.data) == px[t.plane, t.ty * th : (t.ty + 1) * th, t.tx * tw : (t.tx + 1) * tw].tobytes()
    grid = tiles.tile_grid(dims)
    assert grid.count() == 9 and grid.agg(F.sum(F.col("w") * F.col("h"))).first()[0] == w * h
    small = dims.select("asset_id", "w", "h", F.lit(4).alias("to_w"), F.lit(3).alias("to_h"))
    out = tiles.assemble(tiles.resample(pr, small), "plane").collect()
    xs, ys = np.arange(4) * w // 4, np.arange(3) * h // 3
    for r in out:
        assert bytes(r.data) == px[r.plane][np.ix_(ys, xs)].tobytes()
    done = tiles.completion(grid.withColumn("data", F.when(F.col("tx") == 0, F.lit(b"x"))), spark.createDataFrame([(1, 9)], "asset_id long, total long")).first()
    assert (done.ready, done.complete) == (3, False)
    bands = spark.range(1).select(tiles.normalise_bands(F.array(*map(F.lit, (2, 9, 0, 2, -1))), F.lit(3)).alias("b"), tiles.tile_at(F.lit(99.0), F.lit(4), F.lit(3)).alias("t")).first()
    assert bands.b == [2, 0] and bands.t == 2


def test_viewport_arithmetic(spark):
    one = spark.range(1)
    z = lambda c: one.select(c.alias("v")).first().v
    assert z(raster.fit_zoom(F.lit(800.0), F.lit(600.0), F.lit(1600.0), F.lit(600.0), F.lit(2.0))) == 25
    assert z(raster.initial_mode(F.lit(800), F.lit(600), F.lit(400), F.lit(300), F.lit(2.0))) == "OriginalImageSize"
    assert z(raster.initial_mode(F.lit(800), F.lit(600), F.lit(401), F.lit(300), F.lit(2.0))) == "FitToScreen"
    assert z(raster.tile_edge(F.lit(256 << 20))) == 8192 and z(raster.tile_edge(F.lit(1000))) == 256 and z(raster.tile_edge(F.lit(1), F.lit(1000))) == 960
    assert z(raster.visible_rect(F.lit(10.0), F.lit(10.0), F.lit(100), F.lit(100), F.lit(1.0), F.lit(100.0), F.lit(500), F.lit(0))) is None
    assert z(raster.needs_tiles(F.lit(50.0), F.lit(2.0), F.lit(0.9))) and not z(raster.needs_tiles(F.lit(50.0), F.lit(1.0), F.lit(0.5)))
    assert z(raster.pan_clamp(F.lit(90.0), F.lit(100.0), F.lit(40.0))) == 30.0 and z(raster.pan_clamp(F.lit(90.0), F.lit(30.0), F.lit(40.0))) == 0.0
    r = lambda *v: F.struct(*[F.lit(x).alias(n) for x, n in zip(v, ("left", "top", "right", "bottom"))])
    assert tuple(z(raster.intersect(r(0, 0, 5, 5), r(3, 1, 9, 4)))) == (3, 1, 5, 4) and z(raster.intersect(r(0, 0, 1, 1), r(2, 2, 3, 3))) is None


def test_baseline_images(spark, tmp_path):
    """PNG by Spark's image source, in BGR order."""
    import zlib

    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    px = np.arange(2 * 3 * 3, dtype=np.uint8).reshape(2, 3, 3)
    raw = b"".join(b"\0" + r.tobytes() for r in px)
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 3, 2, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
    (tmp_path / "a.png").write_bytes(png)
    (tmp_path / "b.png").write_bytes(b"no picture")
    (r,) = pixels.raster_images(spark, str(tmp_path)).collect()
    assert (r.width, r.height, r.channels) == (3, 2, 3) and bytes(r.data) == px[..., ::-1].tobytes()


def test_planes_and_profiles(spark, tmp_path):
    from tilewright.sources import catalog

    rows = spark.createDataFrame([(1, 0, "R", 0, b"a"), (1, 1, "G", 0, b"b")], "asset_id long, plane int, role string, y int, row binary")
    assert tiles.plane(rows, "G").first()["row"] == b"b"
    with pytest.raises(Exception, match="no plane K"):
        tiles.plane(rows, "K").collect()
    docs = spark.createDataFrame([("a", "Rgb", b"x"), ("b", "Cmyk", None), ("c", "Rgb", b"")], "path string, mode string, icc binary")
    src = lambda d: [r[0] for r in docs.orderBy("path").select(color.calibration_source(F.col("icc"), F.col("mode"), d)).collect()]
    assert src(None) == ["embedded", "identity", "identity"] and src("/p.icc") == ["embedded", "default", "identity"]
    assert [r.profile is None for r in color.profile_keys(docs).orderBy("path").collect()] == [False, True, True]
    (tmp_path / "p.icc").write_bytes(b"x")
    assert catalog.first_existing(["/no", str(tmp_path / "p.icc")]) == str(tmp_path / "p.icc") and catalog.first_existing([]) is None


def test_bands_decode_in_many_tasks(spark):
    from pyspark.sql import functions as F

    from tilewright.plans.samples import make_psd
    from tilewright.sources import psd

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        files = spark.createDataFrame([("/a.psd", make_psd(6, 64, "Rgb", 3, "Rle"))], "path string, content binary")
        rows = psd.plane_rows(files, band=4)
        assert rows.count() == 3 * 64 and rows.filter("error is not null").isEmpty()
        assert rows.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
