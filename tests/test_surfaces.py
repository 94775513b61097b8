"""Surfaces, previews and tiles of made documents against whole-array numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.operators import color, surfaces
from tilewright.plans.samples import make_psd, planes_of
from tilewright.sources import psd

W, H = 19, 11


def whole(mode, channels, seed):
    p = planes_of(W, H, channels, seed)
    palette = bytes(range(256)) * 3
    planes = dict(zip(psd.roles_of(mode, channels), [x.ravel() for x in p]))
    return surfaces.convert(planes, mode, palette, None, "rgba", "straight").reshape(H, W, 4)


@pytest.fixture(scope="module")
def files(spark):
    rows = [(f"{m}{c}{k}", make_psd(W, H, m, c, k, seed=c)) for m, c in (("Rgb", 3), ("Rgb", 4), ("Cmyk", 4), ("Cmyk", 5), ("Indexed", 1)) for k in ("Rle", "Zip")]
    rows += [("Grayscale1Raw", make_psd(W, H, "Grayscale", 1, "Raw")), ("bad", b"8BPS")]
    return spark.createDataFrame(rows, "path string, content binary")


def parts(path):
    mode = path.rstrip("RleZipaw0123456789")
    mode = next(m for m in ("Rgb", "Cmyk", "Indexed") if path.startswith(m))
    return mode, int(path[len(mode)])


def test_full(files):
    docs = psd.index(files).filter("error is null")
    rows = surfaces.rgba_rows(psd.plane_rows(files), docs)
    assert {r.error for r in rows.filter("path = 'Grayscale1Raw'").collect()} == {"colour mode Grayscale"}
    out = {r.path: bytes(r.data) for r in surfaces.full_surface(rows).collect()}
    assert len(out) == 10
    for path, data in out.items():
        mode, channels = parts(path)
        assert data == whole(mode, channels, channels).tobytes(), path


def test_preview_and_tiles(files):
    some = files.filter("path in ('Rgb4Rle', 'Cmyk4Zip')")
    for r in surfaces.preview(some, 8, 100).collect():
        mode, channels = parts(r.path)
        w, h = 8, int(H * 8 / W)
        assert (r.w, r.h) == (w, h)
        px = whole(mode, channels, channels)
        assert bytes(r.data) == px[np.ix_(np.arange(h) * H // h, np.arange(w) * W // w)].tobytes()
    with pytest.raises(ValueError):
        surfaces.preview(some, 0, 5)
    for band in (None, 4):
        got = surfaces.tiled(some, 8, band=band).collect()
        assert len(got) == 2 * 3 * 2
        for t in got:
            mode, channels = parts(t.path)
            assert bytes(t.data) == whole(mode, channels, channels)[t.ty * 8 : t.ty * 8 + 8, t.tx * 8 : t.tx * 8 + 8].tobytes()


def test_columns_agree(spark):
    rng = np.random.RandomState(0)
    v = rng.randint(0, 256, (300, 5))
    v[:60, :3] = v[:60, :1]
    df = spark.createDataFrame([tuple(map(int, x)) for x in v], "c int, m int, y int, k int, a int")
    rgb = color.cmyk_pixel(*[F.col(x) for x in "cmyk"])
    got = [r.p for r in df.select(color.write_pixel(*rgb, F.col("a"), "bgra", "premultiplied").alias("p")).collect()]
    planes = dict(zip("CMYKA", v.T.astype(np.uint8)))
    want = surfaces.convert(planes, "Cmyk", None, None, "bgra", "premultiplied")
    assert got == want.tolist()


def test_row_table(spark, files):
    i = psd.index(files).filter("error is null")
    sizes = []
    for r in files.filter("path like '%Rle'").collect():
        doc = psd.read_index(bytes(r.content))
        sizes += [(r.path, int(n)) for n in psd.scanline_ranges(doc, bytes(r.content))[:, 1]]
    out = surfaces.row_table_fits(i, spark.createDataFrame(sizes, "path string, packed long")).collect()
    assert len(out) == 5 and all(r.fits for r in out)


def test_staged(spark, files):
    more = files.unionByName(spark.createDataFrame([("big", make_psd(40, 30, "Rgb", 3, "Rle"))], "path string, content binary"))
    full, previews, tiles = surfaces.staged(more, 10, 10, 16, large_bytes=40 * 30 * 4, band=8)
    assert {r.path for r in full.collect()} == {r.path for r in files.collect()} - {"Grayscale1Raw", "bad"}
    assert [(r.path, r.w, r.h, len(r.data)) for r in previews.collect()] == [("big", 10, 7, 10 * 7 * 4)]
    assert sorted((r.path, r.tx, r.ty) for r in tiles.collect()) == [("big", x, y) for x in range(3) for y in range(2)]
