"""Jobs, statistics, metadata text and streaming ingest."""

import json

from pyspark.sql import functions as F

from tilewright.functions import formats, text
from tilewright.operators import jobs, metadata, timing
from tilewright.streaming import drops


def test_formats(spark):
    f = formats.formats(spark)
    assert f.count() == 19 and f.filter("disabled").count() == 4
    e = formats.extensions(spark)
    assert e.count() == 24 and e.filter("disabled").count() == 5
    assert spark.range(1).select(formats.display_name(F.lit("MultiDirectorySelection"))).first()[0] == "Multi Directory Selection"


def test_job_states(spark):
    log = {
        "a": ["begin", "ready", "complete"], "b": ["begin", "failed", "complete"], "c": ["begin", "cancelled", "disposed", "begin"], "d": ["ready", "begin", "ready"], "e": ["begin"],
    }
    rows = [(p, i, e) for p, es in log.items() for i, e in enumerate(es)]
    s = jobs.job_states(spark.createDataFrame(rows, "path string, seq int, event string"))
    assert {r.path: r.state for r in s.collect()} == {"a": "Complete", "b": "Failed", "c": "Disposed", "d": "Ready", "e": "Loading"}
    assert {r.state: r.n for r in jobs.terminal_counts(s).collect()} == {"Complete": 1, "Failed": 1, "Disposed": 1, "Unfinished": 2}
    kinds = spark.createDataFrame([("Ready", "Raster"), ("Ready", "RasterLarge"), ("Loading", "Raster")], "s string, k string")
    assert [r[0] for r in kinds.select(jobs.is_promoted(F.col("s"), F.col("k"))).collect()] == [True, False, False]
    asked = spark.createDataFrame([("x", 1, True), ("x", 2, False), ("x", 3, False)], "path string, seq int, start_failed boolean")
    assert jobs.first_requests(asked).first().seq == 2


def test_buckets_and_estimates(spark):
    sizes = {0: 1, 1: 1, -5: 1, 256_000: 1, 256_001: 2, 512_000: 2, 512_001: 4, 10**9: 4096}
    df = spark.createDataFrame([(s,) for s in sizes], "s long").select("s", timing.size_bucket(F.col("s")).alias("b"))
    assert {r.s: r.b for r in df.collect()} == sizes
    rows = [(i, "Png", 1 if i < 30 else 4, float(i)) for i in range(31)]
    samples = spark.createDataFrame(rows, "seq long, format string, bucket int, ms double")
    means = timing.bucket_means(samples)
    assert {r.bucket: r["mean"] for r in means.collect()} == {1: 19.5, 4: 30.0}
    wanted = spark.createDataFrame([("Png", 1), ("Png", 2), ("Png", 64), ("Gif", 1)], "format string, bucket int")
    got = {(r.format, r.bucket): r.estimate for r in timing.estimate(wanted, means).collect()}
    assert got == {("Png", 1): 19.5, ("Png", 2): 19.5, ("Png", 64): 30.0, ("Gif", 1): None}
    tie = spark.createDataFrame([("A", 1, 5.0), ("A", 5, 9.0)], "format string, bucket int, mean double")
    assert timing.estimate(spark.createDataFrame([("A", 3)], "format string, bucket int"), tie).first().nearest == 1


def test_stats_files(spark, tmp_path):
    rows = [(i, "Png", 2, i / 2) for i in range(25)]
    timing.write_stats(spark.createDataFrame(rows, "seq long, format string, bucket int, ms double"), str(tmp_path / "s"))
    back = timing.read_stats(spark, str(tmp_path / "s")).orderBy("seq").collect()
    assert [(r.format, r.bucket, r.ms) for r in back] == [("PNG", 2, i / 2) for i in range(5, 25)]
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "x.txt").write_text("JPEG_4: [1.5, oops, 2]\nbad line\nPNG: [3]\nTGA_x: [1]\n")
    assert [(r.format, r.ms) for r in timing.read_stats(spark, str(tmp_path / "t")).orderBy("seq").collect()] == [("JPEG", 1.5), ("JPEG", 2.0)]


def test_exif(spark):
    d = {
        "ifd0": {"Make": "M", "Software": " "}, "sub_ifd": {"ColorSpace": "sRGB", "Compression": ""}, "icc": {"ColorSpace": "RGB", "Description": "P3"},
        "png": {"IccProfile": "other", "BitsPerSample": "8", "Compression": "Deflate"},
    }
    df = spark.createDataFrame([(d,), ({},)], "d map<string,map<string,string>>").select(metadata.exif_record(F.col("d")).alias("e"))
    rows = df.select("e", text.exif_has_data(F.col("e")).alias("has"), text.exif_lines(F.col("e")).alias("l"), text.exif_report(F.col("e"), F.lit(True)).alias("r")).collect()
    e = rows[0].e
    assert (e.make, e.icc_profile, e.color_space, e.color_depth, e.compression) == ("M", "P3", "sRGB", "8", "Deflate")
    assert rows[0].l == ["Make: M", "", "ICC Profile: P3", "Color Space: sRGB", "Bits Per Sample: 8", "", "Compression: Deflate"]
    assert not rows[1].has and rows[1].l == [] and rows[1].r == ["<f>No recognized EXIF metadata</>"]
    failed = df.select(text.exif_report(F.col("e"), F.lit(False)).alias("r")).first().r
    assert failed == ["<f>Failed to parse EXIF metadata.</>"]


def test_display_text(spark):
    one = spark.range(1)
    z = lambda c: one.select(c.alias("v")).first().v
    sizes = {0: "0 bytes", 1023: "1023 bytes", 1024: "1 kB", 1536: "2 kB", 2560: "2 kB", 2 * 1024 * 1024: "2 MB", 2621440: "2.5 MB"}
    assert all(z(text.size_text(F.lit(k).cast("long"))) == v for k, v in sizes.items())
    assert z(text.ms_text(F.lit(None).cast("double"))) == "n/a" and z(text.ms_text(F.lit(9.5))) == "9.50" and z(text.ms_text(F.lit(12.4))) == "12"
    parts = z(text.tagged_parts(F.lit("a <e>(1/2)</> b <x>")))
    assert [(p.tag, p.text) for p in parts] == [("", "a "), ("e", "(1/2)"), ("", " b <x>")]
    args = ("Kind", "/d", 2, 9, 1, 3, "f.png", 1500, "PNG Image", 40, 30, True, 100, "FitToScreen", "Linear")
    lines = z(text.overlay_lines(*map(F.lit, args)))
    assert lines[1] == "[File]          2/9 <e>(1/3)</>  |  f.png  |  1 kB" and lines[2].endswith("40x30  |  Greyscale")


def test_drop_stream(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    first = [(1, "begin", None), (2, "path", "/a"), (3, "file", "/a/x.png"), (4, "file", "/a/n.txt"), (5, "file", "/a/x.png"), (6, "file", "/a/b.jpg"), (7, "complete", None)]
    second = [(8, "begin", None), (9, "file", "/z/c.psd"), (10, "cancel", None), (11, "file", "/z/d.psd")]
    import os

    for i, rows in enumerate((first, second)):
        p = log / f"{i}.json"
        p.write_text("\n".join(json.dumps({"seq": s, "event": e, "path": q}) for s, e, q in rows))
        os.utime(p, (1_000_000 + i, 1_000_000 + i))
    seen = []
    q = drops.publish(drops.read_log(spark, str(log)), str(tmp_path / "out"), str(tmp_path / "cp"), lambda n, c: seen.append(tuple(c.first())))
    q.awaitTermination()
    assert seen == [(1, 4, 3, False, False), (0, 2, 2, True, True)]
    assert [r.path for r in spark.read.parquet(str(tmp_path / "out")).orderBy("idx").collect()] == ["/z/c.psd"]  # each batch replaces


def test_record_stats(spark, tmp_path):
    import os

    folder, schema, seen = tmp_path / "in", "seq long, format string, bucket int, ms double", []
    folder.mkdir()
    sizes = [3, 1, 4, 34, 2]
    for i, n in enumerate(sizes):
        p = folder / f"{i}.json"
        p.write_text("\n".join(json.dumps({"seq": 100 * i + j, "format": "Png", "bucket": 1 + j % 2, "ms": 100.0 * i + j}) for j in range(n)))
        os.utime(p, (1_000_000 + i, 1_000_000 + i))
    kept = timing.write_stats
    try:
        timing.write_stats = lambda rows, path: (seen.append(rows.count()), kept(rows, path))
        for _ in range(2):  # the second run finds nothing new
            stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))
            timing.record_stats(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    finally:
        timing.write_stats = kept
    # written once five are new (3 + 1 + 4, then 34), and on exit (2); 20 of each bucket
    assert seen == [8, 40, 40]
    back = timing.read_stats(spark, str(tmp_path / "out"))
    every = [(100.0 * i + j, 1 + j % 2) for i, n in enumerate(sizes) for j in range(n)]
    for bucket in (1, 2):
        got = [r.ms for r in back.filter(f"bucket = {bucket}").orderBy("seq").collect()]
        assert got == [ms for ms, b in every if b == bucket][-20:]


def test_lifecycle(spark):
    events = [(1, "file", True), (2, "begin", None), (3, "path", None), (4, "file", True), (5, "file", False), (6, "complete", None), (7, "reset", None), (8, None, None), (9, "begin", None), (10, "cancel", None)]
    log = spark.createDataFrame(events, "seq long, event string, supported boolean")
    got = [tuple(r)[2:] for r in drops.lifecycle(log).orderBy("seq").collect()]
    off = (False, False)
    assert got == [
        (0, 1, 1, *off), (0, 0, 0, True, False), (1, 0, 0, True, False), (1, 1, 1, True, False), (1, 2, 1, True, False),
        (1, 2, 1, *off), (0, 0, 0, *off), (0, 0, 0, *off), (0, 0, 0, True, False), (0, 0, 0, False, True),
    ]
    assert drops.lifecycle(log.limit(0)).count() == 0
