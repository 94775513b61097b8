"""Named queries over the driver's tables and the SQL each must agree with.

The tables stand in for assets: ``pages`` for file paths, ``events`` for load
samples and logs, ``embeddings`` for scanlines, ``lineitem`` for pixels and
calibration samples.  ``r_`` queries are the engine's own operators, ``s_``
queries plain Spark SQL over the relational tables.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.functions import binary, formats, paths, raster, text
from tilewright.operators import collection, color, jobs, tiles, timing
from tilewright.streaming import drops

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    path = F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "/$", "")
    return spark.read.parquet(f"{sf}/pages.parquet").select("page_id", path.alias("path"))


def _ordered(spark: SparkSession, sf: str) -> DataFrame:
    p = _pages(spark, sf).withColumn("dir", paths.directory(F.col("path"))).withColumn("name", paths.name(F.col("path")))
    return collection.number_rows(p, "dir", "name", "page_id")


def _events(spark: SparkSession, sf: str) -> DataFrame:
    size = F.round(F.col("value") * 100000).cast("long")
    e = spark.read.parquet(f"{sf}/events.parquet")
    return e.select("event_id", "ts", "user_id", F.col("event_type").alias("format"), size.alias("size"), "value").withColumn("bucket", timing.size_bucket(F.col("size")))


def _pixels(spark: SparkSession, sf: str) -> DataFrame:
    """Four bytes a line item."""
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    byte = lambda c: F.pmod(F.floor(c).cast("long"), F.lit(256)).cast("int")
    return li.select(
        byte(F.col("l_extendedprice")).alias("a"), byte(F.col("l_quantity") * 5).alias("b"), byte(F.col("l_partkey")).alias("c"), byte(F.col("l_suppkey")).alias("d")
    ).distinct()


_PATHS = "p as (select page_id, regexp_replace(regexp_replace(url,'[?#].*$',''),'/$','') path from pages)"
_ORDER = (
    _PATHS
    + """, q as (select *, regexp_replace(path,'/[^/]*$','') dir, regexp_extract(path,'[^/]*$',0) name from p),
 o as (select *, row_number() over (order by dir,name,page_id) idx, lag(dir) over (order by dir,name,page_id) pd,
   count(*) over () n from q),
 i as (select *, sum(case when pd=dir then 0 else 1 end) over (order by idx rows unbounded preceding)::bigint run from o),
 r as (select *, row_number() over (partition by run order by idx) dir_index, count(*) over (partition by run) dir_count,
   min(idx) over (partition by run) rf, max(idx) over (partition by run) rl from i)"""
)
_EVENTS = """e as (select event_id, ts, user_id, event_type fmt, cast(round(value*100000) as bigint) size, value from events),
 k as (select *, case when size<=0 then 1 else greatest(1, cast(least(pow(2, ceil(log2(size/256000.0))),2147483647) as int)) end::int bucket from e)"""
_PIXELS = """px as (select distinct (floor(l_extendedprice)::bigint%256)::int a, (floor(l_quantity*5)::bigint%256)::int b,
  (l_partkey%256)::int c, (l_suppkey%256)::int d from lineitem)"""


@query(f"with {_ORDER} select page_id, idx, run, dir_index, dir_count from r")
def r_collection_navigation(spark, sf):
    """Position in the ordered collection, directory run, position and size in the run."""
    return collection.directory_runs(_ordered(spark, sf)).select("page_id", "idx", "run", "dir_index", "dir_count")


@query(
    f"""with {_ORDER} select page_id, idx, least(idx+1,n) "next", greatest(idx-1,1) previous, 1::bigint "first", n "last",
  case when idx=rf then greatest(idx-1,1) else rf end dir_first, case when idx=rl then least(idx+1,n) else rl end dir_last,
  idx<n has_next, idx>1 has_previous from r"""
)
def r_navigation_moves(spark, sf):
    """Targets of next, previous, first, last and the directory edges."""
    m = collection.moves(collection.directory_runs(_ordered(spark, sf)))
    return m.select("page_id", "idx", "next", "previous", "first", "last", "dir_first", "dir_last", "has_next", "has_previous")


@query(
    f"""with {_ORDER} select idx, string_agg(name, '|') over (order by idx rows between 3 preceding and 3 following) neighbours from r"""
)
def r_neighbourhood(spark, sf):
    """Names within three positions."""
    n = collection.neighbourhood(_ordered(spark, sf), 3, value="name")
    return n.select("idx", F.array_join("neighbours", "|").alias("neighbours"))


@query(
    f"""with {_PATHS}, v as (select min(path) a, max(path) b from p),
 c as (select a, b, (select coalesce(max(i),0) from (select unnest(range(1, least(length(a),length(b))+1)) i) where left(a,i)=left(b,i)) n from v)
select case when a=b then a when n=0 or strpos(left(a,n),'/')=0 then null else regexp_replace(left(a,n),'/[^/]*$','') end top_directory from c"""
)
def r_top_directory(spark, sf):
    """Longest common directory of all paths."""
    return collection.top_directory(_pages(spark, sf))


@query(f"with {_PATHS} select distinct regexp_replace(path,'/[^/]*$','') dir from p")
def r_directories(spark, sf):
    """Distinct directories."""
    return collection.directories(_pages(spark, sf))


@query(
    f"""with {_PATHS} select page_id, regexp_replace(path,'/[^/]*$','') dir, regexp_extract(path,'([^/]*)$',1) name,
  case when regexp_extract(path,'(\\.[^./]*)$',1)='.' then '' else regexp_extract(path,'(\\.[^./]*)$',1) end extension,
  starts_with(regexp_extract(path,'([^/]*)$',1),'.') hidden from p"""
)
def r_path_parts(spark, sf):
    """Directory, name, extension and the hidden test."""
    p = _pages(spark, sf)
    c = F.col("path")
    return p.select("page_id", paths.directory(c).alias("dir"), paths.name(c).alias("name"), paths.extension(c).alias("extension"), paths.is_hidden(c).alias("hidden"))


@query("select url path, min(page_id)::bigint ord from (select page_id, regexp_replace(regexp_replace(url,'[?#].*$',''),'/$','') url from pages) group by 1")
def r_distinct_paths(spark, sf):
    """First occurrence of each path."""
    return collection.distinct_paths(_pages(spark, sf).withColumnRenamed("page_id", "ord"), ordinal="ord").select("path", "ord")


_FORMATS = "f(ord,format,ext,disabled,decoder) as (values " + ", ".join(
    f"({i},'{n}','{x}',{str(off).lower()},{repr(dec) if dec else 'null'})" for i, (n, e, _, off, dec) in enumerate(formats.FORMATS) for x in e
) + ")"
_EXTS = ("png", ".JPG ", "psb", "ktx2", "", "heic", "doc", "hdr", " .Dds", "svg", "tif")
_EXT_SQL = "(array[" + ",".join(f"'{x}'" for x in _EXTS) + f"])[(page_id%{len(_EXTS)}+1)::int]"


@query(
    f"""with {_FORMATS}, p as (select page_id, lower(trim({_EXT_SQL})) t from pages),
 n as (select page_id, case when t='' then '' when starts_with(t,'.') then t else '.'||t end extension from p)
select page_id, extension, coalesce(format,'Unknown') format, format is not null and not disabled supported, coalesce(decoder,'Skia') decoder
from n left join f on f.ext=n.extension"""
)
def r_format_lookup(spark, sf):
    """Extension to format and decoder, with the fallbacks."""
    p = spark.read.parquet(f"{sf}/pages.parquet").select("page_id")
    e = p.withColumn("e", F.get(F.array(*map(F.lit, _EXTS)), (F.col("page_id") % len(_EXTS)).cast("int")))
    return formats.with_decoder(formats.with_format(e, F.col("e"))).select("page_id", "extension", "format", "supported", "decoder")


@query(f"with {_EVENTS} select event_id, fmt format, bucket, round(avg(value) over (partition by fmt,bucket order by event_id rows between 20 preceding and 1 preceding), 6) estimate from k")
def r_load_estimate(spark, sf):
    """Moving average of the up to 20 samples before."""
    e = _events(spark, sf)
    return timing.running_estimates(e, order="event_id", ms="value").select("event_id", "format", "bucket", F.round("estimate", 6).alias("estimate"))


@query(
    f"""with {_EVENTS}, n as (select *, row_number() over (partition by fmt,bucket order by event_id desc) rn from k)
select fmt format, bucket, round(avg(value),6) mean from n where rn<=20 group by 1,2"""
)
def r_bucket_means(spark, sf):
    """Mean of the last 20 samples of each format and bucket."""
    m = timing.bucket_means(_events(spark, sf), order="event_id", ms="value")
    return m.select("format", "bucket", F.round("mean", 6).alias("mean"))


@query(
    """with have as (select distinct event_type fmt, cast(floor(value/50) as int) b from events where value<200),
 want as (select distinct event_type fmt, cast(floor(value/50) as int) wb from events),
 j as (select w.fmt,w.wb,h.b, row_number() over (partition by w.fmt,w.wb order by abs(h.b-w.wb), h.b) rn from want w join have h on w.fmt=h.fmt)
select fmt format, wb bucket, b nearest from j where rn=1"""
)
def r_nearest_bucket(spark, sf):
    """Nearest bucket with samples, the lower one at equal distance."""
    e = spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_type").alias("format"), F.floor(F.col("value") / 50).cast("int").alias("bucket"), "value")
    means = e.filter("value < 200").groupBy("format", "bucket").agg(F.avg("value").alias("mean"))
    return timing.estimate(e.select("format", "bucket").distinct(), means).select("format", "bucket", "nearest")


@query(f"with {_EVENTS} select event_id, upper(fmt)||'_'||bucket \"key\", upper(fmt) format, bucket from k")
def r_stats_keys(spark, sf):
    """Statistics keys built and parsed again."""
    k = _events(spark, sf).select("event_id", timing.stats_key(F.col("format"), F.col("bucket")).alias("key"))
    return k.withColumn("p", timing.parse_key(F.col("key"))).select("event_id", "key", "p.format", "p.bucket")


@query(f"with {_ORDER} select page_id from r where idx not between 96 and 104")
def r_evict(spark, sf):
    """What goes from the cache when position 100 is shown and four around it stay."""
    o = _ordered(spark, sf).withColumn("path", F.col("page_id").cast("string"))
    keep = collection.keep_set(collection.neighbourhood(o, 4), 100)
    return collection.evict(o, keep).select("page_id")


@query(f"with {_ORDER} select page_id from r where idx between 97 and 103 and page_id%2=1")
def r_preload(spark, sf):
    """What is still to be loaded of three positions around 100 if even ids are cached."""
    o = _ordered(spark, sf).withColumn("path", F.col("page_id").cast("string"))
    wanted = collection.keep_set(collection.neighbourhood(o, 3), 100)
    return collection.to_preload(wanted, o.filter("page_id % 2 = 0")).select(F.col("path").cast("long").alias("page_id"))


@query("select vec_id, unnest(range(len(embedding)))::int i, cast(floor(greatest(least(pow(greatest(unnest(embedding)::double,0),1/2.2)*255,255),0)) as int) b from embeddings")
def r_tone_map(spark, sf):
    """Float samples to bytes."""
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    return e.select("vec_id", F.posexplode("embedding").alias("i", "v")).select("vec_id", "i", raster.tone_map(F.col("v")).alias("b"))


@query(
    """with x as (select vec_id, unnest(range(len(embedding)))::int i, unnest(embedding) v from embeddings),
 y as (select vec_id,i,((cast(floor(v*255) as int)%256)+256)%256 d from x)
select vec_id,i,cast(sum(d) over (partition by vec_id order by i)%256 as int) b from y"""
)
def r_predictor_undo(spark, sf):
    """Running sums modulo 256 of each row, by the decoder's own function.

    Products are in single precision, as the samples are.  A missing sample adds
    nothing, and before the first one there is no sum; rows may differ in width.
    """
    from tilewright.sources import psd

    def run(batches):
        for b in batches:
            d = b.column(1)
            width = pc.fill_null(pc.list_value_length(d), 0).to_numpy()
            ends, flat = np.cumsum(width), d.flatten()
            has, flat = flat.is_valid().to_numpy(zero_copy_only=False), pc.fill_null(flat, 0).to_numpy()
            out, begun = np.zeros(len(flat), np.int32), np.zeros(len(flat), bool)
            for w in np.unique(width[width > 0]):
                at = (ends[width == w] - w)[:, None] + np.arange(w)
                out[at], begun[at] = psd.undo_predictor(flat[at]), np.logical_or.accumulate(has[at], axis=1)
            cut = pa.array(np.concatenate(([0], ends)), pa.int32())
            yield pa.record_batch([b.column(0), pa.ListArray.from_arrays(cut, pa.array(out, mask=~begun))], names=["vec_id", "b"])

    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    d = F.transform("embedding", lambda v: F.pmod(F.floor(v * F.lit(255).cast("float")).cast("int"), F.lit(256)))
    undone = e.select(F.col("vec_id").cast("long"), d.alias("d")).mapInArrow(run, "vec_id long, b array<int>")
    return undone.select("vec_id", F.posexplode("b").alias("i", "b"))


@query("select vec_id, x::int x, embedding[(x*64//16)+1] v from embeddings, (select unnest(range(16)) x)")
def r_nearest_resample(spark, sf):
    """64 samples to 16 by nearest position."""
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    return e.select("vec_id", F.posexplode(tiles.sample_array(F.col("embedding"), 64, 16)).alias("x", "v"))


@query(
    """with s as (select cast(floor(l_quantity*5) as int) k, cast(floor(l_extendedprice/500) as int) v from lineitem where cast(floor(l_quantity*5) as int) % 15=0),
 m as (select k, least(255,greatest(0,sum(v)//count(*)))::int v from s group by k), sp as (select unnest(range(256))::int k),
 w as (select sp.k, (select max(k) from m where m.k<=sp.k) lk, (select min(k) from m where m.k>=sp.k) nk from sp),
 x as (select w.k, lk, nk, a.v lv, b.v nv from w left join m a on a.k=lk left join m b on b.k=nk)
select k, case when lk is null and nk is null then k when lk is null then nv when nk is null or nk=lk then lv
  else cast(floor(lv+(nv-lv)*(cast(k-lk as double)/(nk-lk))+0.5) as int) end v from x"""
)
def r_lut_curve(spark, sf):
    """A calibration curve from sparse means."""
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    s = li.select(F.floor(F.col("l_quantity") * 5).cast("int").alias("k"), F.floor(F.col("l_extendedprice") / 500).cast("int").alias("v")).filter("k % 15 = 0")
    return color.lut_curve(color.lut_samples(s)).select(F.posexplode("curve").alias("k", "v"))


@query(
    """with t as (select p_partkey id, (p_size*37+5)::int w, (p_size*23+3)::int h from part), g as (select *, unnest(range((h+63)//64))::int ty from t),
 x as (select *, unnest(range((w+63)//64))::int tx from g)
select id asset_id, tx, ty, tx*64 x0, ty*64 y0, least(64,w-tx*64) w, least(64,h-ty*64) h from x"""
)
def r_tile_grid(spark, sf):
    """Tiles of one raster a part."""
    return tiles.tile_grid(_rasters(spark, sf)).withColumnRenamed("asset_id", "asset_id")


def _rasters(spark, sf, *more):
    p = spark.read.parquet(f"{sf}/part.parquet")
    return p.select(
        F.col("p_partkey").alias("asset_id"), (F.col("p_size") * 37 + 5).alias("w"), (F.col("p_size") * 23 + 3).alias("h"), F.lit(64).alias("tile_w"), F.lit(64).alias("tile_h"), *more
    )


@query(
    """with t as (select p_partkey id, (p_size*37+5)::int w, (p_size*23+3)::int h from part), g as (select *, unnest(range((h+63)//64))::int ty from t),
 x as (select *, unnest(range((w+63)//64))::int tx from g)
select id asset_id, tx, ty from x where tx*64<300.5 and tx*64+least(64,w-tx*64)>100.0 and ty*64<200.0 and ty*64+least(64,h-ty*64)>64.0"""
)
def r_viewport(spark, sf):
    """Tiles that overlap a rectangle."""
    rect = F.struct(F.lit(100.0).alias("left"), F.lit(64.0).alias("top"), F.lit(300.5).alias("right"), F.lit(200.0).alias("bottom"))
    return tiles.tiles_in(tiles.tile_grid(_rasters(spark, sf)), rect, F.lit(64), F.lit(64)).select("asset_id", "tx", "ty")


@query(
    """with t as (select p_partkey id, (p_size*37+5)::int w, (p_size*23+3)::int h, (50+p_size*7)::double z,
   case when p_partkey%3<>0 then greatest(1,floor(w*least(1.0::double,200.0/w,100.0/h)))::int end pw,
   greatest(1,floor(h*least(1.0::double,200.0/w,100.0/h)))::int ph from part),
 v as (select *, (800/2.0-w*z/100)/2+10/2.0 x0, (600/2.0-h*z/100)/2-4/2.0 y0 from t
   where pw is null or z/100*2.0 > least(pw/w, ph/h)*1.05::double),
 r as (select *, greatest(0,-x0/(z/100)) l, least(w,(800/2.0-x0)/(z/100)) r, greatest(0,-y0/(z/100)) o, least(h,(600/2.0-y0)/(z/100)) u from v),
 g as (select *, unnest(range((h+63)//64))::int ty from r where l<r and o<u), x as (select *, unnest(range((w+63)//64))::int tx from g)
select id view_id, id asset_id, tx, ty from x where tx*64<r and tx*64+least(64,w-tx*64)>l and ty*64<u and ty*64+least(64,h-ty*64)>o"""
)
def r_view_tiles(spark, sf):
    """Tiles that views draw: visible, and only where the preview is not sharp enough."""
    v = _rasters(spark, sf, (50 + F.col("p_size") * 7).cast("double").alias("zoom")).withColumn("s", raster.preview_size(F.col("w"), F.col("h"), F.lit(200.0), F.lit(100.0)))
    fixed = {"window_w": 800, "window_h": 600, "scale": 2.0, "off_x": 10, "off_y": -4}
    views = v.select(
        F.col("asset_id").alias("view_id"), "asset_id", F.col("w").alias("image_w"), F.col("h").alias("image_h"), "zoom", "tile_w", "tile_h",
        F.when(F.col("asset_id") % 3 != 0, F.col("s.w")).alias("preview_w"), F.col("s.h").alias("preview_h"), *[F.lit(x).alias(c) for c, x in fixed.items()],
    )
    return tiles.view_tiles(views, tiles.tile_grid(_rasters(spark, sf))).select("view_id", "asset_id", "tx", "ty")


@query(
    """select event_id, n unsaved, n = 5 or last is null saves from (
 select event_id, (row_number() over (partition by user_id order by event_id) - 1) % 5 + 1 n, lead(event_id) over (partition by user_id order by event_id) last from events)"""
)
def r_save_points(spark, sf):
    """When the statistics of each user's session are written."""
    e = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "user_id")
    return timing.save_points(e, "user_id", order="event_id").select("event_id", "unsaved", "saves")


@query(
    """with e as (select user_id, event_id seq, ['path','file','file','begin','complete','cancel','reset','file'][(event_id*7%8+1)::int] ev, value<100 ok from events),
 p as (select *, count(*) filter (where ev in ('begin','reset')) over w ep,
   max(case when ev in ('begin','complete','cancel') then seq end) over w a, max(case when ev='begin' then seq end) over w b,
   max(case when ev='cancel' then seq end) over w c from e window w as (partition by user_id order by seq))
select user_id, seq, ev event, count(*) filter (where ev='path') over v paths, count(*) filter (where ev='file') over v files,
 count(*) filter (where ev='file' and ok) over v found, coalesce(a=b, false) active, coalesce(c>coalesce(b,-1), false) aborted
from p window v as (partition by user_id, ep order by seq)"""
)
def r_drop_lifecycle(spark, sf):
    """The status after each event of each user's drops."""
    kinds = F.array(*[F.lit(k) for k in ("path", "file", "file", "begin", "complete", "cancel", "reset", "file")])
    e = spark.read.parquet(f"{sf}/events.parquet")
    e = e.select("user_id", F.col("event_id").alias("seq"), F.get(kinds, (F.col("event_id") * 7 % 8).cast("int")).alias("event"), (F.col("value") < 100).alias("supported"))
    return drops.lifecycle(e, "user_id")


@query(
    """with t as (select p_partkey id, p_size*37.0 w, p_size*23.0 h, (50+p_size*7)::double z from part),
 v as (select *, (800/2.0-w*z/100)/2+10/2.0 l, (600/2.0-h*z/100)/2-4/2.0 t from t)
select id asset_id, round(greatest(0,-l/(z/100)),6) "left", round(greatest(0,-t/(z/100)),6) top, round(least(w,(800/2.0-l)/(z/100)),6) "right",
  round(least(h,(600/2.0-t)/(z/100)),6) bottom from v"""
)
def r_visible_rect(spark, sf):
    """Visible part of a centred image in its own coordinates."""
    p = spark.read.parquet(f"{sf}/part.parquet")
    r = raster.visible_rect(F.col("p_size") * 37.0, F.col("p_size") * 23.0, F.lit(800), F.lit(600), F.lit(2.0), (50 + F.col("p_size") * 7).cast("double"), F.lit(10), F.lit(-4))
    sides = ("left", "top", "right", "bottom")
    return p.select(F.col("p_partkey").alias("asset_id"), r.alias("r")).select("asset_id", *[F.round(F.col("r")[s], 6).alias(s) for s in sides])


@query(
    """with p as (select p_partkey id, (p_size*37+5)::int w, (p_size*23+3)::int h from part)
select id asset_id, greatest(1,floor(w*least(1.0::double,200.0/w,100.0/h)))::int pw, greatest(1,floor(h*least(1.0::double,200.0/w,100.0/h)))::int ph,
  w::bigint*4*h bytes, w::bigint*4*h>=268435456 is_large from p"""
)
def r_preview_size(spark, sf):
    """Preview sizes and raster bytes."""
    p = _rasters(spark, sf)
    s = raster.preview_size(F.col("w"), F.col("h"), F.lit(200.0), F.lit(100.0))
    return p.select("asset_id", s["w"].alias("pw"), s["h"].alias("ph"), raster.rgba_bytes(F.col("w"), F.col("h")).alias("bytes"), raster.is_large(F.col("w"), F.col("h")).alias("is_large"))


@query(
    """with t as (select distinct p_size n from part), b as (select n, unnest(range(n))::int b from t)
select n, b band, row_number() over (partition by n order by abs(b-n//2), b)-1 pos from b"""
)
def r_centre_out(spark, sf):
    """Bands from the middle outward."""
    n = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_size").alias("n")).distinct()
    return n.select("n", F.posexplode(tiles.centre_out(F.col("n"))).alias("pos", "band")).select("n", "band", F.col("pos").cast("long").alias("pos"))


_SPIRAL = """with t as (select p_partkey id, (p_size*37+5)::int w, (p_size*23+3)::int h from part), g as (select *, unnest(range((h+63)//64))::int ty from t),
 x as (select *, unnest(range((w+63)//64))::int tx from g), d as (select *, tx-2 dx, ty-1 dy, greatest(abs(tx-2),abs(ty-1)) r from x),
 s as (select *, case when dx=0 and dy=0 then 0 when r=dx and dy>-r and dy<=r then (2*r-1)*(2*r-1)+(dy+r-1)
  when r=dy and dx<r then (2*r-1)*(2*r-1)+2*r+(r-dx-1) when r=-dx and dy<r then (2*r-1)*(2*r-1)+4*r+(r-dy-1)
  else (2*r-1)*(2*r-1)+6*r+(dx+r-1) end::int spiral from d)"""


@query(_SPIRAL + " select id asset_id, tx, ty, spiral from s")
def r_spiral(spark, sf):
    """Place of each tile in the spiral around tile (2, 1)."""
    return tiles.spiral(tiles.tile_grid(_rasters(spark, sf)), F.lit(2), F.lit(1)).select("asset_id", "tx", "ty", "spiral")


@query(_SPIRAL + ' select id asset_id, ty, min(spiral) "first" from s group by 1,2')
def r_band_order(spark, sf):
    """Bands by their first tile in the spiral."""
    return tiles.band_order(tiles.tile_grid(_rasters(spark, sf)), F.lit(2), F.lit(1))


@query(
    f"""with {_PIXELS}, n as (select *, (cast((1-(255-a)::float/255::float) as float)) ca, cast((1-(255-d)::float/255::float) as float) kd from px)
select a, d, least(255,greatest(0,floor(cast(cast(cast(255::float*ca as float)*kd as float)+0.5::float as float))))::int v from n group by all"""
)
def r_cmyk(spark, sf):
    """RGB component of inverted ink and black bytes."""
    return _pixels(spark, sf).select("a", "d", raster.cmyk_component(F.col("a"), F.col("d")).alias("v")).distinct()


@query(
    f"""with {_PIXELS}, n as (select *, greatest(a,b,c)-least(a,b,c)<=20 near from px)
select a, b, c, d, case when near then least(255,a+8) else a end r, case when near then greatest(0,b-6) else b end g, c bl, (a*d+127)//255 pm from n"""
)
def r_neutral_balance(spark, sf):
    """Near-neutral correction, and premultiplied alpha."""
    r, g, b = raster.neutral_balance(F.col("a"), F.col("b"), F.col("c"))
    return _pixels(spark, sf).select("a", "b", "c", "d", r.alias("r"), g.alias("g"), b.alias("bl"), raster.premultiply(F.col("a"), F.col("d")).alias("pm"))


@query(
    """with z as (select distinct (p_size*p_size*4)::int z from part), c as (select z, least(10000,greatest(1,round(z*1.05)))::int u, least(10000,greatest(1,round(z/1.05)))::int d from z)
select z, case when u<=z then least(10000,z+1) else u end zoom_in, case when d>=z then greatest(1,z-1) else d end zoom_out from c"""
)
def r_zoom(spark, sf):
    """One zoom step in and out."""
    z = spark.read.parquet(f"{sf}/part.parquet").select((F.col("p_size") * F.col("p_size") * 4).alias("z")).distinct()
    return z.select("z", raster.next_zoom(F.col("z"), F.lit(1)).alias("zoom_in"), raster.next_zoom(F.col("z"), F.lit(-1)).alias("zoom_out"))


@query(
    """with d as (select d.doc_id, coalesce(case when doc_id%3=0 then '' when doc_id%5=0 then lang else source end,'') cur, coalesce(case when doc_id%7=0 then '  ' else lang end,'') new from documents d)
select doc_id, case when cur='' then new when new=cur or trim(new)='' then cur else cur end low, case when cur='' then new when new=cur or trim(new)='' then cur else new end high from d"""
)
def r_priority_coalesce(spark, sf):
    """Low and high priority assignment."""
    d = spark.read.parquet(f"{sf}/documents.parquet")
    i = F.col("doc_id")
    cur = F.when(i % 3 == 0, "").when(i % 5 == 0, F.col("lang")).otherwise(F.col("source"))
    new = F.when(i % 7 == 0, "  ").otherwise(F.col("lang"))
    return d.select("doc_id", text.assign(cur, new, False).alias("low"), text.assign(cur, new, True).alias("high"))


@query("with l as (select event_id, user_id, event_type m, lag(event_type) over (partition by user_id order by event_id) b from events) select event_id, user_id, m message from l where m is distinct from b")
def r_log_dedupe(spark, sf):
    """Log rows that do not repeat the message before."""
    e = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "user_id", F.col("event_type").alias("message"))
    return jobs.without_repeats(e, "user_id", order="event_id")


@query("select user_id, arg_max(event_type, event_id) event_type from events group by 1")
def r_latest(spark, sf):
    """Last value a key."""
    return jobs.latest(spark.read.parquet(f"{sf}/events.parquet"), "user_id", "event_type", "event_id")


@query(
    """select doc_id, case when n_chars*997>=2097152 then regexp_replace(printf('%.1f', round_even(n_chars*997/1048576.0,1)),'\\.0$','')||' MB'
  when n_chars*997>=1024 then round_even(n_chars*997/1024.0,0)::bigint||' kB' else n_chars*997||' bytes' end size_text,
  case when n_chars%11=0 then 'n/a' when n_chars/100.0<10 then printf('%.2f',(n_chars/100.0)::double) else printf('%.0f',floor(n_chars/100.0)::double) end ms_text from documents"""
)
def r_display_text(spark, sf):
    """Sizes and times as shown."""
    d = spark.read.parquet(f"{sf}/documents.parquet")
    n = F.col("n_chars")
    ms = F.when(n % 11 == 0, None).when(n / 100.0 < 10, n / 100.0).otherwise(F.floor(n / 100.0).cast("double"))
    return d.select("doc_id", text.size_text(n * 997).alias("size_text"), text.ms_text(ms).alias("ms_text"))


@query(
    """with e as (select user_id, list(event_type order by event_id) l from events group by 1)
select user_id, case when list_contains(l,'purchase') then 'Complete' when len(l)>0 then 'Loading' end state from e"""
)
def r_job_states(spark, sf):
    """State of each user's job if a purchase completes it and anything else begins it."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    kind = F.when(F.col("event_type") == "purchase", "complete").otherwise("begin")
    s = jobs.job_states(e.select(F.col("user_id").cast("string").alias("path"), F.col("event_id").alias("seq"), kind.alias("event")))
    return s.select(F.col("path").cast("long").alias("user_id"), "state")


@query("select c_custkey, upper(sha256(c_name)) hash, upper(hex(encode(left(c_mktsegment,4)))) tag from customer")
def r_hash_and_tag(spark, sf):
    """Upper-case SHA-256, and four-character codes as numbers and back."""
    c = spark.read.parquet(f"{sf}/customer.parquet")
    code = binary.four_cc_number(F.substring("c_mktsegment", 1, 4))
    return c.select("c_custkey", binary.sha256_upper(F.encode("c_name", "UTF-8")).alias("hash"), F.hex(F.encode(binary.four_cc_of(code), "UTF-8")).alias("tag"))


@query()
def r_psd_scanlines(spark, sf):
    """Scanlines of one small layered document a nation, made here (no SQL form)."""
    from tilewright.plans.samples import make_psd
    from tilewright.sources import psd

    n = spark.read.parquet(f"{sf}/nation.parquet").select("n_nationkey").collect()  # 25 rows, a fixed size
    files = [(f"/n/{r[0]}.psd", make_psd(7 + r[0], 5, "Rgb", 3, ("Raw", "Rle", "Zip", "ZipPredict")[r[0] % 4], big=r[0] % 2 == 1, seed=r[0])) for r in n]
    return psd.plane_rows(spark.createDataFrame(files, "path string, content binary"))


@query("select p_partkey, hex(encode('abc' || repeat('z', p_size + 2))) x from part")
def r_run_lengths(spark, sf):
    """Run-length coded scanlines: three literals, then one byte many times."""
    from tilewright.sources import psd

    def run(batches):
        for b in batches:
            rows = [psd.unpack_bits(x.as_py(), n.as_py()) for x, n in zip(b.column(1), b.column(2))]
            yield pa.record_batch([b.column(0), pa.array(rows, pa.binary())], names=["p_partkey", "row"])

    p = spark.read.parquet(f"{sf}/part.parquet")
    packed = F.unhex(F.concat(F.lit("02"), F.hex(F.lit("abc")), F.lpad(F.hex(255 - F.col("p_size")), 2, "0"), F.hex(F.lit("z"))))
    rows = p.select(F.col("p_partkey").cast("long"), packed.alias("packed"), (F.col("p_size") + 5).cast("int").alias("width"))
    return rows.mapInArrow(run, "p_partkey long, row binary").select("p_partkey", F.hex("row").alias("x"))


@query("select c_custkey, ascii(c_name)*256 + ascii(substr(c_name, 2)) u, ascii(c_name) - 100 - case when ascii(c_name) >= 228 then 256 else 0 end s, 'ustomer' sig from customer")
def r_big_endian(spark, sf):
    """Numbers and signatures inside bytes."""
    c = spark.read.parquet(f"{sf}/customer.parquet").withColumn("b", F.encode("c_name", "UTF-8"))
    sig = F.when(binary.starts_with(F.substring("b", 2, 9), b"ustomer"), "ustomer")
    return c.select("c_custkey", binary.unsigned(F.col("b"), 0, 2).alias("u"), (binary.signed(F.col("b"), 0, 1) - 100).alias("s"), sig.alias("sig"))


@query(
    """select page_id, case when page_id%3=0 then regexp_replace(path,'/[^/]*$','') when page_id%3=1 then path
  when regexp_extract(path,'([^/]*)$',1) like '%._%' then regexp_replace(path,'/[^/]*$','') else path end dir, lower(path) folded
from (select page_id, regexp_replace(regexp_replace(url,'[?#].*$',''),'/$','') path from pages where url like '%://%')"""
)
def r_normal_directories(spark, sf):
    """Directories of paths that are files, directories, or do not exist."""
    p = _pages(spark, sf).filter(F.col("path").contains("://"))
    kind = F.col("page_id") % 3
    return p.select("page_id", paths.normalise_directory(F.col("path"), kind == 1, kind < 2).alias("dir"), paths.key(F.col("path"), fold=True).alias("folded"))


@query(
    """select c_custkey, concat_ws(chr(10), 'Make: '||c_name, case when c_custkey%2=0 then 'Lens: '||c_mktsegment end,
  case when c_custkey%3=0 then chr(10)||'ISO: '||c_custkey end, case when c_custkey%5=0 then chr(10)||'Software: x' end) lines, true has_data from customer"""
)
def r_exif_lines(spark, sf):
    """Metadata lines in blocks."""
    c = spark.read.parquet(f"{sf}/customer.parquet")
    k = F.col("c_custkey")
    given = {"make": F.col("c_name"), "model": F.lit("  "), "lens": F.when(k % 2 == 0, F.col("c_mktsegment")), "iso": F.when(k % 3 == 0, k.cast("string")), "software": F.when(k % 5 == 0, "x")}
    exif = F.struct(*[given.get(f, F.lit(None).cast("string")).alias(f) for f, _, _ in text.EXIF_FIELDS])
    return c.select("c_custkey", F.array_join(text.exif_lines(exif), "\n").alias("lines"), text.exif_has_data(exif).alias("has_data"))


@query("select n_nationkey, '[:a ][e:'||n_name||'][: < of ][d:'||n_regionkey||'][:.]' parts, trim(regexp_replace(n_name, '([A-Z])', ' \\1', 'g')) spaced from nation where n_name not like '% %'")
def r_tagged_text(spark, sf):
    """Inline tags cut into parts, and names split at capitals."""
    n = spark.read.parquet(f"{sf}/nation.parquet").filter(~F.col("n_name").contains(" "))
    line = F.concat(F.lit("a <e>"), "n_name", F.lit("</> < of <d>"), F.col("n_regionkey").cast("string"), F.lit("</>."))
    parts = F.transform(text.tagged_parts(line), lambda p: F.concat(F.lit("["), p["tag"], F.lit(":"), p["text"], F.lit("]")))
    return n.select("n_nationkey", F.array_join(parts, "").alias("parts"), formats.display_name(F.col("n_name")).alias("spaced"))


@query(
    """select distinct a, b, case when b>0 then a*power(2.0::double, b-136) else 0 end rgbe from (
  select cast(floor(l_extendedprice) as bigint)%256 a, cast(floor(l_quantity*5) as bigint)%256 b from lineitem)"""
)
def r_rgbe(spark, sf):
    """Shared-exponent components as numbers."""
    p = _pixels(spark, sf).select("a", "b").distinct()
    return p.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), raster.rgbe_component(F.col("a"), F.col("b")).alias("rgbe"))


@query(
    """with p as (select p_partkey id, p_size s from part)
select id, round_even(least(800.0/(s*37), 600.0/(s*23))*100/2,0)::int fit, case when s*37<=400 and s*23<=300 then 'OriginalImageSize' else 'FitToScreen' end as mode,
  greatest(256, floor(least(8192,greatest(256,floor(sqrt(greatest(1,floor(s*1000003/4))))))/64)*64)::int edge,
  round(least(100.0/(s*37), 90.0/(s*23)),9) ppu, s*2/100.0*1.5 > least(100.0/(s*37), 90.0/(s*23))*1.05 demand,
  greatest(-greatest(0,(s*37-800)/2.0), least(greatest(0,(s*37-800)/2.0), s*11.0-300)) pan, greatest(0, least(s*3//64, 1))::int tile from p"""
)
def r_view_numbers(spark, sf):
    """Fit zoom, display mode, tile edge, preview density, tile demand, panning, tile of a point."""
    p, s = spark.read.parquet(f"{sf}/part.parquet"), F.col("p_size")
    ppu = raster.preview_ppu(F.lit(100.0), F.lit(90.0), s * 37, s * 23)
    return p.select(
        F.col("p_partkey").alias("id"), raster.fit_zoom(F.lit(800.0), F.lit(600.0), s * 37, s * 23, F.lit(2)).alias("fit"),
        raster.initial_mode(F.lit(800), F.lit(600), s * 37, s * 23, F.lit(2)).alias("mode"), raster.tile_edge(s * 1000003).alias("edge"),
        F.round(ppu, 9).alias("ppu"), raster.needs_tiles(s * 2, F.lit(1.5), ppu).alias("demand"),
        raster.pan_clamp(s * 11.0 - 300, s * 37, F.lit(800)).alias("pan"), tiles.tile_at(s * 3, F.lit(64), F.lit(2)).alias("tile"),
    )


@query(
    """select id, greatest(10, s)::double l, greatest(5, 20)::double t, least(60, s+30)::double r, least(40, 20+s)::double b from (select p_partkey id, p_size s from part)
where greatest(10, s) < least(60, s+30) and greatest(5, 20) < least(40, 20+s)"""
)
def r_intersections(spark, sf):
    """Common parts of rectangles; those without one have no row."""
    p, s = spark.read.parquet(f"{sf}/part.parquet"), F.col("p_size")
    rect = lambda *v: F.struct(*[x.cast("double").alias(n) for x, n in zip(v, ("left", "top", "right", "bottom"))])
    both = raster.intersect(rect(F.lit(10), F.lit(5), F.lit(60), F.lit(40)), rect(s, F.lit(20), s + 30, 20 + s))
    return p.select(F.col("p_partkey").alias("id"), both.alias("x")).filter("x is not null").select(
        "id", F.col("x.left").alias("l"), F.col("x.top").alias("t"), F.col("x.right").alias("r"), F.col("x.bottom").alias("b")
    )


@query(
    """select id, b band, row_number() over (partition by id order by min(i)) - 1 place from (
  select p_partkey id, p_size, generate_subscripts([p_size-20, 3, p_size%7, -1, 3, p_size], 1) i, unnest([p_size-20, 3, p_size%7, -1, 3, p_size]) b from part)
where b >= 0 and b < p_size group by id, b"""
)
def r_normal_bands(spark, sf):
    """Asked bands inside the grid, each once, in the order in which they were asked."""
    p, s = spark.read.parquet(f"{sf}/part.parquet"), F.col("p_size")
    asked = F.array(s - 20, F.lit(3), s % 7, F.lit(-1), F.lit(3), s)
    out = p.select(F.col("p_partkey").alias("id"), F.posexplode(tiles.normalise_bands(asked, s)).alias("place", "band"))
    return out.select("id", "band", F.col("place").cast("long").alias("place"))


@query(
    """with g as (select o_custkey, count(*) total, count(*) filter (where o_orderkey%3<>0) ready from orders group by 1)
select o_custkey, ready, total, ready = total complete from g"""
)
def r_completion(spark, sf):
    """Tiles that are there against the total, an order standing for a tile."""
    o = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_custkey").alias("asset_id"), F.when(F.col("o_orderkey") % 3 != 0, F.lit("x")).alias("data"))
    done = tiles.completion(o, o.groupBy("asset_id").agg(F.count("*").alias("total")))
    return done.select(F.col("asset_id").alias("o_custkey"), "ready", "total", "complete")


@query(
    """with r as (select n_nationkey id, unnest(range(n_nationkey + 3)) y from nation),
 t as (select id, unnest([0, 1]) tx, y, chr((65 + y)::int) c from r)
select id asset_id, tx, y // 4 ty, string_agg(repeat(c, case when tx = 0 then 4 else 3 end), '' order by y) as data from t group by id, tx, y // 4"""
)
def r_plane_tiles(spark, sf):
    """Scanlines cut into tiles of four by four."""
    n = spark.read.parquet(f"{sf}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("asset_id"))
    rows = n.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("asset_id").cast("int") + 2)))
    rows = rows.select("asset_id", F.lit(0).alias("plane"), F.lit("Gray").alias("role"), "y", F.encode(F.expr("repeat(char(65 + y), 7)"), "UTF-8").alias("row"))
    dims = n.select("asset_id", F.lit(7).alias("w"), F.lit(4).alias("tile_w"), F.lit(4).alias("tile_h"))
    return tiles.cut_tiles(rows, dims).select("asset_id", "tx", F.col("ty").cast("long").alias("ty"), F.decode("data", "UTF-8").alias("data"))


@query(
    """select l_suppkey, arg_min((br-r)*(br-r)+(bg-g)*(bg-g)+(bb-b)*(bb-b) < (ar-r)*(ar-r)+(ag-g)*(ag-g)+(ab-b)*(ab-b), o) inverted from (
  select l_suppkey, l_orderkey*8+l_linenumber o, l_partkey%256 r, l_orderkey%256 g, l_linenumber b, l_partkey%99 ar, l_orderkey%77 ag, 9 ab,
    255-l_partkey%99 br, 255-l_orderkey%77 bg, 246 bb from lineitem) group by 1"""
)
def r_polarity(spark, sf):
    """Whether the inverted variant of the first sample is nearer to the baseline."""
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    k, o, n = F.col("l_partkey"), F.col("l_orderkey"), F.col("l_linenumber")
    values = {"r": k % 256, "g": o % 256, "b": n, "ar": k % 99, "ag": o % 77, "ab": F.lit(9), "br": 255 - k % 99, "bg": 255 - o % 77, "bb": F.lit(246)}
    samples = li.select("l_suppkey", (o * 8 + n).alias("ord"), *[v.cast("long").alias(c) for c, v in values.items()])
    return color.polarity(samples, "l_suppkey")


@query(
    """select id, g, least(floor((g+0.5)*w/48), w-1)::int x from (select p_partkey id, (p_size*37+5)::int w, unnest(range(48))::int g from part)"""
)
def r_calibration_grid(spark, sf):
    """Where the samples of a calibration grid stand."""
    return _rasters(spark, sf).select(F.col("asset_id").alias("id"), F.posexplode(color.sample_positions(F.col("w"))).alias("g", "x"))


@query("select l_returnflag, l_linestatus, round(sum(l_quantity),2) sum_qty, round(avg(l_extendedprice),4) avg_price, count(*) n from lineitem group by 1,2")
def s_pricing_summary(spark, sf):
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.avg("l_extendedprice"), 4).alias("avg_price"), F.count("*").alias("n"))


@query(
    """select n_name, count(distinct c_custkey) customers, round(sum(o_totalprice),2) total from customer join orders on c_custkey=o_custkey
  join nation on c_nationkey=n_nationkey group by 1"""
)
def s_nation_revenue(spark, sf):
    t = lambda n: spark.read.parquet(f"{sf}/{n}.parquet")
    j = t("orders").select("o_custkey", "o_totalprice").join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    j = j.join(t("nation").select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(F.countDistinct("c_custkey").alias("customers"), F.round(F.sum("o_totalprice"), 2).alias("total"))
