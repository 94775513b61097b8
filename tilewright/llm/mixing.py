"""Mixing sources to target weights with a low-discrepancy schedule.

Every source's documents are shuffled into one token stream and cut into blocks
of equal tokens.  Slot ``n`` of the schedule takes the golden-ratio point
``frac((n + 1/2) * phi)``, whose place in the cumulative target shares names its
source; the slot's rank among its source's slots names the block.  A source's
blocks end exactly at its target, and its stream repeats while the target lasts.

Running sums never gather a hot source in one task: sums over 4096 hash buckets
(or slot chunks) are small, and the rest is a window inside one bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tilewright.llm.common import materialize, n_words

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SLOTS = 1 << 18
SEED = "mix"
_PHI = 0.6180339887498949
_CELLS = 4096
_CHUNK = 4096
#: A sources table up to this many rows is broadcast (about 100 bytes a row).
_BROADCAST_ROWS = 100_000


def targets(sized: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """source, sidx, source_size, target, total, lo, hi from rows (source, size).

    Water filling in closed form: sources sorted by cap / weight; the level is
    the first at which no later source is above its cap.  The windows run over
    one row per source, not over documents.
    """
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    s = s.withColumn("sidx", rank)
    s = s.withColumn("w", F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod("sidx", F.lit(len(weights)))))
    s = s.withColumn("cap", F.col("source_size") * max_epochs).withColumn("ratio", F.col("cap") / F.col("w"))
    by = Window.orderBy("ratio", "sidx")
    every = Window.partitionBy()
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    after = by.rowsBetween(0, Window.unboundedFollowing)
    s = s.withColumn("total", F.sum("source_size").over(every))
    s = s.withColumn(
        "level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("w").over(after)
    )
    first = F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "sidx", "level"))
    s = s.withColumn("level", F.min(first).over(every)["level"])
    s = s.withColumn("target", F.least(F.col("cap").cast("double"), F.col("level") * F.col("w")))
    upto = Window.orderBy("sidx").rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumn("hi", F.sum("target").over(upto) / F.greatest(F.sum("target").over(every), F.lit(1e-300)))
    s = s.withColumn("lo", F.lag("hi", 1, 0.0).over(Window.orderBy("sidx")))
    s = s.withColumn("hi", F.when(F.lead("sidx").over(Window.orderBy("sidx")).isNull(), 2.0).otherwise(F.col("hi")))
    return s.select("source", "sidx", "source_size", "target", "total", "lo", "hi")


def schedule(src: DataFrame, total: int, slots: int = SLOTS) -> DataFrame:
    """The slot table (sidx, block, slot): which block of which source comes when.

    ``slot`` orders the mix.  Slots past a source's quota are void; blocks that
    the points left over follow at the end.
    """
    spark = src.sparkSession
    size = max(1, -(-total // slots))
    n = -(-total // size)
    need = F.ceil(F.round("target") / size).cast("long")
    src = src.withColumn("need", need)
    cells = src.filter("target > 0").select(
        "sidx", "lo", "hi", "need",
        F.explode(F.sequence(F.floor(F.col("lo") * _CELLS), F.least(F.floor(F.col("hi") * _CELLS), F.lit(_CELLS - 1)))).alias("cell"),
    )
    x = (F.col("id") + 0.5) * _PHI
    points = spark.range(n).select(F.col("id").alias("slot"), (x - F.floor(x)).alias("x"))
    hit = (
        points.withColumn("cell", F.floor(F.col("x") * _CELLS))
        .join(cells, "cell")
        .filter("x >= lo and x < hi")
        .select("sidx", "slot", "need", F.floor(F.col("slot") / _CHUNK).alias("chunk"))
    )
    counts = hit.groupBy("sidx", "chunk").agg(F.count("*").alias("c"))
    run = Window.partitionBy("sidx").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("c").over(run), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("sidx", "chunk").orderBy("slot")) - 1
    hit = hit.withColumn("inside", inside).join(counts, ["sidx", "chunk"])
    hit = hit.select("sidx", (F.col("before") + F.col("inside")).alias("block"), "slot", "need")
    got = counts.groupBy("sidx").agg(F.sum("c").alias("got"))
    rest = (
        src.filter("target > 0").join(got, "sidx", "left")
        .withColumn("got", F.coalesce("got", F.lit(0)))
        .filter("need > got")
        .select("sidx", F.explode(F.sequence(F.col("got"), F.col("need") - 1)).alias("block"))
        .withColumn("slot", F.lit(n) + F.col("block"))
    )
    return hit.filter("block < need").select("sidx", "block", "slot").unionByName(rest)


def plan(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights=WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    slots: int = SLOTS,
    carry: bool = False,
) -> tuple[DataFrame, DataFrame, int, DataFrame | None]:
    """(placed, slot table, block size, rows): placed has one row per document with
    its place ``a`` in its source's stream; with ``carry`` rows has _rid and ``row``.
    """
    x = docs.select(
        F.monotonically_increasing_id().alias("_rid"),
        F.col(f"`{id_col}`").alias("doc_id"),
        F.col(f"`{source_col}`").alias("source"),
        n_words(F.col(f"`{text_col}`")).alias("size"),
        F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("_t"),
        F.md5(F.concat(F.lit(SEED), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")))).alias("_h"),
        *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []),
    )
    x = materialize(x, "mixing")
    src = materialize(targets(x, weights, max_epochs), "mixing-sources")
    first = src.select("total").first()
    total, n_sources = (first[0] or 0, src.count()) if first else (0, 0)
    small = F.broadcast if n_sources <= _BROADCAST_ROWS else (lambda d: d)
    x = x.withColumn("_b", F.conv(F.substring("_h", 1, 3), 16, 10).cast("int"))
    sums = x.groupBy("source", "_b").agg(F.sum("size").alias("s"))
    run = Window.partitionBy("source").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source", "_b", F.coalesce(F.sum("s").over(run), F.lit(0)).alias("_base"))
    inner = (
        Window.partitionBy("source", "_b").orderBy("_h", "doc_id", "size", "_t")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    narrow = x.drop("row", "_t")
    here = x.drop("row").withColumn("_in", F.coalesce(F.sum("size").over(inner), F.lit(0))).drop("_t").alias("x")
    sums = sums.alias("p")
    here = here.join(
        sums, F.col("x.source").eqNullSafe(F.col("p.source")) & (F.col("x._b") == F.col("p._b"))
    ).select(*[F.col(f"x.{c}") for c in narrow.columns], (F.col("p._base") + F.col("x._in")).alias("a"))
    here = here.alias("x").join(small(src.alias("s")), F.col("x.source").eqNullSafe(F.col("s.source")))
    here = here.select(
        "x._rid", "x.doc_id", "x.size", "x.a", "s.sidx", "s.source_size", "s.target",
        F.round("s.target").cast("long").alias("quota"),
    )
    return here, schedule(src, total, slots), max(1, -(-total // slots)), x.select("_rid", "row") if carry else None


def _copies(placed: DataFrame, max_epochs: int) -> DataFrame:
    """A row for each time a document's start comes up in its source's repeated stream."""
    epoch = F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1))).alias("epoch")
    p = placed.select("*", epoch).withColumn("at", F.col("a") + F.col("epoch") * F.col("source_size"))
    return p.filter("at < quota")


def taken(docs: DataFrame, *, max_epochs: int = MAX_EPOCHS, slots: int = SLOTS, **cols) -> DataFrame:
    """doc_id, size, source_size, target, taken, first_slot, last_slot for every row
    of ``docs``: the slots of the schedule in which its first and its last copy
    begin (null: it is not taken).

    Null text has size 0 and takes no part; a null source is a source of its
    own, placed last.  Repeated rows are separate rows.  An empty table gives an
    empty result.  Extra columns are not touched.
    """
    placed, table, block, _ = plan(docs, max_epochs=max_epochs, slots=slots, **cols)
    placed = materialize(placed, "mixing-placed")
    end = F.least(F.col("at") + F.col("size"), F.col("quota"))
    parts = _copies(placed.filter("size > 0"), max_epochs).withColumn("end", end)
    parts = parts.select(
        "_rid", "sidx", "at", "end", "quota", F.floor(F.col("at") / block).alias("begins"),
        F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((F.col("end") - 1) / block))).alias("block"),
    )
    words = F.least("end", (F.col("block") + 1) * block) - F.greatest("at", F.col("block") * block)
    slot = F.when(F.col("block") == F.col("begins"), F.col("slot"))
    got = parts.join(table, ["sidx", "block"]).groupBy("_rid")
    got = got.agg(F.sum(words).alias("taken"), F.min(slot).alias("first_slot"), F.max(slot).alias("last_slot"))
    return placed.join(got, "_rid", "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"),
        F.col("first_slot").cast("long").alias("first_slot"), F.col("last_slot").cast("long").alias("last_slot"),
    )


def scheduled(docs: DataFrame, *, max_epochs: int = MAX_EPOCHS, slots: int = SLOTS, **cols) -> DataFrame:
    """slot, sidx, at and ``row``: a document comes once for every time the schedule
    reaches its first word (never more than ``max_epochs`` times), so whole texts
    are kept.  The mix is in the order of slot, sidx, at, which no two rows share;
    the rows here are not sorted.  Documents without words have no place in a
    stream and are left out.
    """
    placed, table, block, rows = plan(docs, max_epochs=max_epochs, slots=slots, carry=True, **cols)
    copies = _copies(placed.filter("size > 0"), max_epochs)
    copies = copies.withColumn("block", F.floor(F.col("at") / block))
    copies = copies.join(table, ["sidx", "block"]).select("_rid", "slot", "sidx", "at")
    return materialize(copies, "mixing-slots").join(rows, "_rid").select("slot", "sidx", "at", "row")


def mix(docs: DataFrame, *, max_epochs: int = MAX_EPOCHS, slots: int = SLOTS, **cols) -> DataFrame:
    """The rows of ``scheduled`` with the columns of ``docs``, in the order of the
    schedule: partitions are ranges of slots, so what is written stands in the
    order of the part files, and every stretch of it is near the target weights.
    """
    out = scheduled(docs, max_epochs=max_epochs, slots=slots, **cols)
    return out.orderBy("slot", "sidx", "at").select("row.*")


def op4_mixing(docs: DataFrame) -> DataFrame:
    return taken(docs)


OP4_SQL = r"""
with x as (
  select doc_id, source, text,
    len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::bigint size,
    md5('mix' || coalesce(doc_id::varchar, '')) h from documents
), s as (
  select source, sum(size)::bigint source_size, row_number() over (order by source nulls last) - 1 sidx
  from x group by source
), w as (
  select *, [5.0, 2.0, 1.0][(sidx % 3 + 1)::int]::double w, 3 * source_size cap, sum(source_size) over () total from s
), l as (
  select *, cap / w ratio,
    ((total - coalesce(sum(cap) over (order by cap / w, sidx rows between unbounded preceding and 1 preceding), 0))::double
     / sum(w) over (order by cap / w, sidx rows between current row and unbounded following)) lev from w
), t as (
  select source, sidx, source_size, total,
    least(cap::double, w * (min(case when lev <= ratio then {'r': ratio, 's': sidx, 'l': lev} end) over ()).l) target from l
), u as (
  select *, greatest(1, ceil(total / 262144.0)::bigint) size,
    sum(target) over (order by sidx) / greatest(sum(target) over (), 1e-300) hi from t
), v as (
  select *, ceil(total / size)::bigint slots, ceil(round(target) / size)::bigint need, coalesce(lag(hi) over (order by sidx), 0) lo,
    case when lead(sidx) over (order by sidx) is null then 2 else hi end upto from u
), h as (
  select sidx, slot, need, row_number() over (partition by sidx order by slot) - 1 block
  from (select slot, (slot + 0.5::double) * 0.6180339887498949::double y from (select unnest(range((select any_value(slots) from v))) slot))
  join v on y - floor(y) >= lo and y - floor(y) < upto and target > 0
), b as (
  select sidx, block, slot from h where block < need
  union all
  select sidx, block, any_slots + block from (
    select v.sidx, slots any_slots, unnest(range(coalesce(got, 0), need)) block
    from v left join (select sidx, count(*) got from h group by sidx) c on v.sidx = c.sidx where target > 0)
), p as (
  select x.doc_id, x.size, source_size, target, round(target)::bigint q, t.sidx, t.size bs,
    coalesce(sum(x.size) over (partition by x.source order by h, doc_id, x.size rows between unbounded preceding and 1 preceding), 0)::bigint a
  from x join v t on x.source is not distinct from t.source
), z as (
  select *, a + source_size * case when a + 2 * source_size < q then 2 when a + source_size < q then 1 else 0 end la from p
)
select doc_id, z.size, source_size, target,
  (greatest(0, least(a + size, q) - a) + greatest(0, least(a + size + source_size, q) - a - source_size)
   + greatest(0, least(a + size + 2 * source_size, q) - a - 2 * source_size))::bigint taken,
  b1.slot::bigint first_slot, b2.slot::bigint last_slot
from z left join b b1 on z.sidx = b1.sidx and size > 0 and a < q and b1.block = a // bs
  left join b b2 on z.sidx = b2.sidx and size > 0 and a < q and b2.block = la // bs"""
