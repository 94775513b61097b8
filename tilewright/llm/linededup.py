"""Line dedup: a suffix array over line ids by distributed prefix doubling.

A document is its sequence of non-blank lines (trimmed; blank lines stay in the
text but are no part of the sequence).  A suffix is a position (document, line).

1. Doubling.  Round by round a suffix's name stands for its first 1, 2, 4, ...
   lines: the name for 2h lines is made from its name for h lines and that of the
   suffix h lines on, which one join on (document, line) brings together.
   Suffixes whose name nothing else shares leave, and rounds end when no name is
   shared: all prefixes are told apart.
2. Intervals.  The suffixes that share a prefix are an interval of the suffix
   array.  The intervals with their exact common prefixes are found from the
   rounds, longest first: where several suffixes (or intervals) under one interval
   agree in the next 2**k lines, they become an interval of their own, 2**k lines
   longer.  After the round of one line the tree of intervals is the suffix tree.
3. Runs.  The first place of an interval that is not the first of the interval
   around it repeats, with the common prefix of that one, what stands earlier;
   this is the longest run at that place that does.  Runs that lie inside a run
   that starts before are not maximal.  The lines of all runs are deleted.

Every step is a join or an aggregation by keys; no interval is gathered anywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tilewright.llm.common import fingerprint, let, materialize, n_words, release, strip

MIN_LINES = 2
#: From so many words on, a single repeated line counts as a run by its content.
LONG_WORDS = 50
_SUFFIX = ["rid", "doc", "k", "i"]


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _shared(rows: DataFrame) -> DataFrame:
    """The suffixes whose (n1, n2) name another suffix has too."""
    names = rows.groupBy("n1", "n2").agg(F.count("*").alias("c")).filter("c > 1").drop("c")
    # stored, so that the join has an exchange of its own on both sides and a very
    # common line can be split
    names = materialize(names, "line-names")
    out = materialize(rows.join(names, ["n1", "n2"]).select(*_SUFFIX, "n1", "n2"), "line-suffixes")
    release(names)
    return out


def name_rounds(lines: DataFrame) -> list[DataFrame]:
    """Round k: rid, doc, k, i, n1, n2 of the suffixes that share their first 2**k lines."""
    rounds = [_shared(lines)]
    while True:
        now, h = rounds[-1], 1 << len(rounds) - 1
        on = now.select("rid", (F.col("i") - h).alias("i"), F.col("n1").alias("m1"), F.col("n2").alias("m2"))
        n1, n2 = fingerprint(F.col("n1"), F.col("n2"), F.col("m1"), F.col("m2"))
        found = _shared(now.join(on, ["rid", "i"]).select(*_SUFFIX, n1.alias("n1"), n2.alias("n2")))
        if found.isEmpty():
            release(found)
            return rounds
        rounds.append(found)


def later_runs(lines: DataFrame, least: int) -> DataFrame:
    """rid, i, n: the suffixes whose first ``n`` lines, ``least`` or more and as many
    as possible, also start at an earlier place (doc, k, i).

    ``lines``: rid, doc, k, i, n1, n2; one rid for each (doc, k).
    """
    rounds = name_rounds(lines)
    start = min(len(rounds), least.bit_length()) - 1  # the last round of ``least`` lines or fewer
    # a row: an interval (at first a suffix) by its first place, and the interval
    # around it by its first place and common prefix; the whole array to begin with
    around = [F.lit(-1).cast("long").alias("prid"), F.lit(0).alias("pi"), F.lit(0).alias("depth")]
    rows = rounds[start].select(*_SUFFIX, *around)
    group, stored = ["prid", "pi", "depth", "n1", "n2"], None
    for r in range(len(rounds) - 1, -1, -1):
        # what cannot come to a common prefix of ``least`` lines any more leaves
        rows = rows.filter(F.col("depth") + (2 << r) - 1 >= least)
        names = rounds[r].select("rid", F.col("i").alias("at"), "n1", "n2")
        named = rows.withColumn("at", F.col("i") + F.col("depth")).join(names, ["rid", "at"], "left").drop("at")
        named = materialize(named, "line-intervals")
        fresh = named.filter("n1 is not null").groupBy(*group).agg(F.count("*").alias("c"), F.min(F.struct("doc", "k", "i", "rid")).alias("first"))
        fresh = materialize(fresh.filter("c > 1").drop("c"), "line-intervals")
        inside = named.join(fresh, group, "left")
        moved = lambda new, old: F.when(F.col("first").isNotNull(), new).otherwise(F.col(old)).alias(old)
        kept = inside.select(*_SUFFIX, moved(F.col("first.rid"), "prid"), moved(F.col("first.i"), "pi"), moved(F.col("depth") + (1 << r), "depth"))
        made = fresh.select("first.rid", "first.doc", "first.k", "first.i", "prid", "pi", "depth")
        before, stored = stored, materialize(kept.unionByName(made), "line-intervals")
        release(named, fresh, before)
        rows = stored
    later = rows.filter((F.col("depth") >= least) & ((F.col("rid") != F.col("prid")) | (F.col("i") != F.col("pi"))))
    out = materialize(later.select("rid", "i", F.col("depth").alias("n")), "line-runs")
    release(*rounds, stored)
    return out


def dedup(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_lines: int = MIN_LINES,
    long_words: int | None = LONG_WORDS,
) -> DataFrame:
    """The rows of ``docs`` (``row``) with ``kept_text`` and counts of what was deleted:
    n_lines, n_removed, n_runs (maximal runs), longest_run.

    A line goes if it lies in a run of ``min_lines`` lines that also starts
    earlier (smaller id, or same document and earlier line), or, with
    ``long_words``, if the line alone has that many words and stands earlier.
    Everything is judged on the input.  Null text: no lines, kept_text null.
    Texts with fewer lines than ``min_lines`` and no such long line stay.  A null
    id comes first.  Rows with one id and one text are one document and keep what
    the first of them keeps; different texts with one id are different documents,
    ordered by a hash.  Long texts are never cut.  Extra columns stay inside ``row``.
    """
    base = materialize(
        docs.select(
            F.monotonically_increasing_id().alias("_rid"),
            F.xxhash64(F.col(f"`{text_col}`")).alias("_k"),
            F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        ),
        "line-docs",
    )
    ids = base.select(F.col("_rid").alias("rid"), F.col(f"row.`{id_col}`").alias("doc"), F.col("_k").alias("k"))
    # rows with the id and the text of another stand for themselves no more
    again = ids.groupBy("doc", "k").agg(F.min("rid").alias("rep"), F.count("*").alias("c")).filter("c > 1")
    same = ids.alias("x").join(again.alias("y"), F.col("x.doc").eqNullSafe(F.col("y.doc")) & (F.col("x.k") == F.col("y.k")))
    same = materialize(same.select("x.rid", "y.rep").filter("rid <> rep"), "line-copies")
    text = F.col(f"row.`{text_col}`")
    seq = F.filter(F.transform(_lines(text), lambda x: strip(x)), lambda x: x != "")
    n1, n2 = fingerprint(F.col("line"))
    lines = base.select(F.col("_rid").alias("rid"), F.col(f"row.`{id_col}`").alias("doc"), F.col("_k").alias("k"), seq.alias("seq"))
    takes_part, long = F.size("seq") >= min_lines, []
    if long_words is not None:
        # n words have 2 n - 1 characters or more: most lines are not split
        wordy = lambda x: (F.length(x) >= 2 * long_words - 1) & (n_words(x) >= long_words)
        takes_part, long = takes_part | F.exists("seq", wordy), [wordy(F.col("line")).alias("long")]
    lines = lines.filter(takes_part).join(same, "rid", "left_anti").select("rid", "doc", "k", F.posexplode("seq").alias("i", "line"))
    lines = materialize(lines.select(*_SUFFIX, n1.alias("n1"), n2.alias("n2"), *long), "line-ids")
    runs = later_runs(lines.drop("long"), min_lines)
    if long:
        wide = lines.filter("long").drop("long")
        names = wide.groupBy("n1", "n2").agg(F.count("*").alias("c"), F.min(F.struct("doc", "k", "i")).alias("first"))
        names = materialize(names.filter("c > 1").drop("c"), "line-names")
        alone = wide.join(names, ["n1", "n2"]).filter(F.struct("doc", "k", "i") > F.col("first"))
        runs = runs.unionByName(alone.select("rid", "i", F.lit(1).alias("n")))
        runs = runs.groupBy("rid", "i").agg(F.max("n").alias("n"))
    before = Window.partitionBy("rid").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    ends = F.col("i") + F.col("n")
    runs = runs.withColumn("covered", F.coalesce(F.max(ends).over(before), F.lit(0))).filter(ends > F.col("covered"))
    fresh = F.struct(F.greatest("i", "covered").alias("a"), (ends - 1).alias("b"))
    gone = runs.groupBy("rid").agg(F.collect_list(fresh).alias("spans"), F.count("*").alias("n_runs"), F.max("n").cast("long").alias("longest_run"))
    gone = materialize(gone, "line-gone")
    others = same.join(gone, same["rep"] == gone["rid"]).select(same["rid"], "spans", "n_runs", "longest_run")
    gone = gone.unionByName(others).withColumnRenamed("rid", "_rid")
    out = base.join(gone, "_rid", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return out.select("row", _rewrite(text, F.col("spans")).alias("r"), zero("n_runs"), zero("longest_run")).select(
        "row", "r.*", "n_runs", "longest_run"
    )


def _rewrite(text: Column, spans: Column) -> Column:
    """struct(kept_text, n_lines, n_removed); ``spans``: disjoint stretches (a, b) of
    sequence positions to delete, or null.  Linear in the lines."""

    def body(lines: Column) -> Column:
        # the line that each sequence position stands in: blank lines have none
        marks = F.transform(lines, lambda x, i: F.when(strip(x) != "", i).otherwise(-1))

        def cut(at: Column) -> Column:
            places = F.transform(F.flatten(F.transform(spans, lambda p: F.sequence(p["a"], p["b"]))), lambda p: F.get(at, p))
            stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), places)
            kept = F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")
            removed = F.aggregate(spans, F.lit(0).cast("long"), lambda n, p: n + p["b"] - p["a"] + 1)
            return F.struct(
                F.when(spans.isNull(), text).otherwise(kept).alias("kept_text"),
                F.size(at).cast("long").alias("n_lines"),
                F.coalesce(removed, F.lit(0).cast("long")).alias("n_removed"),
            )

        return let(F.filter(marks, lambda m: m >= 0), cut)

    return let(_lines(text), body)


def op7_line_dedup(docs: DataFrame) -> DataFrame:
    out = dedup(docs)
    return out.select(
        F.col("row.doc_id").alias("doc_id"), "n_lines", "n_removed", "n_runs", "longest_run",
        F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"),
    )


def remove_line_runs(
    docs: DataFrame, *, min_lines: int = MIN_LINES, long_words: int | None = LONG_WORDS
) -> DataFrame:
    """``docs`` with the copies (long single lines too) deleted from ``text`` and
    ``n_chars`` brought up to date; documents of which no word is left go, as their lines stand elsewhere."""
    out = dedup(docs, min_lines=min_lines, long_words=long_words).filter("n_removed = 0 or n_removed < n_lines")
    new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    changed = lambda c: F.when(F.col("n_removed") > 0, new[c]).otherwise(F.col(f"row.`{c}`"))
    return out.select(*[changed(c).alias(c) if c in new else F.col(f"row.`{c}`") for c in docs.columns])


OP7_SQL = r"""
with recursive l as (
  select doc_id, pos, l, trim(l, chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||' ') s
  from (select doc_id, unnest(string_split(text, chr(10))) l, generate_subscripts(string_split(text, chr(10)), 1) pos
        from documents)
), q as (
  select *, row_number() over (partition by doc_id order by pos) - 1 i from l where s <> ''
), r as (
  select doc_id, i, 1::bigint h, md5(s) g from q qualify count(*) over (partition by s) > 1
  union all
  select doc_id, i, h, g from (
    select r.doc_id, r.i, h + 1 h, md5(g || q.s) g from r join q on q.doc_id = r.doc_id and q.i = r.i + r.h)
  qualify count(*) over (partition by g) > 1
), f as (
  select doc_id, i, h, row_number() over (partition by h, g order by doc_id, i) rn from r
), p as (
  select f.doc_id, f.i, max(f.h) n from f join q on f.doc_id = q.doc_id and f.i = q.i
  where rn > 1 and (h >= 2 or len(list_filter(regexp_split_to_array(s, '[\x20\x09-\x0D]+'), lambda x: x <> '')) >= 50)
  group by f.doc_id, f.i
), c as (
  select *, coalesce(max(i + n) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) covered from p
), m as (
  select * from c where i + n > covered
), g as (
  select doc_id, unnest(range(greatest(i, covered), i + n)) i from m
), rr as (
  select doc_id, count(*) n_runs, max(n) longest_run from m group by doc_id
), k as (
  select l.doc_id, string_agg(l.l, chr(10) order by l.pos) filter (where g.i is null) t,
    count(q.i) n_lines, count(g.i) n_removed from l
  left join q on l.doc_id = q.doc_id and l.pos = q.pos
  left join g on q.doc_id = g.doc_id and q.i = g.i group by l.doc_id
)
select d.doc_id, coalesce(k.n_lines, 0)::bigint n_lines, coalesce(k.n_removed, 0)::bigint n_removed,
  coalesce(n_runs, 0)::bigint n_runs, coalesce(longest_run, 0)::bigint longest_run, sha256(coalesce(k.t, '')) kept_sha256
from documents d left join rr on d.doc_id = rr.doc_id left join k on d.doc_id = k.doc_id"""
