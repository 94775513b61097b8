"""Quality rules: base rules of one document, then cross-document line frequency.

Plan: one pass turns every document into a narrow row (counts and the hashes of
its normalised lines); those rows are stored once and everything after works on
hashes.  A line's count per host is a partially aggregated ``groupBy``, so a line
that a third of all documents carry never meets in one task; the verdict joins
the few frequent lines back, where adaptive execution can split a hot key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.llm.common import fingerprint, let, materialize, strip, words

#: Characters that count as symbols (fixed values).
SYMBOLS = "#*$%&|<>"

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
LINE_LIMIT = 50
MAX_REMOVED_PERCENT = 50
_WINDOW = 5


def _covered(starts: Column) -> Column:
    """Words covered by windows at the sorted ``starts``."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    return F.aggregate(
        starts,
        zero,
        lambda acc, p: F.struct(
            (p + _WINDOW).alias("end"),
            (acc["n"] + p + _WINDOW - F.greatest(p, acc["end"])).alias("n"),
        ),
        lambda acc: acc["n"],
    )


def repeat_words(ws: Column) -> Column:
    """Words inside 5-word windows that occur twice or more in the same text.

    Hashes find the texts without any repeat; the others compare the windows'
    words themselves, sorted inside the row.
    """
    last = F.size(ws) - _WINDOW

    def exact() -> Column:
        grams = F.transform(
            F.sequence(F.lit(0), last),
            lambda i: F.struct(F.concat_ws(" ", F.slice(ws, i + 1, _WINDOW)).alias("g"), i.alias("p")),
        )
        return let(
            F.sort_array(grams),
            lambda s: _covered(
                F.sort_array(
                    F.transform(
                        F.filter(
                            s,
                            lambda e, i: F.coalesce(F.get(s, i - 1)["g"] == e["g"], F.lit(False))
                            | F.coalesce(F.get(s, i + 1)["g"] == e["g"], F.lit(False)),
                        ),
                        lambda e: e["p"],
                    )
                )
            ),
        )

    hashes = let(
        F.transform(ws, lambda w: F.xxhash64(w)),
        lambda h: F.transform(
            F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(_WINDOW)])
        ),
    )
    repeated = let(hashes, lambda g: F.size(F.array_distinct(g)) < F.size(g))
    return F.when(last < 1, 0).when(repeated, exact()).otherwise(0).cast("long")


def normalised(line: Column) -> Column:
    return F.lower(F.regexp_replace(strip(line), r"[\x20\x09-\x0D]+", " "))


def base_columns(text: Column) -> dict[str, Column]:
    """The counts the base rules read; ``_words`` is a struct to be unpacked."""
    t = F.coalesce(text, F.lit(""))
    chars = lambda gone: F.length(t) - F.length(F.translate(t, gone, ""))
    lines = F.filter(F.split(t, "\n"), lambda x: strip(x) != "")
    return {
        "_w": let(words(t), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeat_words(w).alias("r"))),
        "word_chars": F.length(F.translate(t, " \t\n\x0b\x0c\r", "")).cast("long"),
        "n_symbols": chars(SYMBOLS).cast("long"),
        "_l": let(
            lines,
            lambda ls: F.struct(
                (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("dup"),
                F.transform(ls, lambda x: normalised(x)).alias("norm"),
            ),
        ),
    }


def judge(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    line_limit: int = LINE_LIMIT,
    max_removed_percent: int = MAX_REMOVED_PERCENT,
    carry: bool = False,
) -> DataFrame:
    """One row per input row with counts, ``base_failed`` and ``kept``.

    Base rules: at least 10 words, at most 20 % of them in repeated 5-word
    windows.  Method: a normalised line (trimmed, white space collapsed, lower
    case) that more than ``line_limit`` different documents of one host carry is
    removed everywhere but in the document with the smallest id; a document is
    rejected when fewer than 10 words, or less than half of them, are left.  With
    ``carry`` the text without these lines comes as ``kept_text`` (the text
    itself, null too, where none goes), otherwise their words are only counted.

    Exact copies of a text count as one document, so copies alone never make a
    line frequent.  Null text: no words (base_failed).  Null host is a host of
    its own.  Repeated rows are judged one by one.  With ``carry`` the input row
    comes along as the struct ``row``; other columns are not read.
    """
    t = F.col(f"`{text_col}`")
    base = base_columns(t)
    h1, h2 = fingerprint(F.coalesce(t, F.lit("")))
    host = F.col(f"`{host_col}`")
    row = ["row"] if carry else []
    x = (
        docs.select(
            F.monotonically_increasing_id().alias("_rid"),
            F.col(f"`{id_col}`").alias("doc_id"),
            F.xxhash64(F.coalesce(host, F.lit("")), host.isNull()).alias("_host"),
            h1.alias("_h1"),
            h2.alias("_h2"),
            *[c.alias(k) for k, c in base.items()],
            *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []),
        )
        .select(
            "_rid", "doc_id", "_host", "_h1", "_h2", "word_chars", "n_symbols", *row,
            F.col("_w.n").alias("n_words"), F.col("_w.r").alias("n_repeat_words"), F.col("_l.dup").alias("n_dup_lines"),
            F.transform(
                "_l.norm",
                lambda s: F.struct(
                    F.xxhash64(F.col("_host"), s).alias("key"),
                    (F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit(""))) + 1).alias("w"),
                ),
            ).alias("_lines"),
        )
    )
    x = materialize(x, "quality")
    texts = x.groupBy("_host", "_h1", "_h2").agg(
        F.min("doc_id").alias("doc_id"), F.any_value("_lines").alias("_lines")
    )
    frequent = (
        texts.select("doc_id", F.explode(F.array_distinct(F.transform("_lines", lambda s: s["key"]))).alias("key"))
        .groupBy("key")
        .agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))
        .filter(F.col("n") > line_limit)
    )
    removed = (
        x.select("_rid", "doc_id", F.explode("_lines").alias("s"))
        .select("_rid", "doc_id", F.col("s.key").alias("key"), F.col("s.w").alias("w"))
        .join(frequent.select("key", "first"), "key")
        .filter(~F.col("doc_id").eqNullSafe(F.col("first")))
        .groupBy("_rid")
        .agg(
            F.sum("w").cast("long").alias("n_removed_words"),
            *([F.collect_set("key").alias("_gone")] if carry else []),
        )
    )
    base_failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    )
    gone = F.coalesce("n_removed_words", F.lit(0).cast("long"))
    depleted = (gone > 0) & (
        (F.col("n_words") - gone < MIN_WORDS) | (100 * gone > max_removed_percent * F.col("n_words"))
    )
    if carry:
        text = F.col(f"row.`{text_col}`")
        stays = lambda s: (strip(s) == "") | ~F.array_contains("_gone", F.xxhash64(F.col("_host"), normalised(s)))
        rest = F.array_join(F.filter(F.split(text, "\n"), stays), "\n")
        row.append(F.when(F.col("_gone").isNull(), text).otherwise(rest).alias("kept_text"))
    return x.drop("_lines", "_h1", "_h2").join(removed, "_rid", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        gone.alias("n_removed_words"), base_failed.alias("base_failed"),
        (~base_failed & ~depleted).alias("kept"), *row,
    )


def keep_good(docs: DataFrame, *, line_limit: int = LINE_LIMIT) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with the frequent lines deleted
    from ``text`` and ``n_chars`` brought up to date."""
    judged = judge(docs, line_limit=line_limit, carry=True)
    new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    changed = lambda c: F.when(F.col("n_removed_words") > 0, new[c]).otherwise(F.col(f"row.`{c}`"))
    return judged.filter("kept").select(
        *[changed(c).alias(c) if c in new else F.col(f"row.`{c}`") for c in docs.columns]
    )


def op9_quality_rules(docs: DataFrame) -> DataFrame:
    return judge(docs)


_BASE_SQL = r"""
base as (
  select row_number() over () rid, doc_id, coalesce(text, '') t, source from documents
), w as (
  select *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') ws,
    list_filter(string_split(t, chr(10)), lambda x: trim(x, chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||' ') <> '') ls
  from base
), grams as (
  select rid, p, array_to_string(ws[p:p+4], ' ') g
  from (select rid, ws, unnest(range(1, len(ws) - 3)) p from w)
), hit as (
  select rid, p from grams qualify count(*) over (partition by rid, g) > 1
), rep as (
  select rid, count(distinct q) r from (select rid, unnest(range(p, p + 5)) q from hit) group by rid
), counts as (
  select w.rid, doc_id, source, t, ls, len(ws)::bigint n_words,
    length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::bigint word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint n_symbols,
    (len(ls) - len(list_distinct(ls)))::bigint n_dup_lines, coalesce(r, 0)::bigint n_repeat_words
  from w left join rep on w.rid = rep.rid
), lines as (
  select rid, doc_id, source, t,
    lower(regexp_replace(trim(l, chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||' '), '[\x20\x09-\x0D]+', ' ', 'g')) k
  from (select rid, doc_id, source, t, unnest(ls) l from counts)
), freq as (
  select source, k, min(doc_id) f from lines group by source, k having count(distinct t) > 50
), gone as (
  select rid, sum(len(string_split(l.k, ' ')))::bigint g from lines l join freq
  on l.k = freq.k and l.source is not distinct from freq.source and l.doc_id is distinct from freq.f group by rid
), judged as (
  select c.*, coalesce(g, 0)::bigint n_removed_words,
    n_words < 10 or 100 * n_repeat_words > 20 * n_words base_failed
  from counts c left join gone on c.rid = gone.rid
)"""

OP9_SQL = (
    "with "
    + _BASE_SQL
    + """
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_removed_words, base_failed,
  not base_failed and not (n_removed_words > 0 and (n_words - n_removed_words < 10
    or 100 * n_removed_words > 50 * n_words)) kept
from judged"""
)
