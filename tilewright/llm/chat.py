"""Chat formatting in budgeted windows.

Prefix sums of the turns' tokens cut a conversation into turn-aligned spans: a
span holds the turns that lie inside one stretch of ``budget`` tokens, and a turn
that crosses the end of a stretch is a span by itself, so no span is over the
budget unless one turn is.  A window is the system turn, the turns that end the
spans before (as many as ``history`` tokens hold) and the span itself.  Only
assistant turns of the span are targets; what is repeated is masked.

Template: ``<|turn|>role<|text|>text<|end|>`` and a line feed for each turn.
Inside roles and texts ``\\``, ``<`` and ``[`` become ``\\e``, ``\\l`` and ``\\s``,
so that no control string of this template or of others with such brackets can
stand in a text; ``unescape`` gives the text back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tilewright.llm.common import let, n_words

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>\n"
#: Tokens that a turn's control strings take.
OVERHEAD = 3
BUDGET = 512
HISTORY = 128


def _swap(text: Column, pairs) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def escape(text: Column) -> Column:
    return _swap(text, (("\\", "\\e"), ("<", "\\l"), ("[", "\\s")))


def unescape(text: Column) -> Column:
    return _swap(text, (("\\s", "["), ("\\l", "<"), ("\\e", "\\")))


def windows(
    turns: DataFrame,
    *,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    budget: int = BUDGET,
    history: int = HISTORY,
) -> DataFrame:
    """conv_id, window, text, segments: one row per window.

    ``segments``: i (turn's place in the conversation), at, role_len, text_len
    (code points; the role stands after TURN, the text after TEXT), loss, repeat.

    Turns are ordered by turn, then role, then text (ties, repeated rows).  Null
    role or text: empty.  A null conversation id is a conversation.  Extra
    columns are not read.  A long conversation has many windows, each of bounded
    size unless one turn is over the budget or the system turn is long: the budget
    bounds the span, and history and system turn come on top.
    """
    rows = turns.select(
        F.col(f"`{conv_col}`").alias("conv_id"),
        F.col(f"`{turn_col}`").alias("turn"),
        F.coalesce(F.col(f"`{role_col}`"), F.lit("")).alias("role"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"),
    ).withColumn("tok", n_words(F.col("text")) + OVERHEAD)
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    upto = F.sum("tok").over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("i", F.row_number().over(order) - 1).withColumn("end", upto)
    rows = rows.withColumn("start", F.col("end") - F.col("tok"))
    stretch = F.floor(F.col("start") / budget)
    crosses = (F.floor((F.col("end") - 1) / budget) > stretch).cast("long")
    rows = rows.select(
        "conv_id", "start", (2 * stretch + crosses).alias("span"), (F.col("role") == "system").alias("system"),
        F.struct(
            "i", escape(F.col("role")).alias("role"), escape(F.col("text")).alias("text"), (F.col("role") == "assistant").alias("loss"), "start",
        ).alias("t"),
    )
    # each turn's history holds at most ``history`` tokens, so at most that many turns
    by_start = Window.partitionBy("conv_id").orderBy("start")
    rows = rows.withColumn("new", ~F.lag("span").over(by_start).eqNullSafe(F.col("span")))
    past = F.collect_list("t").over(by_start.rangeBetween(-history, -1))
    rows = rows.withColumn("past", F.when(F.col("new"), past))
    spans = rows.groupBy("conv_id", "span").agg(
        F.sort_array(F.collect_list("t")).alias("own"), F.sort_array(F.flatten(F.collect_list("past"))).alias("past")
    )
    system = rows.filter("system").groupBy("conv_id").agg(F.min("t").alias("sys"))
    spans = spans.alias("x").join(system.alias("y"), F.col("x.conv_id").eqNullSafe(F.col("y.conv_id")), "left")
    first = F.col("own")[0]
    apart = F.col("sys").isNotNull() & (F.col("sys.start") < first["start"] - history)
    lead = F.when(apart, F.array("sys")).otherwise(F.array().cast("array<struct<i:int,role:string,text:string,loss:boolean,start:bigint>>"))
    convs = spans.select("x.conv_id", "span", first["i"].alias("from"), F.concat(lead, "past", "own").alias("segs"))
    fixed = len(TURN) + len(TEXT) + len(END)
    size = lambda s: F.length(s["role"]) + F.length(s["text"]) + fixed
    text = F.array_join(
        F.transform("segs", lambda s: F.concat(F.lit(TURN), s["role"], F.lit(TEXT), s["text"], F.lit(END))), ""
    )
    segments = let(
        F.transform("segs", size),
        lambda n: F.transform(
            "segs",
            lambda s, k: F.struct(
                s["i"].alias("i"),
                F.aggregate(F.slice(n, F.lit(1), k), F.lit(0), lambda a, b: a + b).alias("at"),
                F.length(s["role"]).alias("role_len"),
                F.length(s["text"]).alias("text_len"),
                (s["loss"] & (s["i"] >= F.col("from"))).alias("loss"),
                (s["i"] < F.col("from")).alias("repeat"),
            ),
        ),
    )
    return convs.select("conv_id", F.col("span").alias("window"), text.alias("text"), segments.alias("segments"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (i, role, text, loss in order, each once), formatted_chars.
    A conversation's turns stand in one row, as a digest over all of them needs."""
    one = formatted.select("conv_id", "text", F.length("text").alias("chars"), F.filter("segments", lambda s: ~s["repeat"]).alias("segs"))
    role_at = lambda s: s["at"] + len(TURN) + 1
    text_at = lambda s: s["at"] + len(TURN) + s["role_len"] + len(TEXT) + 1
    turns = F.transform(
        "segs",
        lambda s: F.struct(
            s["i"].alias("i"),
            unescape(F.substring(F.col("text"), role_at(s), s["role_len"])).alias("role"),
            unescape(F.substring(F.col("text"), text_at(s), s["text_len"])).alias("text"),
            s["loss"].alias("loss"),
        ),
    )
    return (
        one.select("conv_id", "chars", turns.alias("turns"))
        .groupBy("conv_id")
        .agg(F.sort_array(F.flatten(F.collect_list("turns"))).alias("turns"), F.sum("chars").alias("formatted_chars"))
    )


def op5_chat_formatting(conversations: DataFrame) -> DataFrame:
    said = F.lit("</s>[INST] ok [/INST]").alias("text")
    one = lambda turn, role: F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(turn).cast("long").alias("turn"), F.lit(role).alias("role"), said)
    extra = conversations.sparkSession.range(1).select(F.inline(F.array(one(0, "user"), one(1, "assistant"))))
    rows = conversations.select("conv_id", "turn", "role", "text").unionByName(extra)
    back = read_back(windows(rows))
    all_text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: t["text"]), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(all_text, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )


OP5_SQL = r"""
with r as (
  select conv_id, turn, coalesce(role, '') role, coalesce(text, '') text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), k as (
  select *, len(list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '')) + 3 tok,
    row_number() over (partition by conv_id order by turn, role, text) - 1 i,
    length(role) + length(text) + (length(text) - length(regexp_replace(text, '[\\<\[]', '', 'g')))
      + (length(role) - length(regexp_replace(role, '[\\<\[]', '', 'g'))) + 24 chars from r
), p as (
  select *, sum(tok) over (partition by conv_id order by i) e from k
), s as (
  select *, e - tok b, 2 * floor((e - tok) / 512) + case when floor((e - 1) / 512) > floor((e - tok) / 512) then 1 else 0 end span,
    min(case when role = 'system' then i end) over (partition by conv_id) sys from p
), w as (
  select conv_id, span, min(i) fi, min(b) fb, any_value(sys) sys from s group by conv_id, span
), f as (
  select w.conv_id, sum(chars)::bigint formatted_chars from w join s on w.conv_id = s.conv_id
    and (s.span = w.span or (s.i < w.fi and (s.i = w.sys or s.b >= w.fb - 128))) group by w.conv_id
)
select s.conv_id, count(*) n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by i)) turns_sha256,
  coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint loss_chars,
  sha256(coalesce(string_agg(text, '' order by i) filter (where role = 'assistant'), '')) loss_sha256,
  any_value(formatted_chars) formatted_chars
from s join f on s.conv_id = f.conv_id group by s.conv_id"""
