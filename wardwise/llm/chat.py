"""Chat formatting, with cumulative snapshots collapsed first.

Clients that log a conversation after every turn leave many logs that are each
a prefix of a longer one. Every turn gets a rolling hash of all turns up to it:
the exclusive or of one digest per turn, which holds the turn's place, role and
text (two words of 60 bits of SHA-256). A conversation whose last hash is a
hash *inside* another one is its prefix; an anti-join keeps the maximal ones,
and of equal conversations the one with the smallest id. Only these are rendered.

Built-in functions only. A conversation becomes one string, so its turns meet in
one task; no other group does: equal prefixes are combined before they move.

Turns are ordered by ``turn`` (nulls first), role and text; exact repeats of a
turn count once. Null roles and texts are empty strings. Rows without a
``conv_id`` belong to no conversation and are not rendered. Other columns are
ignored, an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

OPEN, BREAK, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"


def _word(digest: Column, nth: int) -> Column:
    return F.conv(F.substring(digest, 1 + 15 * nth, 15), 16, 10).cast("long")


def turns(df: DataFrame) -> DataFrame:
    """(conv_id, at, last, role, text, h0, h1): turns in place, with their prefix hashes."""
    clean = (
        df.where(F.col("conv_id").isNotNull())
        .select(
            "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
        )
        .repartition("conv_id")
        .dropDuplicates()
    )
    whole = Window.partitionBy("conv_id")
    order = whole.orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    content = F.concat_ws(":", F.col("at").cast("string"), F.length("role").cast("string"), "role", "text")
    return (
        clean.withColumn("at", F.row_number().over(order))
        .withColumn("_d", F.sha2(content, 256))
        .withColumn("h0", F.bit_xor(_word(F.col("_d"), 0)).over(so_far))
        .withColumn("h1", F.bit_xor(_word(F.col("_d"), 1)).over(so_far))
        .withColumn("last", F.max("at").over(whole))
        .select("conv_id", "at", "last", "role", "text", "h0", "h1")
    )


def maximal(placed: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_logs): conversations that no other extends, once each.

    ``n_logs`` counts the logs of exactly this conversation.
    """
    ends = placed.where(F.col("at") == F.col("last")).groupBy("at", "h0", "h1").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_logs")
    )
    inside = placed.where(F.col("at") < F.col("last")).select("at", "h0", "h1").distinct()
    return ends.join(inside, ["at", "h0", "h1"], "left_anti").select(
        "conv_id", F.col("at").cast("long").alias("n_turns"), "n_logs"
    )


def render(placed: DataFrame, kept: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_logs, text): the kept conversations, turn by turn."""
    turn = F.concat(F.lit(OPEN), F.col("role"), F.lit(BREAK), F.col("text"), F.lit(CLOSE))
    texts = placed.select("conv_id", F.struct("at", turn.alias("turn")).alias("_t")).groupBy("conv_id").agg(
        F.array_sort(F.collect_list("_t")).alias("_t")
    )
    return kept.join(texts, "conv_id").select("conv_id", "n_turns", "n_logs", F.array_join("_t.turn", "").alias("text"))


def formatted(df: DataFrame) -> DataFrame:
    """Collapse snapshots, then render what is left."""
    placed = turns(df)
    return render(placed, maximal(placed))


ORACLE = """
with t as (
  select distinct conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text
  from conversations where conv_id is not null
), o as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as pos from t
), p as (
  select conv_id, pos, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '')
    over (partition by conv_id order by pos) as text,
    count(*) over (partition by conv_id) as last
  from o
), w as (
  select min(conv_id) as conv_id, pos as n_turns, count(*) as n_logs, text from p where pos = last group by pos, text
)
select conv_id, n_turns, n_logs, text from w
where not exists (select 1 from p where p.pos < p.last and p.pos = w.n_turns and p.text = w.text)
"""
