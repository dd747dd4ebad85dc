"""Multi-party perspective rotation: every dialogue once for each participant, who speaks as the assistant.

DataFrame functions only. In a participant's rendering, their own messages are the assistant's, other participants are
users with their names, and narrators (such as "system") stay what they are and get no rendering of their own. The mask
holds the character spans that are to be learnt: the assistant's texts with their end marks.

A rendering comes in parts of PART_MESSAGES consecutive messages of the dialogue (the last has the rest), so that no task
gathers a whole dialogue, however long. Parts in order, joined, are the whole rendering: first_char says where a part begins
in it, and mask spans count from its beginning. Places in dialogues of more than one part come from counts per distinct message, sorted by
range and added up over RUN_MESSAGES distinct messages at a time, so that no task holds a whole dialogue or a whole group of
equal messages; where a part begins comes from counts per part and speaker, not from texts.

Defined cases: messages go by turn (nulls last), then speaker, then text; a null speaker is "unknown"; a null text is empty;
a null conversation id is a conversation; a dialogue of narrators only has no rendering; repeated messages are rendered as
often as they occur; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .storage import cut

PART_MESSAGES = 1_024
#: Distinct messages of long dialogues, on average, whose places one task counts.
RUN_MESSAGES = 16_384
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _heading(role: Column, me: Column, narrators: Sequence[str]) -> Column:
    named = F.when(role == me, F.lit("assistant")).when(role.isin(*narrators), role).otherwise(F.concat(F.lit("user name="), role))
    return F.concat(F.lit(OPEN), named, F.lit("\n"))


def _same(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> Column:
    """Equal keys, nulls included; b has them with an underscore before."""
    out = F.lit(True)
    for k in keys:
        out &= a[k].eqNullSafe(b[f"_{k}"])
    return out


def _keyed(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.withColumnsRenamed({k: f"_{k}" for k in keys})


def _placed(kinds: DataFrame, part_messages: int, run_messages: int) -> DataFrame:
    """conv_id, part, turn, role, text and times: kinds (distinct messages with their times) cut into parts in their order."""
    order = [F.col("turn").asc_nulls_last(), F.col("role"), F.col("text")]
    runs = max(1, -(-kinds.count() // run_messages))
    kinds = cut(kinds.repartitionByRange(runs, "conv_id", *order).withColumn("run", F.spark_partition_id()), "runs")
    # Messages of a dialogue before each run, from a row for each run and dialogue.
    sums = kinds.groupBy("run", "conv_id").agg(F.sum("times").alias("n"))
    before = _keyed(sums.select("run", "conv_id", (F.sum("n").over(W.partitionBy("conv_id").orderBy("run")) - F.col("n")).alias("before")), ["run", "conv_id"])
    within = F.sum("times").over(W.partitionBy("run", "conv_id").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("times")
    kinds = kinds.withColumn("within", within)
    placed = kinds.join(before, _same(kinds, before, ["run", "conv_id"])).withColumn("first", F.col("before") + F.col("within"))
    size = F.lit(part_messages).cast("long")
    last = F.col("first") + F.col("times") - 1
    placed = placed.withColumn("part", F.explode(F.sequence(F.floor(F.col("first") / size), F.floor(last / size))))
    own = F.least(last, (F.col("part") + 1) * size - 1) - F.greatest(F.col("first"), F.col("part") * size) + 1
    return placed.select("conv_id", "part", "turn", "role", "text", own.cast("long").alias("times"))


def _views(placed: DataFrame, speakers: DataFrame, narrators: Sequence[str]) -> DataFrame:
    """conv_id, part, perspective and first_char of every rendered part of the long dialogues in placed.

    A message is as long in all perspectives but its speaker's, so that lengths come from counts per part and speaker.
    """
    role, me = F.col("role"), F.col("perspective")
    foreign = F.length(_heading(role, F.lit(None).cast("string"), narrators)) + F.length(F.concat("text", F.lit(CLOSE))) + 1
    by_speaker = cut(placed.groupBy("conv_id", "part", "role").agg(F.sum("times").alias("n"), F.sum(foreign * F.col("times")).alias("chars")), "lengths")
    parts = by_speaker.groupBy("conv_id", "part").agg(F.sum("chars").alias("chars"))
    speakers = _keyed(speakers, ["conv_id"])
    both = parts.join(speakers, _same(parts, speakers, ["conv_id"])).select("conv_id", "part", "chars", "perspective")
    own = _keyed(by_speaker.select("conv_id", "part", F.col("role").alias("perspective"), F.col("n").alias("n_own")), ["conv_id", "part", "perspective"])
    both = both.join(own, _same(both, own, ["conv_id", "part", "perspective"]), "left")
    shorter = F.length(_heading(me, F.lit(None).cast("string"), narrators)) - F.length(_heading(me, me, narrators))
    chars = F.col("chars") - F.coalesce("n_own", F.lit(0)) * shorter
    before = F.sum(chars).over(W.partitionBy("conv_id", "perspective").orderBy("part")) - chars
    return both.select("conv_id", "part", "perspective", before.cast("long").alias("first_char"))


def rotate(messages: DataFrame, narrators: Sequence[str] = ("system",), part_messages: int = PART_MESSAGES, run_messages: int = RUN_MESSAGES) -> DataFrame:
    """conv_id, perspective, part, first_char, n_messages, text and mask (array of first, last) of each part of each rendering."""
    rows = messages.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("unknown")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    by_speaker = cut(rows.groupBy("conv_id", "role").count(), "speakers")
    long = _keyed(by_speaker.groupBy("conv_id").agg(F.sum("count").alias("n")).filter(F.col("n") > part_messages).select("conv_id"), ["conv_id"])
    here = _same(rows, long, ["conv_id"])
    speakers = by_speaker.filter(~F.col("role").isin(*narrators)).select("conv_id", F.col("role").alias("perspective"))
    short = rows.join(long, here, "left_anti").select("conv_id", F.lit(0).cast("long").alias("part"), "turn", "role", "text", F.lit(1).cast("long").alias("times"))
    kinds = cut(rows.join(long, here, "left_semi").groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("times")), "kinds")
    placed = cut(_placed(kinds, part_messages, run_messages), "placed")
    in_long = _same(speakers, long, ["conv_id"])
    views = speakers.join(long, in_long, "left_anti").select("conv_id", F.lit(0).cast("long").alias("part"), "perspective", F.lit(0).cast("long").alias("first_char"))
    views = _keyed(views.union(_views(placed, speakers.join(long, in_long, "left_semi"), narrators)), ["conv_id", "part"])
    message = F.struct(F.col("turn").isNull().alias("late"), "turn", "role", "text", "times")
    parts = short.union(placed).groupBy("conv_id", "part").agg(F.array_sort(F.collect_list(message)).alias("messages"))
    parts = parts.withColumn("messages", F.flatten(F.transform("messages", lambda m: F.array_repeat(m, m["times"].cast("int")))))
    both = parts.join(views, _same(parts, views, ["conv_id", "part"]))
    me = F.col("perspective")
    shown = F.transform("messages", lambda m: F.struct(_heading(m["role"], me, narrators).alias("head"), F.concat(m["text"], F.lit(CLOSE)).alias("body"), (m["role"] == me).alias("own")))
    both = both.select("conv_id", "perspective", "part", "first_char", F.size("messages").cast("long").alias("n_messages"), shown.alias("shown"))
    start = F.struct(F.col("first_char").alias("at"), F.array().cast("array<struct<first: bigint, last: bigint>>").alias("spans"))

    def step(acc: Column, m: Column) -> Column:
        first = acc["at"] + F.length(m["head"])
        last = first + F.length(m["body"])
        spans = F.when(m["own"], F.concat(acc["spans"], F.array(F.struct(first.alias("first"), last.alias("last"))))).otherwise(acc["spans"])
        return F.struct((last + 1).alias("at"), spans.alias("spans"))

    text = F.concat_ws("", F.transform("shown", lambda m: F.concat(m["head"], m["body"], F.lit("\n"))))
    return both.select("conv_id", "perspective", "part", "first_char", "n_messages", text.alias("text"), F.aggregate("shown", start, step)["spans"].alias("mask"))


def mask_text() -> Column:
    """The mask as text: first-last of each span, with commas."""
    return F.array_join(F.transform("mask", lambda s: F.concat(s["first"].cast("string"), F.lit("-"), s["last"].cast("string"))), ",")


ORACLE_SQL = f"""
WITH m AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text) - 1 AS place FROM m),
s AS (SELECT DISTINCT conv_id, role AS perspective FROM m WHERE role <> 'system'),
r AS (
  SELECT n.conv_id, perspective, place, place // {PART_MESSAGES} AS part, text, role = perspective AS own,
    '<|im_start|>' || CASE WHEN role = perspective THEN 'assistant' WHEN role = 'system' THEN role ELSE 'user name=' || role END || chr(10) AS head,
    text || '<|im_end|>' AS body
  FROM n JOIN s ON n.conv_id IS NOT DISTINCT FROM s.conv_id),
o AS (
  SELECT *, CAST(coalesce(sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, perspective ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pos
  FROM r)
SELECT conv_id, perspective, part, min(pos) AS first_char, count(*) AS n_messages,
  string_agg(head || body || chr(10), '' ORDER BY place) AS text,
  coalesce(string_agg(CAST(pos + length(head) AS VARCHAR) || '-' || CAST(pos + length(head) + length(body) AS VARCHAR), ',' ORDER BY place) FILTER (WHERE own), '') AS mask
FROM o GROUP BY conv_id, perspective, part
"""
