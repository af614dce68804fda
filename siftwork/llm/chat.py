"""Chat formatting by multi-party perspective rotation, in DataFrame functions alone.

For every participant of a conversation the whole dialogue is rendered with that speaker as the
assistant, the others as named users, and system turns as system. The mask lists the stretches of
the assistant's own words. A dialogue comes in parts of PART turn numbers, so that no row grows with
a conversation; parts in order make the dialogue, and offsets of a mask count within its part.

A turn reads "<|role|>\\ntext<|end|>\\n", where role is assistant, system, or user:name.

Defined cases:
- a null role is a participant without a name (""); a null text is empty; turns with a null number
  come in a part of their own (-1), before the others.
- turns of one number are ordered by role and text; repeated rows are repeated turns. All turns of one
  number are in one part, whatever their count; the time for a part is that of sorting its turns.
- texts are not escaped: one that holds a marker looks like a turn, but only the mask tells which words
  are the assistant's.
- rows with a null conv_id are one conversation. A conversation of system turns alone has no
  participant and no row. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import read

PART = 64


def rotate(turns: DataFrame, part: int = PART) -> DataFrame:
    """(conv_id, participant, part, n_turns, text, mask) for every participant and part."""
    rows = turns.select("conv_id", F.coalesce(F.expr(f"CAST(floor(turn / {part}) AS LONG)"), F.lit(-1).cast("long")).alias("part"), F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    parts = rows.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    # Speakers of each part first, then of the conversation: one row for each part is what a hot one has.
    spoke = rows.filter("t.role <> 'system'").groupBy(F.col("conv_id").alias("_conv"), F.col("t.role").alias("participant")).agg(F.lit(1).alias("one")).drop("one")
    every = parts.join(spoke, parts["conv_id"].eqNullSafe(spoke["_conv"])).drop("_conv")
    name = "CASE WHEN t.role = participant THEN 'assistant' WHEN t.role = 'system' THEN 'system' ELSE concat('user:', t.role) END"
    said = every.withColumn("text", F.expr(f"array_join(transform(turns, t -> concat('<|', {name}, '|>\\n', t.text, '<|end|>\\n')), '')"))
    own = _own(rows)
    same = said["conv_id"].eqNullSafe(own["_conv"]) & (said["part"] == own["_part"]) & (said["participant"] == own["_role"])
    mask = F.coalesce("spans", F.array().cast("array<struct<start: bigint, length: bigint>>"))
    return said.join(own, same, "left").select("conv_id", "participant", "part", F.size("turns").cast("long").alias("n_turns"), "text", mask.alias("mask"))


def _own(rows: DataFrame) -> DataFrame:
    """(_conv, _part, _role, spans): where the texts of each speaker stand in a part that is rendered for that speaker.

    These are running sums, so a part costs what it holds, however many turns it has. Before a turn stand all
    turns before it as others see them; each of the speaker's own is headed "assistant" instead of "user:name".
    """
    role, size = F.col("t.role"), F.length("t.text")
    marks = len("<||>\n<|end|>\n")
    seen = F.when(role == "system", F.lit(len("system"))).otherwise(F.length(role) + len("user:")) + size + marks
    order = Window.partitionBy("conv_id", "part").orderBy("t")
    placed = rows.withColumn("i", F.row_number().over(order)).withColumn("before", F.coalesce(F.sum(seen.cast("long")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = placed.filter(role != "system").withColumn("mine", F.row_number().over(Window.partitionBy("conv_id", "part", role).orderBy("i")) - 1)
    start = F.col("before") + F.col("mine") * (len("assistant") - len("user:") - F.length(role)) + len("<|assistant|>\n")
    span = F.struct(start.cast("long").alias("start"), size.cast("long").alias("length"))
    return placed.groupBy(F.col("conv_id").alias("_conv"), F.col("part").alias("_part"), role.alias("_role")).agg(F.array_sort(F.collect_list(span)).alias("spans"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rotate(read(spark, sf_dir, "conversations"))
    return out.withColumn("mask", F.expr("array_join(transform(mask, m -> concat(m.start, '+', m.length)), ',')"))


ORACLE_SQL = r"""
WITH t AS (SELECT conv_id, coalesce(floor(turn / 64)::BIGINT, -1) AS part, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
s AS (SELECT DISTINCT conv_id, role AS participant FROM t WHERE role <> 'system'),
x AS (SELECT t.conv_id, participant, part, turn, role, text,
  '<|' || CASE WHEN role = participant THEN 'assistant' WHEN role = 'system' THEN 'system' ELSE 'user:' || role END || '|>' || chr(10) AS head
  FROM t JOIN s ON t.conv_id IS NOT DISTINCT FROM s.conv_id),
y AS (SELECT *, head || text || '<|end|>' || chr(10) AS said, row_number() OVER w AS i,
  sum(length(head || text || '<|end|>' || chr(10))) OVER w - length(text || '<|end|>' || chr(10)) AS start
  FROM x WINDOW w AS (PARTITION BY conv_id, participant, part ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING))
SELECT conv_id, participant, part, count(*) AS n_turns, string_agg(said, '' ORDER BY i) AS text,
  coalesce(string_agg(start::BIGINT || '+' || length(text), ',' ORDER BY i) FILTER (role = participant), '') AS mask
FROM y GROUP BY conv_id, participant, part
"""
