"""Chat formatting by multi-party perspective rotation, in DataFrame operations only.

For every participant of a conversation the dialogue is rendered with that speaker as the assistant and all others
as named users; the mask covers what the assistant says. A row of the result is one turn seen by one participant,
with its place in that rendering, so no conversation has to fit into a task: turns are sorted by range, cut into runs of
`block` rows, and what stands before each run is summed up. The rendering is the segments in the order of `position`.

Turns are ordered by turn (null first), speaker and text; repeated rows are turns each (ties, which are cut by rows as all
others). A null or empty role is the speaker "unknown". System turns are shown as such and are no participants; a conversation
of system turns alone gives no rows. Null texts count as empty; very long ones are turns like others; rows without conv_id form
one conversation. Header marks inside texts, and marks and line ends inside speakers' names, are broken up, so that
neither can begin a turn. Other columns, whatever their names, are not read. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstead.llm.common import materialize

END = "<|end|>\n"
#: Turns are dealt by runs of so many rows.
BLOCK = 512


def shown_name(speaker: Column) -> Column:
    """A name that can't end its header."""
    marks = F.replace(F.replace(speaker, F.lit("<|"), F.lit("< |")), F.lit("|>"), F.lit("| >"))
    return F.translate(marks, "\n\r", "  ")


def header(role: Column, speaker: Column) -> Column:
    return F.when(role == "user", F.concat(F.lit("<|user name="), shown_name(speaker), F.lit("|>\n"))).otherwise(F.concat(F.lit("<|"), role, F.lit("|>\n")))


def seen_role(speaker: Column, perspective: Column) -> Column:
    return F.when(speaker == "system", "system").when(speaker == perspective, "assistant").otherwise("user")


def rotate(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv_id, perspective, position, turn, speaker, role, segment, start, mask_start, mask_end, trained.

    start and the mask count characters of the whole rendering; the mask ends before the last line end.
    """
    speaker = F.coalesce(F.nullif("role", F.lit("")), F.lit("unknown"))
    turns = conversations.select(
        F.coalesce("conv_id", F.lit(0)).alias("_c"), F.col("conv_id").isNull().alias("_n"), "turn", speaker.alias("speaker"),
        F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("< |")).alias("text"),
        F.monotonically_increasing_id().alias("_i"),
    )
    # equal rows differ by _i, so that no run of them is one range
    keys = ("_c", "_n", F.col("turn").asc_nulls_first(), "speaker", "text", "_i")
    row = F.monotonically_increasing_id()
    turns = materialize(turns.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_i").withColumn("_k", row).withColumn("_b", F.floor(F.col("_k") / block)))
    heard = turns.groupBy("_c", "_n", "_b", "speaker").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
    people = heard.where(F.col("speaker") != "system").select("_c", "_n", F.col("speaker").alias("perspective")).distinct()
    role = seen_role(F.col("speaker"), F.col("perspective"))
    extra = F.length(header(role, F.col("speaker"))) + len(END)
    # how much each run of turns holds, and from that what stands before it: a row for 512 turns
    sized = heard.join(people, ["_c", "_n"]).groupBy("_c", "_n", "_b", "perspective").agg(F.sum("n").alias("n"), F.sum(F.col("chars") + F.col("n") * extra).alias("chars"))
    earlier = Window.partitionBy("_c", "_n", "perspective").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    bases = sized.select("_c", "_n", "_b", "perspective", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n0"), F.coalesce(F.sum("chars").over(earlier), F.lit(0)).alias("chars0"))
    segment = F.concat(header(F.col("seen"), F.col("speaker")), "text", F.lit(END))
    shown = turns.join(bases, ["_c", "_n", "_b"]).withColumn("seen", role).withColumn("segment", segment)
    inside = Window.partitionBy("_c", "_n", "_b", "perspective").orderBy("_k")
    before = F.coalesce(F.sum(F.length("segment")).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = shown.withColumn("position", F.col("n0") + F.row_number().over(inside) - 1).withColumn("start", F.col("chars0") + before)
    own = F.col("seen") == "assistant"
    return placed.select(
        F.when(~F.col("_n"), F.col("_c")).alias("conv_id"), "perspective", "position", "turn", "speaker", F.col("seen").alias("role"), "segment", "start",
        F.when(own, F.col("start") + F.length(header(F.col("seen"), F.col("speaker")))).alias("mask_start"),
        F.when(own, F.col("start") + F.length("segment") - 1).alias("mask_end"),
        own.alias("trained"),
    )


ROTATE_SQL = """
WITH turns AS (
  SELECT conv_id, turn, coalesce(nullif(role, ''), 'unknown') AS speaker, replace(coalesce(text, ''), '<|', '< |') AS said FROM conversations
), people AS (
  SELECT DISTINCT conv_id, speaker AS perspective FROM turns WHERE speaker <> 'system'
), seen AS (
  SELECT t.conv_id, p.perspective, t.turn, t.speaker, t.said,
         CASE WHEN t.speaker = 'system' THEN 'system' WHEN t.speaker = p.perspective THEN 'assistant' ELSE 'user' END AS role
  FROM turns t JOIN people p ON t.conv_id IS NOT DISTINCT FROM p.conv_id
), headed AS (
  SELECT *, CASE WHEN role = 'user' THEN '<|user name=' || translate(replace(replace(speaker, '<|', '< |'), '|>', '| >'), chr(10) || chr(13), '  ') || '|>' || chr(10) ELSE '<|' || role || '|>' || chr(10) END AS head FROM seen
), segments AS (
  SELECT *, head || said || '<|end|>' || chr(10) AS segment FROM headed
), placed AS (
  SELECT *, row_number() OVER w - 1 AS position, CAST(sum(length(segment)) OVER w AS BIGINT) - length(segment) AS start
  FROM segments WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, said ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
)
SELECT conv_id, perspective, position, turn, speaker, role, segment, start,
       CASE WHEN role = 'assistant' THEN start + length(head) END AS mask_start,
       CASE WHEN role = 'assistant' THEN start + length(segment) - 1 END AS mask_end,
       role = 'assistant' AS trained
FROM placed
"""
