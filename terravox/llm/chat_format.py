"""Chat formatting: each dialogue from the perspective of every participant.

For each participant of a conversation the whole dialogue is rendered with that speaker as assistant,
the others as named users and system turns as system. A rendering is a sequence of segments, one per
turn, as a conversation has no size limit: laid end to end in the order of ``place`` they are the text.
``start`` and ``stop`` are a segment's code points in that text, ``learn_start`` and ``learn_stop`` those
of the assistant's words and end mark, the part to be learnt; null in all other segments.

Turns are ordered by number, null first, then by the MD5 of speaker and text, speaker and text. Equal
rows are counted once and laid out again at the end. A null or empty role is the speaker ``unknown``, a
null text is empty; a null conversation id is a conversation. A conversation of system turns alone has
one rendering, of perspective null. In names, characters other than letters, digits, "_", "." and "-"
become "_"; "<|" in a text becomes "< |", so that marks cannot be forged. Other columns are not read.

Positions come from sums over (turn block), (turn, hash bucket) and single rows, so that no window holds
a whole conversation, however long; all of it is DataFrame work in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
SYSTEM, UNKNOWN = "system", "unknown"
#: Turns of a block, as a power of two.
BLOCK_BITS = 10
_LEAST = -(1 << 63)


def _join(a: DataFrame, b: DataFrame, names: list[str], how: str = "inner") -> DataFrame:
    """Join on columns where null equals null; the columns come from ``a``."""
    left, right = a.alias("l"), b.select(*[F.col(c).alias(f"_r_{c}") if c in names else F.col(c) for c in b.columns])
    cond = None
    for n in names:
        c = F.col(n).eqNullSafe(F.col(f"_r_{n}"))
        cond = c if cond is None else cond & c
    return left.join(right, cond, how).drop(*[f"_r_{n}" for n in names])


def perspectives(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation, perspective and turn: the segment, its place and the part to learn."""
    speaker = F.when(F.col(role).isNull() | (F.col(role) == ""), UNKNOWN).otherwise(F.col(role))
    rows = df.select(F.col(conv).alias("conv_id"), F.col(turn).cast("bigint").alias("turn"), speaker.alias("speaker"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # Equal rows as one with a count: copies cannot crowd one window.
    rows = rows.groupBy("conv_id", "turn", "speaker", "text").agg(F.count("*").alias("copies"))
    rows = rows.withColumn("hash", F.md5(F.concat_ws("\n", "speaker", "text"))).withColumn("ord", F.coalesce("turn", F.lit(_LEAST)))
    rows = rows.withColumn("block", F.shiftright("ord", BLOCK_BITS)).withColumn("bucket", F.substring("hash", 1, 3))

    people = rows.filter(F.col("speaker") != SYSTEM).select("conv_id", F.col("speaker").alias("perspective")).distinct()
    seg = _join(rows, people, ["conv_id"], "left")
    own = F.coalesce(F.col("speaker") == F.col("perspective"), F.lit(False))
    kind = F.when(F.col("speaker") == SYSTEM, SYSTEM).when(own, "assistant").otherwise("user")
    name = F.when(F.col("role") == "user", F.regexp_replace("speaker", r"[^\p{L}\p{N}_.-]", "_"))
    seg = seg.withColumn("role", kind).withColumn("name", name)
    head = F.concat(F.lit(OPEN), F.col("role"), F.coalesce(F.concat(F.lit(" name="), F.col("name")), F.lit("")), F.lit("\n"))
    seg = seg.withColumn("head", F.length(head)).withColumn("segment", F.concat(head, F.replace(F.col("text"), F.lit("<|"), F.lit("< |")), F.lit(CLOSE)))
    seg = seg.withColumn("size", F.length("segment").cast("bigint")).drop("text")

    who, fine = ["conv_id", "perspective"], ["conv_id", "perspective", "block", "ord", "bucket"]
    cells = seg.groupBy(*fine).agg(F.sum(F.col("size") * F.col("copies")).alias("chars"), F.sum("copies").alias("turns"))
    blocks = cells.groupBy(*who, "block").agg(F.sum("chars").alias("chars"), F.sum("turns").alias("turns"))

    def before(part: list[str], order: list[str], what: Column) -> Column:
        w = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(what).over(w), F.lit(0))

    blocks = blocks.select(*who, "block", before(who, ["block"], F.col("chars")).alias("chars0"), before(who, ["block"], F.col("turns")).alias("turns0"))
    inner, order = [*who, "block"], ["ord", "bucket"]
    cells = cells.select(*fine, before(inner, order, F.col("chars")).alias("chars1"), before(inner, order, F.col("turns")).alias("turns1"))
    cells = _join(cells, blocks, inner)
    seg = _join(seg, cells, fine)
    row_order = ["hash", "speaker", "segment"]
    seg = seg.withColumn("chars2", before(fine, row_order, F.col("size") * F.col("copies"))).withColumn("turns2", before(fine, row_order, F.col("copies")))
    seg = seg.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1)))
    start = F.col("chars0") + F.col("chars1") + F.col("chars2") + F.col("copy") * F.col("size")
    seg = seg.withColumn("start", start).withColumn("place", F.col("turns0") + F.col("turns1") + F.col("turns2") + F.col("copy") + 1)
    learnt = F.col("role") == "assistant"
    return seg.select(
        "conv_id", "perspective", "place", "turn", "role", "name", "segment", "start", (F.col("start") + F.col("size")).alias("stop"),
        F.when(learnt, F.col("start") + F.col("head")).alias("learn_start"), F.when(learnt, F.col("start") + F.col("size") - 1).alias("learn_stop"),
    )


SQL = """
WITH t AS (SELECT conv_id, CAST(turn AS BIGINT) AS turn, CASE WHEN role IS NULL OR role = '' THEN 'unknown' ELSE role END AS speaker, coalesce(text, '') AS body FROM conversations),
p AS (SELECT DISTINCT conv_id AS c, speaker AS perspective FROM t WHERE speaker <> 'system'),
s AS (SELECT t.*, perspective, md5(speaker || chr(10) || body) AS h,
        CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS role
      FROM t LEFT JOIN p ON t.conv_id IS NOT DISTINCT FROM p.c),
n AS (SELECT *, CASE WHEN role = 'user' THEN regexp_replace(speaker, '[^\\p{L}\\p{N}_.-]', '_', 'g') END AS name FROM s),
g AS (SELECT *, '<|im_start|>' || role || coalesce(' name=' || name, '') || chr(10) AS head, replace(body, '<|', '< |') || '<|im_end|>' || chr(10) AS rest FROM n),
o AS (SELECT *, head || rest AS segment, row_number() OVER w AS place,
        coalesce(sum(length(head || rest)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
      FROM g WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, h, speaker, body))
SELECT conv_id, perspective, place, turn, role, name, segment, CAST(start AS BIGINT) AS start,
  CAST(start + length(segment) AS BIGINT) AS stop,
  CASE WHEN role = 'assistant' THEN CAST(start + length(head) AS BIGINT) END AS learn_start,
  CASE WHEN role = 'assistant' THEN CAST(start + length(segment) - 1 AS BIGINT) END AS learn_stop
FROM o
"""
