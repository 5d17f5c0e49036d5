"""Multi-party perspective rotation: one rendering of a dialogue for each participant.

In a participant's rendering their turns are the assistant's, other participants are users under their names, and turns
of fixed roles (system) stay as they are. The mask marks the assistant's text: `turn_mask` by turn, `spans` by
characters of the dialogue's rendering.

Rows are grouped by conversation and by segments of BLOCK turn numbers. A segment of more than CROWD rows (equal or missing
turn numbers) is cut into parts, by turn number and then by ranges of the md5 of role and text, so no group grows with the
table. Every participant of the dialogue has all its segments and parts, spoken in or not; these in order, joined, are the
dialogue's rendering, and spans go on from one to the next. Only DataFrame functions are used.

Defined results: turns go by number (null numbers first, in the first segment), then, in a crowded segment, by part, then
by role and text; repeated rows are repeated turns; a null or empty text is an empty turn; a null role speaks as "unknown";
markers in a text or role are escaped ("<|im_" becomes "<\\|im_"), as are line breaks in a role, so neither can forge a turn;
rows without a conversation form a dialogue for each role and text; a dialogue without participants (system only) has no
rendering.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinespark.llm.common import stored

BLOCK, CROWD, FIXED_ROLES = 256, 1024, ("system",)
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
MARK, ESCAPED = "<|im_", "<\\|im_"
_DIALOGUE = ["conv_id", "alone"]
_GROUP = [*_DIALOGUE, "segment", "number", "part"]


def rotate(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", block: int = BLOCK, crowd: int = CROWD, fixed_roles: tuple[str, ...] = FIXED_ROLES) -> DataFrame:
    """(conv_id, segment, part, speaker, n_turns, n_target, rendered, turn_mask, spans) of every group for every participant of the dialogue.

    A participant's segments and parts in order, joined, are the dialogue's rendering; spans count characters in that.
    """
    role = F.replace(F.translate(F.coalesce(turns[role_col].cast("string"), F.lit("unknown")), "\r\n", "  "), F.lit(MARK), F.lit(ESCAPED))
    text = F.replace(F.coalesce(turns[text_col].cast("string"), F.lit("")), F.lit(MARK), F.lit(ESCAPED))
    rows = turns.select(turns[conv_col].alias("conv_id"), F.coalesce(F.floor(turns[turn_col] / block), F.lit(0)).cast("long").alias("segment"), turns[turn_col].cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    rows = rows.withColumn("alone", F.when(F.col("conv_id").isNull(), F.sha2(F.concat_ws(":", "role", "text"), 256)))
    rows = in_parts(rows, block, crowd)
    grouped = rows.groupBy(*_GROUP).agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    # array_sort puts null turn numbers first inside a struct, as documented
    each = joined(grouped, starts(rows, fixed_roles), _GROUP)

    def head(t):
        return F.concat(F.lit(OPEN), F.when(t["role"] == F.col("speaker"), F.lit("assistant\n")).when(t["role"].isin(*fixed_roles), F.concat(t["role"], F.lit("\n"))).otherwise(F.concat(F.lit("user name="), t["role"], F.lit("\n"))))

    parts = each.withColumn("parts", F.transform("turns", lambda t: F.struct(head(t).alias("head"), t["text"].alias("text"), (t["role"] == F.col("speaker")).alias("target"))))
    spans = F.aggregate(
        "parts",
        F.struct(F.col("start").alias("at"), F.array().cast("array<string>").alias("spans")),
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p["head"]) + F.length(p["text"]) + len(CLOSE) + 1).alias("at"),
            F.when(p["target"], F.concat(acc["spans"], F.array(F.concat_ws("-", (acc["at"] + F.length(p["head"])).cast("string"), (acc["at"] + F.length(p["head"]) + F.length(p["text"])).cast("string"))))).otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    return parts.select(
        "conv_id", "segment", F.col("piece").alias("part"), "speaker", F.size("parts").cast("long").alias("n_turns"),
        F.size(F.filter("parts", lambda p: p["target"])).cast("long").alias("n_target"),
        F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["text"], F.lit(f"{CLOSE}\n"))), "").alias("rendered"),
        F.array_join(F.transform("parts", lambda p: F.when(p["target"], "1").otherwise("0")), "").alias("turn_mask"),
        F.array_join(spans, ",").alias("spans"),
    )


def joined(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """The join on keys whose nulls are equal; left's keys stay."""
    named = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    return left.join(named, reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]), how).drop(*(f"__{k}" for k in keys))


def in_parts(rows: DataFrame, block: int, crowd: int) -> DataFrame:
    """rows with number and part: null and 0, or in crowded segments the turn number and a range of md5 of about block rows."""
    here = [*_DIALOGUE, "segment", "turn"]
    # a segment has at most block numbers and null, so the window is over few rows
    counts = rows.groupBy(*here).agg(F.count("*").alias("n")).withColumn("all", F.sum("n").over(Window.partitionBy(*_DIALOGUE, "segment")))
    crowded = stored(counts.filter(F.col("all") > crowd).select(*here, F.ceil(F.col("n") / block).alias("parts")), "chat-crowded")
    place = F.conv(F.substring(F.md5(F.concat_ws(":", "role", "text")), 1, 8), 16, 10).cast("long")
    part = F.coalesce(F.floor(place * F.col("parts") / F.lit(float(1 << 32))), F.lit(0)).cast("long")
    return joined(rows, crowded, here, "left").select("*", F.when(F.col("parts").isNotNull(), F.col("turn")).alias("number"), part.alias("part")).drop("parts")


def starts(rows: DataFrame, fixed_roles: tuple[str, ...]) -> DataFrame:
    """(group, piece, speaker, start): the group's place in its segment, and the characters of the speaker's rendering before it.

    Lengths are summed by group and role first, so running totals are over a row a group. A speaker's own turns differ
    from others' in their heads alone.
    """
    frame = len(OPEN) + 1 + len(CLOSE) + 1
    counts = rows.groupBy(*_GROUP, "role").agg(F.count("*").alias("n"), F.sum(F.length("text").cast("long")).alias("chars"))
    chars = F.col("chars") + F.col("n") * (F.lit(frame) + F.length("role") + F.when(F.col("role").isin(*fixed_roles), 0).otherwise(len("user name=")))
    order = ["segment", F.col("number").asc_nulls_first(), "part"]
    earlier = lambda *keys: Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    groups = counts.groupBy(*_GROUP).agg(F.sum(chars).alias("chars"))
    groups = groups.withColumn("before", F.coalesce(F.sum("chars").over(earlier(*_DIALOGUE)), F.lit(0))).drop("chars")
    groups = groups.withColumn("piece", (F.row_number().over(Window.partitionBy(*_DIALOGUE, "segment").orderBy(*order)) - 1).cast("long"))
    own = counts.filter(~F.col("role").isin(*fixed_roles)).withColumnRenamed("role", "speaker").drop("chars")
    every = joined(groups, own.select(*_DIALOGUE, "speaker").distinct(), _DIALOGUE)
    every = joined(every, own, [*_GROUP, "speaker"], "left")
    spoken = F.coalesce(F.sum("n").over(earlier(*_DIALOGUE, "speaker")), F.lit(0))
    return every.select(*_GROUP, "piece", "speaker", (F.col("before") - spoken * (F.length("speaker") + len("user name=") - len("assistant"))).alias("start"))


def oracle(block: int = BLOCK, crowd: int = CROWD) -> str:
    head = f"CASE WHEN t.role = s.speaker THEN '{OPEN}assistant' WHEN t.role = 'system' THEN '{OPEN}system' ELSE '{OPEN}user name=' || t.role END || chr(10)"
    order = "segment, number NULLS FIRST, part, turn NULLS FIRST, role, text"
    return f"""
WITH r AS (SELECT conv_id, coalesce(turn // {block}, 0)::BIGINT AS segment, turn, replace(translate(coalesce(role, 'unknown'), chr(13) || chr(10), '  '), '{MARK}', '{ESCAPED}') AS role,
             replace(coalesce(text, ''), '{MARK}', '{ESCAPED}') AS text FROM conversations),
a AS (SELECT *, CASE WHEN conv_id IS NULL THEN sha256(role || ':' || text) END AS alone FROM r),
c AS (SELECT *, count(*) OVER (PARTITION BY conv_id, alone, segment) > {crowd} AS crowded, (count(*) OVER (PARTITION BY conv_id, alone, segment, turn) + {block} - 1) // {block} AS parts FROM a),
t AS (SELECT *, CASE WHEN crowded THEN turn END AS number, CASE WHEN crowded THEN ('0x' || substr(md5(role || ':' || text), 1, 8))::BIGINT * parts // 4294967296 ELSE 0 END AS part FROM c),
s AS (SELECT DISTINCT conv_id, alone, role AS speaker FROM t WHERE role <> 'system'),
p AS (SELECT t.*, s.speaker, {head} AS head, t.role = s.speaker AS target FROM s JOIN t ON s.conv_id IS NOT DISTINCT FROM t.conv_id AND s.alone IS NOT DISTINCT FROM t.alone),
o AS (SELECT *, coalesce(sum(length(head) + length(text) + {len(CLOSE) + 1}) OVER (PARTITION BY conv_id, alone, speaker ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos,
        dense_rank() OVER (PARTITION BY conv_id, alone, speaker, segment ORDER BY number NULLS FIRST, part) - 1 AS piece FROM p)
SELECT conv_id, segment, piece AS part, speaker, count(*)::BIGINT AS n_turns, count(*) FILTER (WHERE target)::BIGINT AS n_target,
  string_agg(head || text || '{CLOSE}' || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS rendered,
  string_agg(CASE WHEN target THEN '1' ELSE '0' END, '' ORDER BY turn NULLS FIRST, role, text) AS turn_mask,
  coalesce(string_agg((pos + length(head))::VARCHAR || '-' || (pos + length(head) + length(text))::VARCHAR, ',' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE target), '') AS spans
FROM o GROUP BY conv_id, alone, segment, piece, speaker"""
