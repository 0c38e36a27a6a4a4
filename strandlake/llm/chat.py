"""Preference formatting of paired conversations, in DataFrame functions alone.

The longest common prefix of turns of the chosen and the rejected conversation is rendered once as the prompt; what
follows is rendered as two completions, each with a mask in run lengths: header and user text are 0, assistant text is 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The marks around a turn.
OPEN, MID, CLOSE = "<|", "|>\n", "<|end|>\n"


def gathered(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: ``_key`` and its turns in order of turn, then role, then text, nulls first.

    A null role is ``unknown`` and a null text is empty. Rows without a key belong to no conversation and go. The turns
    of one conversation make one row, which its rendered text has to be as well.
    """
    one = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("unknown")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = turns.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.sort_array(F.collect_list(one)).alias("_turns"))
    return rows.select("_key", F.transform("_turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def _head(t: Column) -> Column:
    return F.concat(F.lit(OPEN), t["role"], F.lit(MID))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), t["text"], F.lit(CLOSE))), "")


def mask(turns: Column) -> Column:
    """Run lengths in code points, ``length:0`` or ``length:1``; their sum is the length of the rendered turns."""
    body = lambda t: F.length(F.concat(t["text"], F.lit(CLOSE))).cast("string")
    kind = lambda t: F.when(t["role"] == "assistant", F.lit(":1")).otherwise(F.lit(":0"))
    return F.array_join(F.transform(turns, lambda t: F.concat(F.length(_head(t)).cast("string"), F.lit(":0,"), body(t), kind(t))), ",")


def format_preferences(chosen: DataFrame, rejected: DataFrame, key: str = "conv_id") -> DataFrame:
    """key, n_common, prompt, chosen, rejected, chosen_mask, rejected_mask for each key of ``chosen``.

    Both tables have one row per turn: key, turn, role, text; other columns are not looked at. Turns are common while
    role and text are equal. Equal conversations have the whole text as prompt and empty completions; a key that
    ``rejected`` lacks has no common turn and an empty rejected completion. An empty table gives no rows.
    """
    both = gathered(chosen, key).join(gathered(rejected, key).withColumnRenamed("turns", "_other"), "_key", "left")
    other = F.coalesce("_other", F.filter("turns", lambda t: F.lit(False)))
    both = both.select("_key", F.col("turns").alias("a"), other.alias("b"))
    differ = F.array_position(F.zip_with("a", "b", lambda x, y: x.eqNullSafe(y)), F.lit(False))
    both = both.withColumn("n", F.when(differ > 0, differ - 1).otherwise(F.size("a")).cast("int"))
    rest = lambda c: F.slice(F.col(c), F.col("n") + 1, F.greatest(F.size(c) - F.col("n"), F.lit(0)))
    both = both.select("_key", "n", F.slice("a", F.lit(1), F.col("n")).alias("p"), rest("a").alias("a"), rest("b").alias("b"))
    return both.select(
        F.col("_key").alias(key), F.col("n").cast("long").alias("n_common"), rendered(F.col("p")).alias("prompt"),
        rendered(F.col("a")).alias("chosen"), rendered(F.col("b")).alias("rejected"),
        mask(F.col("a")).alias("chosen_mask"), mask(F.col("b")).alias("rejected_mask"),
    )


def swapped_replies(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Preference pairs from plain conversations: chosen runs to the last assistant turn; in rejected, that turn has the
    last reply of the neighbour, whose id differs in the lowest bit. Without a neighbour's reply, rejected ends before it.
    Conversations without an assistant turn make no pair."""
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).where(F.col("conv_id").isNotNull())
    last = rows.where("role = 'assistant'").groupBy("conv_id").agg(F.max(F.struct("turn", "text")).alias("last"))
    own = last.select(F.col("conv_id").alias("_conv"), F.col("last.turn").alias("_last"))
    reach = rows.join(own, F.col("conv_id") == F.col("_conv"))
    chosen = reach.where(F.col("turn").isNull() | F.col("_last").isNull() | (F.col("turn") <= F.col("_last"))).select("conv_id", "turn", "role", "text")
    before = reach.where(F.col("turn").isNull() | (F.col("turn") < F.col("_last"))).select("conv_id", "turn", "role", "text")
    near = last.select(F.col("conv_id").bitwiseXOR(F.lit(1).cast("long")).alias("_near"), F.col("last.text").alias("text"))
    reply = own.join(near, F.col("_conv") == F.col("_near")).select(F.col("_conv").alias("conv_id"), F.col("_last").alias("turn"), F.lit("assistant").alias("role"), "text")
    return chosen, before.unionByName(reply)


ORACLE = """
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
last AS (SELECT conv_id, max(turn) AS turn FROM t WHERE role = 'assistant' GROUP BY 1),
reply AS (SELECT t.conv_id, max(t.text) AS text FROM t JOIN last USING (conv_id, turn) WHERE role = 'assistant' GROUP BY 1),
c AS (SELECT t.* FROM t JOIN last l USING (conv_id) WHERE t.turn <= l.turn),
r AS (SELECT t.* FROM t JOIN last l USING (conv_id) WHERE t.turn < l.turn
      UNION ALL SELECT l.conv_id, l.turn, 'assistant', y.text FROM last l JOIN reply y ON y.conv_id = xor(l.conv_id, 1)),
cn AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i FROM c),
rn AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i FROM r),
ends AS (SELECT conv_id, count(*) AS n FROM cn GROUP BY 1),
diff AS (SELECT coalesce(cn.conv_id, rn.conv_id) AS conv_id, min(coalesce(cn.i, rn.i)) AS at FROM cn FULL JOIN rn USING (conv_id, i)
         WHERE cn.role IS DISTINCT FROM rn.role OR cn.text IS DISTINCT FROM rn.text GROUP BY 1),
com AS (SELECT e.conv_id, coalesce(d.at - 1, e.n) AS n FROM ends e LEFT JOIN diff d USING (conv_id)),
shown AS (
  SELECT 1 AS side, x.*, com.n, '<|' || role || '|>' || chr(10) AS head, text || '<|end|>' || chr(10) AS body FROM cn x JOIN com USING (conv_id)
  UNION ALL SELECT 2, x.*, com.n, '<|' || role || '|>' || chr(10), text || '<|end|>' || chr(10) FROM rn x JOIN com USING (conv_id)),
marks AS (SELECT *, length(head)::VARCHAR || ':0,' || length(body)::VARCHAR || CASE WHEN role = 'assistant' THEN ':1' ELSE ':0' END AS mark FROM shown)
SELECT conv_id, n AS n_common,
  coalesce(string_agg(head || body, '' ORDER BY i) FILTER (side = 1 AND i <= n), '') AS prompt,
  coalesce(string_agg(head || body, '' ORDER BY i) FILTER (side = 1 AND i > n), '') AS chosen,
  coalesce(string_agg(head || body, '' ORDER BY i) FILTER (side = 2 AND i > n), '') AS rejected,
  coalesce(string_agg(mark, ',' ORDER BY i) FILTER (side = 1 AND i > n), '') AS chosen_mask,
  coalesce(string_agg(mark, ',' ORDER BY i) FILTER (side = 2 AND i > n), '') AS rejected_mask
FROM marks GROUP BY conv_id, n
"""
